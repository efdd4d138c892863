"""Station table and marker scale of the map."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.filters import in_regions
from ..operators.grouped import pct, top_by


def station_table(events: DataFrame, stations: DataFrame, regions: list[str] | None = None,
                  min_n: int = 200) -> DataFrame:
    """Rows, mean delay and late share per station with its attributes.

    Events are summed per station first; the join then sees one row per station.
    Stations without master data are left out.
    """
    chosen = in_regions(events, stations, regions or []).where(F.col("bpuic").isNotNull())
    sums = chosen.groupBy("bpuic").agg(
        F.count("*").alias("n_halte"), F.avg("delay_arr_sec").alias("mean_delay"),
        pct(F.col("is_late_3min")).alias("pct_late")).where(F.col("n_halte") >= min_n)
    attributes = stations.select(F.col("number").alias("bpuic"), "designationofficial", "lat",
                                 "lon", "cantonabbreviation")
    return sums.join(attributes, "bpuic").withColumns({
        "mean_delay": F.bround("mean_delay", 1), "pct_late": F.bround("pct_late", 1)})


def hotspots(table: DataFrame, min_delay: float = 0) -> DataFrame:
    """Stations whose rounded mean reaches the threshold; 0 keeps all, also negative means."""
    return table.where(F.col("mean_delay") >= min_delay) if min_delay > 0 else table


def top_hotspots(table: DataFrame, min_delay: float = 0, k: int = 20) -> DataFrame:
    return top_by(hotspots(table, min_delay), "mean_delay", "bpuic", k)


def map_scale(table: DataFrame, min_delay: float = 0) -> DataFrame:
    """Marker radius and position of each shown station on the colour scale.

    The scale runs from the 5th to the 95th percentile of all stations, before the
    threshold; its position is held inside [0, 1].
    """
    # One row per station, and equal means are counted together before they travel.
    ends = table.agg(F.percentile("mean_delay", F.array(F.lit(0.05), F.lit(0.95))).alias("e")).select(
        F.col("e")[0].alias("low"), F.col("e")[1].alias("high"))
    ends = ends.select(F.struct("low", F.when(F.col("high") <= F.col("low"), F.col("low") + 1)
                                .otherwise(F.col("high")).alias("high")))
    low, high = F.col("_ends.low"), F.col("_ends.high")
    position = (F.col("mean_delay") - low) / (high - low)
    return hotspots(table, min_delay).withColumn("_ends", ends.scalar()).withColumns({
        "scale_low": low,
        "scale_high": high,
        "scale_position": F.greatest(F.lit(0.0), F.least(F.lit(1.0), position)),
        "radius": 4 + F.least(F.col("n_halte") / 500, F.lit(9.0)),
    }).drop("_ends")
