"""Station master data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import STATIONS
from .tables import CSV

# Transport mode looked for, end date that marks an active record.
TRANSPORT, OPEN_END = "TRAIN", "9999-12-31"


def active_stations(raw: DataFrame, transport: str = TRANSPORT, open_end: str = OPEN_END) -> DataFrame:
    """Records that serve the transport mode, have coordinates and are still valid."""
    serves = F.contains(F.upper("meansoftransport"), F.lit(transport.upper()))
    return raw.where(serves & F.col("hasgeolocation") & (F.col("validto").cast("string") == open_end))


def with_coordinates(raw: DataFrame, geopos: str = "geopos") -> DataFrame:
    """lat and lon from a text such as '47.37, 8.54'."""
    parts = F.split(geopos, ",")
    return raw.withColumns({
        "lat": F.trim(F.get(parts, F.lit(0))).cast("double"),
        "lon": F.trim(F.get(parts, F.lit(1))).cast("double"),
    })


def one_per_key(table: DataFrame, key: str | list[str] = "number") -> DataFrame:
    """One record per key, the smallest by its other columns.

    A doubled station number, or a doubled weather hour, would fan out every event of it in a join.
    """
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in table.columns if c not in keys]
    kept = table
    for k in keys:
        kept = kept.where(F.col(k).isNotNull())
    if not rest:
        return kept.distinct()
    return kept.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("first")).select(*keys, "first.*").select(*table.columns)


def write_stations_csv(stations: DataFrame, path: str) -> None:
    stations.write.mode("overwrite").options(**CSV).option("header", True).csv(path)


def read_stations_csv(spark: SparkSession, path: str, schema=STATIONS, multi_line: bool = False) -> DataFrame:
    return (spark.read.schema(schema).options(**CSV).option("header", True)
            .option("multiLine", multi_line).csv(path))


def region_list(stations: DataFrame, region: str = "cantonabbreviation") -> DataFrame:
    """Sorted distinct regions without null."""
    return stations.where(F.col(region).isNotNull()).select(region).distinct().orderBy(region)
