"""The stored SQL reports. They read the views ``delays`` and ``stations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.time import WEEKDAYS
from ..operators.grouped import value_counts
from ..sources.tables import run_sql

_MEASURED = "an_prognose_status = 'REAL' AND delay_arr_sec IS NOT NULL"

TOP_STATIONS = f"""
    WITH per_station AS (
        SELECT haltestellen_name, count(*) AS n_halte, avg(delay_arr_sec) AS mean_delay
        FROM delays WHERE {_MEASURED} GROUP BY haltestellen_name
    )
    SELECT haltestellen_name, n_halte, round(mean_delay, 1) AS avg_delay_sec,
           round(mean_delay / 60.0, 2) AS avg_delay_min
    FROM per_station WHERE n_halte >= :min_n
    ORDER BY avg_delay_sec DESC, haltestellen_name LIMIT 10
"""

# One row per operating day first; the weekday is worked out on those few rows.
BY_WEEKDAY = f"""
    WITH per_day AS (
        SELECT betriebstag, count(*) AS n, sum(delay_arr_sec) AS total,
               count_if(delay_arr_sec > :late_after) AS late
        FROM delays WHERE {_MEASURED} GROUP BY betriebstag
    )
    SELECT dayofweek(betriebstag) - 1 AS weekday_num, sum(n) AS n_events,
           round(sum(total) / sum(n), 1) AS avg_delay_sec,
           round(100.0D * sum(late) / sum(n), 2) AS pct_late_over_3min
    FROM per_day GROUP BY weekday_num
"""

# Summed per station before the join, so the join sees one row per station.
BY_CANTON = f"""
    WITH per_station AS (
        SELECT bpuic, count(*) AS n, sum(delay_arr_sec) AS total
        FROM delays WHERE {_MEASURED} GROUP BY bpuic
    )
    SELECT s.cantonabbreviation AS kanton, sum(d.n) AS n_events,
           round(sum(d.total) / sum(d.n), 1) AS avg_delay_sec
    FROM per_station d JOIN stations s ON d.bpuic = s.number
    GROUP BY s.cantonabbreviation HAVING n_events >= :min_n
    ORDER BY avg_delay_sec DESC, kanton
"""


def top_stations(spark: SparkSession, min_n: int = 1000) -> DataFrame:
    return run_sql(spark, TOP_STATIONS, {"min_n": min_n})


def by_weekday(spark: SparkSession, late_after: float = 180.0) -> DataFrame:
    """Per weekday of the operating day, Sunday = 0, with its label."""
    out = run_sql(spark, BY_WEEKDAY, {"late_after": late_after})
    names = F.create_map(*[F.lit(v) for i, d in enumerate(WEEKDAYS) for v in ((i + 1) % 7, d)])
    return out.select("weekday_num", names[F.col("weekday_num")].alias("weekday"), "n_events",
                      "avg_delay_sec", "pct_late_over_3min").orderBy("weekday_num")


def by_canton(spark: SparkSession, min_n: int = 500) -> DataFrame:
    return run_sql(spark, BY_CANTON, {"min_n": min_n})


def top_lines(spark: SparkSession, k: int = 10) -> DataFrame:
    """The k lines with most stops; stops without a line are left out."""
    counts = value_counts(spark.table("delays"), "linien_text")
    return counts.limit(k).withColumnRenamed("n", "n_halte")
