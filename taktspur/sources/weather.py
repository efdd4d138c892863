"""Hourly weather: one file per weather station, its key in the file name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.time import hour_floor, parse_time
from ..schemas import WEATHER, WEATHER_NAMES
from .tables import CSV, lower_names, project_optional


def read_latin1_csv(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """Semicolon file in ISO-8859-1 with a header; all columns as text, doubled quotes inside quotes."""
    return (spark.read.options(**CSV).option("header", True).option("multiLine", multi_line)
            .option("encoding", "ISO-8859-1").csv(path))


def parsed_weather(raw: DataFrame, time_col: str = "reference_timestamp") -> DataFrame:
    """Lower-case names, day-first time; rows without a readable time are dropped."""
    df = lower_names(raw)
    kinds = {f.name: f.dataType for f in WEATHER.fields}
    df = df.withColumn(time_col, parse_time(time_col)).where(F.col(time_col).isNotNull())
    return df.select(*[
        F.col(c).try_cast(kinds[c]).alias(c) if c in WEATHER_NAMES else F.col(c) for c in df.columns
    ])


def read_tagged_parquet(spark: SparkSession, path: str | list[str], tag: str = "station_abbr",
                        pattern: str = r"/([^/_]+)_[^/]*$") -> DataFrame:
    """Many files as one table, tagged from the path of the file a row comes from.

    By default the tag is the file name up to its first underscore.
    """
    paths = [path] if isinstance(path, str) else path
    df = spark.read.parquet(*paths)
    return df.withColumn(tag, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def weather_table(df: DataFrame) -> DataFrame:
    """The listed measures that exist, by weather station and time."""
    return project_optional(lower_names(df), WEATHER.fieldNames())


def hourly_measures(weather: DataFrame, shift_hours: int = 0) -> DataFrame:
    """Weather by (weather_abbr, delay_ts_hour), measures named as in the prepared table."""
    ts = F.col("reference_timestamp") + F.expr(f"interval {int(shift_hours)} hours")
    present = set(weather.columns)
    measures = {src: out for src, out in WEATHER_NAMES.items() if src in present}
    return weather.where(F.col("reference_timestamp").isNotNull()).select(
        F.col("station_abbr").alias("weather_abbr"),
        hour_floor(ts).alias("delay_ts_hour"),
        *[F.col(src).alias(out) for src, out in measures.items()],
    )


def absent_keys(wanted: DataFrame, meta: DataFrame, key: str = "station_abbr") -> DataFrame:
    """Wanted keys not in the metadata, compared in upper case."""
    present = meta.where(F.col(key).isNotNull()).select(F.upper(key).alias(key)).distinct()
    return wanted.select(key).distinct().join(present, key, "left_anti")
