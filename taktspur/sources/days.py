"""Which days to load, and the links to their files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def date_spine(spark: SparkSession, start: str | dt.date, end: str | dt.date) -> DataFrame:
    """One row per calendar day from start to end; an end before the start is an error."""
    first, last = (d if isinstance(d, dt.date) else dt.date.fromisoformat(d) for d in (start, end))
    if last < first:
        raise ValueError(f"end {last} lies before start {first}")
    return _spine(spark.range(1), F.lit(first), F.lit(last))


def spine_of(df: DataFrame, day: str) -> DataFrame:
    """One row per calendar day between the first and last day of a table."""
    span = df.agg(F.min(day).alias("first"), F.max(day).alias("last"))
    return _spine(span.where(F.col("first").isNotNull()), F.col("first"), F.col("last"))


def _spine(df: DataFrame, first: Column, last: Column) -> DataFrame:
    days = F.sequence(first.cast("date"), last.cast("date"), F.expr("interval 1 day"))
    return df.select(F.explode(days).alias("day"))


def latest_days(available: DataFrame, day: str, k: int = 3) -> DataFrame:
    """The k latest distinct days, ascending."""
    days = available.where(F.col(day).isNotNull()).select(F.col(day).alias("day")).distinct()
    return days.orderBy(F.desc("day")).limit(k).orderBy("day")


def days_to_load(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Wanted days that are not stored yet."""
    return wanted.join(stored.select("day").distinct(), "day", "left_anti")


def missing_days(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """Wanted days for which the source has nothing."""
    return wanted.join(available.select("day").distinct(), "day", "left_anti")


def extract_links(pages: DataFrame, html: str, page: str, pattern: str) -> DataFrame:
    """Links found in page text; group 1 of the pattern is the key.

    Per key the first link on the first page wins. The choice is an aggregate, so a key
    that stands on most pages is combined before it is shuffled.
    """
    found = pages.select(
        F.col(page).alias("page"),
        F.posexplode(F.arrays_zip(
            F.regexp_extract_all(html, F.lit(pattern), F.lit(0)).alias("link"),
            F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("key"),
        )).alias("pos", "hit"),
    )
    first = F.min(F.struct("page", "pos", F.col("hit.link").alias("link"))).alias("first")
    return found.groupBy(F.col("hit.key").alias("key")).agg(first).select(
        "key", "first.link", "first.page", "first.pos")
