"""Missing values, duplicates, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def _missing(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def null_report(df: DataFrame) -> DataFrame:
    """Columns with missing values: count and percent, most first. One pass over the table."""
    counts = df.agg(F.count("*").alias("rows"), F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.count_if(_missing(f)).alias("missing"))
        for f in df.schema.fields
    ]).alias("per_column"))
    return (counts.select("rows", F.explode("per_column").alias("c"))
            .where(F.col("c.missing") > 0)
            .select("c.column", "c.missing",
                    F.bround(100.0 * F.col("c.missing") / F.col("rows"), 2).alias("pct"))
            .orderBy(F.desc("missing"), "column"))


def _short(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if not isinstance(field.dataType, T.StringType):
        return column
    digest = F.concat(F.lit("#"), F.sha2(column, 256), F.char_length(column).cast("string"))
    return F.when(F.char_length(column) > 64, digest).otherwise(F.concat(F.lit("="), column))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Exact duplicates beyond the first; nulls count as equal.

    Copies are combined before the shuffle, so a row repeated millions of times travels once
    per task. Long texts travel as their SHA-256 and length.
    """
    copies = df.groupBy(*[_short(f) for f in df.schema.fields]).agg(F.count("*").alias("_n"))
    return copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))


def coverage(df: DataFrame, day: str = "betriebstag", weather: str = "temperatur_c") -> DataFrame:
    """Rows, first and last day, rows with weather."""
    return df.agg(F.count("*").alias("n_rows"), F.min(day).alias("first_day"),
                  F.max(day).alias("last_day"), F.count(weather).alias("n_weather"))
