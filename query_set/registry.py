"""Where queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Fractional columns rounded, counts as bigint, so that both engines print the same."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # Adding zero turns -0.0 into 0.0.
            c = F.round(c, digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def r(*columns: str, digits: int = 6) -> str:
    """SQL: 'expr AS name' items with the expression rounded the same way."""
    parts = []
    for c in columns:
        expr, _, name = c.rpartition(" AS ")
        parts.append(f"(round({expr or name}, {digits}) + 0.0) AS {name}")
    return ", ".join(parts)
