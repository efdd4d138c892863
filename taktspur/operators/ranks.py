"""Exact quantiles and ranks without sorting the events in one place.

Events are first counted by value. A group with few distinct values is ranked as it is. A group
with more is split by the leading bits of an ordered image of its values, behind those that all its
values share, twelve at a time; only the buckets that are still too large are split again. Each bucket
knows how many rows lie below it, so no task sorts more than ``MOST_VALUES`` values of a bucket or
2**13 buckets of a parent, however many values there are and however they are spread. A value held
by a third of all rows is a single counted row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialized
from .joins import lookup

#: Distinct values that one task sorts at most.
MOST_VALUES = 1 << 16
#: Leading bits by which a bucket is split at a time.
DIGIT = 12
#: Buckets that may be sent to every task; more are looked up by a shuffle.
SMALL = 1 << 16


def with_ordered_bits(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds a bigint per double that is ordered as the doubles are: exponent, then fraction, then the sign.

    This is the IEEE image of the absolute value; 0.0 and -0.0 are both 0. NaN has no place. The steps
    are columns of their own, as an expression inside another would be worked out again and again.
    """
    size, one = F.abs(value), F.lit(1 << 52)
    exponent, part = F.col("_exponent"), F.col("_part")
    steps = (
        # The logarithm may miss the exponent by one near powers of two; the fraction tells.
        df.withColumn("_exponent", F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022)))
        .withColumn("_part", size * F.pow(F.lit(2.0), -exponent))
        .withColumn("_exponent", F.greatest(
            exponent + F.when(part >= 2, 1).when(part < 1, -1).otherwise(0), F.lit(-1022)))
        .withColumn("_part", size * F.pow(F.lit(2.0), -exponent)))
    image = (F.when(size == 0, F.lit(0).cast("long"))
             .when(size == float("inf"), F.lit(2047 << 52))
             .when(part < 1, (part * one).cast("long"))
             .otherwise((exponent + 1023) * one + ((part - 1) * one).cast("long")))
    return (steps.withColumn(out, image).withColumn(out, F.when(F.col(value) < 0, -F.col(out)).otherwise(F.col(out)))
            .drop("_exponent", "_part"))


def value_counts_by(df: DataFrame, value: Column | str, by: list[str] | None = None) -> DataFrame:
    """(by..., value, n): rows per known value and group."""
    value = F.col(value) if isinstance(value, str) else value
    kept = df.where(value.isNotNull() & ~F.isnan(value.cast("double"))).select(*(by or []), value.cast("double").alias("value"))
    for c in by or []:
        kept = kept.where(F.col(c).isNotNull())
    return kept.groupBy(*(by or []), "value").agg(F.count("*").alias("n"))


def stored_counts(hist: DataFrame) -> DataFrame:
    """Counted values with their image, written once, as each split reads them again."""
    imaged = with_ordered_bits(hist, "value", "_bits")
    # Without the last bit, so that the distance of two images fits a bigint.
    return materialized(imaged.withColumn("_bits", F.shiftright("_bits", 1)))


def _figures() -> list[Column]:
    return [F.count("*").alias("values"), F.sum("n").alias("inside"), F.min("_bits").alias("lo"), F.max("_bits").alias("hi")]


def _meet(rows: DataFrame, buckets: DataFrame, by: list[str], few: bool) -> DataFrame:
    """Rows of the given buckets with their columns."""
    on = [*by, "_edge"]
    return rows.join(F.broadcast(buckets), on) if few else lookup(rows, buckets, on).where(F.col("total").isNotNull())


def _totals(hist: DataFrame, by: list[str], wanted: Column | None = None, most: int | None = None) -> DataFrame:
    """Adds ``upto`` and ``total``. With ``wanted``, a condition on before, inside and total, only values
    of buckets that meet it are returned; more of the same group may come along."""
    most = most or MOST_VALUES
    rows = hist.withColumn("_edge", F.lit(0).cast("long"))
    columns = [c for c in hist.columns if c != "_bits"]
    buckets = rows.groupBy(*by, "_edge").agg(*_figures()).withColumns(
        {"before": F.lit(0).cast("long"), "total": F.col("inside")})
    if (buckets.agg(F.max("values")).first()[0] or 0) <= most:
        group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        return hist.select(*columns).withColumns({"upto": F.sum("n").over(group.orderBy("value")), "total": F.sum("n").over(group)})

    parts = []
    buckets = materialized(buckets)
    while True:
        if wanted is not None:
            buckets = buckets.where(wanted)
        # Two values that differ in the last bit alone stay together.
        is_full = (F.col("values") > most) & (F.col("lo") < F.col("hi"))
        n, n_full = buckets.agg(F.count("*"), F.count_if(is_full)).first()
        inside = Window.partitionBy(*by, "_edge").orderBy("value")
        light = buckets.where(~is_full).select(*by, "_edge", "before", "total")
        parts.append(_meet(rows, light, by, n - n_full <= SMALL)
                     .withColumn("upto", F.col("before") + F.sum("n").over(inside)).select(*columns, "upto", "total"))
        if not n_full:
            return reduce(DataFrame.unionByName, parts)

        width = F.greatest(F.floor(F.log2((F.col("hi") - F.col("lo")).cast("double"))) + 1 - DIGIT, F.lit(0)).cast("int")
        full = buckets.where(is_full).select(
            *by, "_edge", F.col("before").alias("_below"), "total", F.col("lo").alias("_lo"), width.alias("_width"))
        rows = (_meet(rows, full, by, n_full <= SMALL).withColumnRenamed("_edge", "_parent")
                .withColumn("_edge", F.expr("_lo + shiftleft(shiftright(_bits - _lo, _width), _width)")))
        sums = rows.groupBy(*by, "_parent", "_below", "total", "_edge").agg(*_figures())
        # At most 2**13 buckets of a parent.
        siblings = Window.partitionBy(*by, "_parent").orderBy("_edge")
        before = F.col("_below") + F.sum("inside").over(siblings) - F.col("inside")
        buckets = materialized(sums.withColumn("before", before).drop("_parent", "_below"))
        rows = rows.select(*columns, "_bits", "_edge")


def running_totals(hist: DataFrame, by: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Adds ``upto`` (rows with this value or less) and ``total`` (rows) within each group.

    ``hist`` has one row per group and value.
    """
    return _totals(stored_counts(hist), by or [], most=most)


def quantiles_of(hist: DataFrame, probabilities: dict[str, float], by: list[str] | None = None,
                 most: int | None = None) -> DataFrame:
    """Quantiles from counted values as ``stored_counts`` gives them."""
    by = by or []
    total = F.col("total")
    # Zero-based places in the sorted rows on both sides of each quantile.
    place = {name: (total - 1) * F.lit(float(p)) for name, p in probabilities.items()}
    low = {name: F.floor(at) for name, at in place.items()}
    high = {name: F.least(at + 1, total - 1) for name, at in low.items()}
    wanted = F.lit(False)
    for k in [*low.values(), *high.values()]:
        wanted = wanted | ((F.col("before") <= k) & (k < F.col("before") + F.col("inside")))
    rows = _totals(hist, by, wanted, most)

    def value_at(k: Column) -> Column:
        here = (F.col("upto") - F.col("n") <= k) & (k < F.col("upto"))
        return F.max(F.when(here, F.col("value")))

    return rows.groupBy(*by).agg(*[
        (value_at(low[name]) + (value_at(high[name]) - value_at(low[name]))
         * F.max(place[name] - low[name])).alias(name)
        for name in probabilities
    ])


def quantiles(df: DataFrame, value: Column | str, probabilities: dict[str, float],
              by: list[str] | None = None, most: int | None = None) -> DataFrame:
    """One row per group with exact interpolated quantiles, named as in ``probabilities``.

    Only the buckets that hold a wanted place are split and sorted.
    """
    return quantiles_of(stored_counts(value_counts_by(df, value, by)), probabilities, by, most)


def average_rank() -> Column:
    """Mean rank of the rows that share a value, on running totals."""
    return F.col("upto") - (F.col("n") - 1) / 2.0
