"""Distribution of a value: descriptives, histogram, box statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.delay import LATE_AFTER_SEC, known
from .filters import has_value
from .ranks import quantiles, quantiles_of, stored_counts, value_counts_by

# Quantiles of the descriptive table.
DESCRIBE_AT = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95,
               "p99": 0.99, "p999": 0.999}


def describe(df: DataFrame, value: str = "delay_arr_sec", by: str | None = None,
             at: dict[str, float] = DESCRIBE_AT, approximate: bool = False) -> DataFrame:
    """n, mean, sd, min, max, quantiles, late share and share at or before plan.

    Quantiles are exact unless the caller asks for ``approximate`` ones.
    """
    groups = [by] if by else []
    for group in groups:
        df = df.where(F.col(group).isNotNull())
    x = known(value)
    moments = [
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"),
        F.min(x).alias("min"), F.max(x).alias("max"),
        F.try_divide(100.0 * F.count_if(x > LATE_AFTER_SEC), F.count(x)).alias("pct_late"),
        F.try_divide(100.0 * F.count_if(x <= 0), F.count(x)).alias("pct_early_or_punctual"),
    ]
    if approximate:
        moments += [F.percentile_approx(x, p).alias(name) for name, p in at.items()]
        return df.groupBy(*groups).agg(*moments)
    exact = quantiles(df, value, at, groups)
    if by:
        return df.groupBy(by).agg(*moments).join(exact, by, "left")
    row = exact.select(F.struct(*exact.columns)).scalar()
    return df.agg(*moments).withColumn("_at", row).select("*", "_at.*").drop("_at")


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Counts in equal bins from the smallest to the largest value; the last bin is closed."""
    x = df.where(has_value(value)).select(F.col(value).cast("double").alias("x"))
    span = x.agg(F.struct(F.min("x").alias("low"), F.max("x").alias("high")).alias("span"))
    flat = F.col("span.low") == F.col("span.high")
    low = F.when(flat, F.col("span.low") - 0.5).otherwise(F.col("span.low"))
    high = F.when(flat, F.col("span.high") + 0.5).otherwise(F.col("span.high"))
    width = (high - low) / bins
    guess = F.floor((F.col("x") - low) / (high - low) * bins)
    # Division may miss an edge by one digit; the edges as reported decide.
    edge = (F.when(F.col("x") < low + width * guess, guess - 1)
            .when(F.col("x") >= low + width * (guess + 1), guess + 1).otherwise(guess))
    bin_no = F.least(edge, F.lit(bins - 1))
    counts = (x.withColumn("span", span.scalar()).groupBy(bin_no.alias("bin"))
              .agg(F.count("*").alias("n")))
    return (df.sparkSession.range(bins).select(F.col("id").alias("bin"))
            .withColumn("span", span.scalar())
            .join(counts, "bin", "left")
            .select(F.col("bin"), (low + width * F.col("bin")).alias("bin_low"),
                    (low + width * (F.col("bin") + 1)).alias("bin_high"),
                    F.coalesce("n", F.lit(0)).alias("n")))


def box_stats(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Quartiles and whiskers per group; a whisker ends at the outermost value within
    1.5 interquartile ranges of the box."""
    groups = [by] if by else []
    hist = stored_counts(value_counts_by(df, value, groups))
    quartiles = quantiles_of(hist, {"q1": 0.25, "median": 0.5, "q3": 0.75}, groups)
    box = quartiles.select(*groups, F.struct("q1", "median", "q3").alias("box"))
    boxed = hist.join(box, by) if by else hist.withColumn("box", box.scalar())
    q1, q3, x = F.col("box.q1"), F.col("box.q3"), F.col("value")
    reach = 1.5 * (q3 - q1)
    ends = boxed.groupBy(*groups, "box").agg(
        F.sum("n").alias("rows"),
        F.min(F.when(x >= q1 - reach, x)).alias("low"), F.max(F.when(x <= q3 + reach, x)).alias("high"))
    return ends.select(
        *groups, F.col("rows").alias("n"), F.least("low", q1).alias("whisker_low"),
        q1.alias("q1"), F.col("box.median").alias("median"), q3.alias("q3"),
        F.greatest("high", q3).alias("whisker_high"))
