"""Grouped means, counts, shares and top lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.delay import DELAY_CLASSES, LATE_AFTER_SEC, known, late_flag
from ..functions.time import WEEKDAYS
from ..session import materialized
from .joins import lookup


def pct(condition: Column) -> Column:
    """Share of rows, in percent, for which the condition holds."""
    return F.try_divide(100.0 * F.count_if(condition), F.count("*"))


def kpis(df: DataFrame, delay: str = "delay_arr_sec", late: str = "is_late_3min",
         day: str = "betriebstag") -> DataFrame:
    """Rows, mean delay, late share, number of days.

    Counting per day first leaves a handful of rows for the distinct count.
    """
    per_day = df.groupBy(day).agg(
        F.count("*").alias("rows"), F.count(delay).alias("known"), F.sum(known(delay)).alias("sum"),
        F.count_if(late).alias("late"))
    return per_day.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"),
        F.try_divide(F.sum("sum"), F.sum("known")).alias("mean_delay"),
        F.try_divide(100.0 * F.sum("late"), F.sum("rows")).alias("pct_late"),
        F.count(day).alias("n_days"),
    )


def group_means(df: DataFrame, group: str | list[str], delay: str = "delay_arr_sec",
                min_n: int = 0, late: str | None = None) -> DataFrame:
    """n (known delays), mean and optionally late share per group with at least min_n.

    Rows without a group are left out.
    """
    keys = [group] if isinstance(group, str) else group
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    aggs = [F.count(known(delay)).alias("n"), F.avg(known(delay)).alias("mean_delay")]
    if late is not None:
        aggs.append(pct(F.col(late)).alias("pct_late"))
    return df.groupBy(*keys).agg(*aggs).where(F.col("n") >= min_n)


def top_by(df: DataFrame, value: str, key: str, k: int, ascending: bool = False) -> DataFrame:
    """The k rows with the largest (or smallest) value; ties go to the smaller key."""
    order = F.asc(value) if ascending else F.desc(value)
    return df.orderBy(order, F.asc(key)).limit(k)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value without null, most frequent first."""
    return (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), column))


def time_of_day_means(df: DataFrame, delay: str = "delay_arr_sec", weekday: str = "weekday",
                      hour: str = "hour") -> DataFrame:
    """Mean delay per weekday and hour, long form."""
    return group_means(df, [weekday, hour], delay).select(weekday, hour, "mean_delay", "n")


def weekday_position(weekday: str = "weekday") -> Column:
    """0 for the first label of the week to 6."""
    return (F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col(weekday)) - 1).cast("int")


def _weekday_grid(df: DataFrame, aggregate: Column, weekday: str, hour: str) -> DataFrame:
    hours = list(range(24))
    rows = df.where(F.col(weekday).isNotNull() & F.col(hour).isNotNull())
    grid = rows.groupBy(weekday).pivot(hour, hours).agg(aggregate)
    grid = grid.withColumn("weekday_order", weekday_position(weekday))
    return grid.select("weekday_order", weekday, *[F.col(str(h)).alias(f"h{h:02d}") for h in hours])


def time_of_day_grid(df: DataFrame, delay: str = "delay_arr_sec", weekday: str = "weekday",
                     hour: str = "hour") -> DataFrame:
    """Mean delay, one row per weekday in week order and one column per hour."""
    return _weekday_grid(df, F.avg(known(delay)), weekday, hour).orderBy("weekday_order")


def time_of_day_counts(df: DataFrame, weekday: str = "weekday", hour: str = "hour") -> DataFrame:
    """Rows, one row per weekday in week order and one column per hour; none is 0."""
    return _weekday_grid(df, F.count(F.lit(1)), weekday, hour).na.fill(0).orderBy("weekday_order")


def class_shares(df: DataFrame, group: str, delay_class: str = "delay_class", k: int = 5,
                 classes: list[str] = DELAY_CLASSES) -> DataFrame:
    """Share of each delay class in percent for the k largest groups.

    All classes of a group count in the denominator, also those not listed.
    """
    counts = (df.where(F.col(group).isNotNull()).groupBy(group, delay_class)
              .agg(F.count("*").alias("c")))
    known_class = F.sum(F.when(F.col(delay_class).isNotNull(), F.col("c")))

    def share(name: str) -> Column:
        of_class = F.sum(F.when(F.col(delay_class) == name, F.col("c")).otherwise(0))
        return F.try_divide(100.0 * of_class, known_class).alias(name)

    return (counts.groupBy(group).agg(F.sum("c").alias("n"), *[share(c) for c in classes])
            .orderBy(F.desc("n"), group).limit(k))


def selection_vs_all(df: DataFrame, chosen: Column, delay: str = "delay_arr_sec") -> DataFrame:
    """Mean of a selection against the overall mean, in one pass."""
    value = known(delay)
    part, whole = F.avg(F.when(chosen, value)), F.avg(value)
    return df.agg(
        F.count_if(chosen).alias("n_selected"),
        part.alias("mean_selected"),
        whole.alias("mean_all"),
        (part - whole).alias("difference"),
        ((F.try_divide(part, whole) - 1) * 100).alias("deviation_pct"),
    )


def two_group_means(df: DataFrame, flag: Column, delay: str = "delay_arr_sec") -> DataFrame:
    """n and mean of the rows with and without a flag, difference and ratio, in one pass."""
    value = known(delay)
    yes, no = F.when(flag, value), F.when(~flag, value)
    return df.agg(
        F.count(yes).alias("n_yes"), F.avg(yes).alias("mean_yes"),
        F.count(no).alias("n_no"), F.avg(no).alias("mean_no"),
        (F.avg(yes) - F.avg(no)).alias("difference"),
        ((F.try_divide(F.avg(yes), F.avg(no)) - 1) * 100).alias("difference_pct"),
    )


def rain_effect(df: DataFrame, rain: str = "niederschlag_mm", delay: str = "delay_arr_sec",
                more_than: int = 1000) -> DataFrame:
    """Mean delay in wet and dry hours; no row unless enough rows have rain data."""
    value, wet = known(delay), known(rain)
    return df.agg(
        F.count(wet).alias("n_weather"),
        F.avg(F.when(wet > 0, value)).alias("mean_rain"),
        F.avg(F.when(wet == 0, value)).alias("mean_dry"),
    ).where(F.col("n_weather") > more_than)


def daily(df: DataFrame, delay: str = "delay_arr_sec", late: str = "is_late_3min",
          day: str = "betriebstag") -> DataFrame:
    """Rows, mean delay and late share per operating day."""
    return df.where(F.col(day).isNotNull()).groupBy(day).agg(
        F.count("*").alias("n_halte"), F.avg(known(delay)).alias("mean_delay"),
        pct(F.col(late)).alias("pct_late_3min"))


def worst_days(df: DataFrame, k: int = 10, delay: str = "delay_arr_sec",
               late: str = "is_late_3min", day: str = "betriebstag") -> DataFrame:
    return top_by(daily(df, delay, late, day), "pct_late_3min", day, k)


def day_range(df: DataFrame, day: str = "betriebstag") -> DataFrame:
    """First day, last day, distinct days, calendar span."""
    days = df.where(F.col(day).isNotNull()).select(F.col(day).cast("date").alias("day")).distinct()
    return days.agg(
        F.min("day").alias("start"), F.max("day").alias("end"), F.count("*").alias("n_days"),
        (F.datediff(F.max("day"), F.min("day")) + 1).alias("n_calendar_span"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of distinct non-null values per column, one row per column."""
    values = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("v")).select("v.*").where(F.col("value").isNotNull())
    return values.distinct().groupBy("column").agg(F.count("*").alias("n_distinct"))


def _upper_ends(hashed: DataFrame, group: str, n: int) -> DataFrame:
    """(group, _top): the least bound on ``_order`` known to hold the first n rows, and at most 2n beyond.

    Rows are counted by leading bits, twelve at a time. Only the rows of the bucket in which the n-th row
    lies are counted by the next bits, and only in groups where that bucket is larger than 2n.
    """
    done, rows = [], hashed.withColumn("_below", F.lit(0).cast("long"))
    for shift in (52, 40, 28, 16, 4, 0):
        counts = rows.groupBy(group, F.shiftright("_order", shift).alias("_lead"), "_below").agg(F.count("*").alias("c"))
        # At most 2**12 buckets of a group.
        below = F.col("_below") + F.sum("c").over(Window.partitionBy(group).orderBy("_lead")) - F.col("c")
        edges = materialized(counts.withColumn("_below", below).where(F.col("_below") < n).groupBy(group)
                             .agg(F.max(F.struct("_lead", "_below", "c")).alias("e")).select(group, "e.*"))
        top = F.shiftleft("_lead", shift).bitwiseOR(F.lit((1 << shift) - 1))
        wide = F.col("c") > 2 * n
        if shift == 0 or edges.where(wide).isEmpty():
            return reduce(DataFrame.unionAll, [*done, edges.select(group, top.alias("_top"))])
        done.append(edges.where(~wide).select(group, top.alias("_top")))
        open_edges = edges.where(wide).select(group, F.col("_lead").alias("_edge"), "_below")
        rows = lookup(hashed, open_edges, [group]).where(F.shiftright("_order", shift) == F.col("_edge"))


def sample_per_group(df: DataFrame, group: str, n: int, order: Column) -> DataFrame:
    """At most n rows per group, without replacement: those first in a pseudo-random order.

    ``order`` is a 64-bit hash of the row key and a seed, so that the sample is repeatable. Counts by
    leading bits of the hash tell up to which value the sample reaches; no more than 3n rows of
    a group are ranked, whatever its size (but for rows with equal hashes).
    """
    hashed = df.where(F.col(group).isNotNull()).withColumn("_order", order)
    near = lookup(hashed, _upper_ends(hashed, group, n), [group]).where(F.col("_order") <= F.col("_top"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_order"))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_order", "_top", "_rank")


def sample_rows(df: DataFrame, n: int, order: Column) -> DataFrame:
    """n rows first in a pseudo-random order, found in the same way over all rows as one group."""
    return sample_per_group(df.withColumn("_all", F.lit(0)), "_all", n, order).drop("_all")


def seeded(seed: int, *key: str) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in key])


def late_summary(df: DataFrame, delay: str = "delay_arr_sec",
                 threshold: float = LATE_AFTER_SEC) -> DataFrame:
    """Late rows, late share and share at or before plan."""
    return df.agg(
        F.count_if(late_flag(delay, threshold)).alias("n_late"),
        pct(late_flag(delay, threshold)).alias("pct_late"),
        pct(F.coalesce(known(delay) <= 0, F.lit(False))).alias("pct_early_or_punctual"))
