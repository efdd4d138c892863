"""Row filters and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.delay import EARLIEST_PLAUSIBLE_SEC, known


def has_value(c: str) -> Column:
    """Neither null nor NaN, in a form that file sources can use to skip data."""
    return F.col(c).isNotNull() & ~F.isnan(c)


def measured(df: DataFrame, status: str = "an_prognose_status", delay: str = "delay_arr_sec",
             real: str = "REAL") -> DataFrame:
    """Rows with a measured time and a known delay."""
    return df.where((F.col(status) == real) & has_value(delay))


def measured_share(df: DataFrame, status: str = "an_prognose_status",
                   delay: str = "delay_arr_sec", real: str = "REAL") -> DataFrame:
    """Rows before and after the filter for measured rows, and the share kept in percent."""
    kept = F.count_if((F.col(status) == real) & has_value(delay))
    return df.agg(F.count("*").alias("n_before"), kept.alias("n_after"),
                  F.try_divide(100.0 * kept, F.count("*")).alias("pct_kept"))


def plausible(df: DataFrame, delay: str = "delay_arr_sec",
              earliest: float = EARLIEST_PLAUSIBLE_SEC) -> DataFrame:
    """Drops arrivals further ahead of plan than can be; the limit itself is kept."""
    # NaN is above all numbers in Spark and would pass the comparison alone.
    return df.where((F.col(delay) >= earliest) & ~F.isnan(delay))


def plausible_report(df: DataFrame, delay: str = "delay_arr_sec",
                     earliest: float = EARLIEST_PLAUSIBLE_SEC, extreme: float = 1800.0) -> DataFrame:
    """What the plausibility filter removes, the new range and the share of extreme delays."""
    value = known(delay)
    keep = F.coalesce(value >= earliest, F.lit(False))
    n, kept = F.count("*"), F.count_if(keep)
    extremes = F.count_if(keep & (value > extreme))
    return df.agg(
        F.count_if(~keep).alias("n_removed"),
        F.try_divide(100.0 * F.count_if(~keep), n).alias("pct_removed"),
        kept.alias("n_kept"),
        F.min(F.when(keep, value)).alias("min_delay"),
        F.max(F.when(keep, value)).alias("max_delay"),
        extremes.alias("n_extreme"),
        F.try_divide(100.0 * extremes, kept).alias("pct_extreme"),
    )


def in_regions(events: DataFrame, stations: DataFrame, regions: list[str],
               event_key: str = "bpuic", station_key: str = "number",
               region: str = "cantonabbreviation") -> DataFrame:
    """Events at stations of the regions; no regions means all events."""
    if not regions:
        return events
    chosen = (stations.where(F.col(region).isin(*regions))
              .select(F.col(station_key).alias(event_key)).distinct())
    return events.join(chosen, event_key, "left_semi")


def top_groups(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """The k most frequent groups and their rows; ties go to the smaller name."""
    counts = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), group).limit(k)


def of_top_groups(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Rows of the k most frequent groups; k rows are broadcast, the events stay in place."""
    return df.join(F.broadcast(top_groups(df, group, k).select(group)), group, "left_semi")


def at_time(weekday: str | None = None, hour: int | None = None,
            weekday_col: str = "weekday", hour_col: str = "hour") -> Column:
    """Condition for a weekday and/or an hour; neither means every row."""
    chosen = F.lit(True)
    if weekday is not None:
        chosen = chosen & (F.col(weekday_col) == weekday)
    if hour is not None:
        chosen = chosen & (F.col(hour_col) == hour)
    return F.coalesce(chosen, F.lit(False))
