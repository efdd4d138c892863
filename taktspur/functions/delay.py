"""Delay values: cleaning, classes, the late flag, clipping."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Lower bound (included), upper bound (excluded), label.
DELAY_BUCKETS = [
    (float("-inf"), -30.0, "frueh_30+s"),
    (-30.0, 0.0, "frueh_unter_30s"),
    (0.0, 60.0, "puenktlich_unter_1min"),
    (60.0, 180.0, "leicht_1_3min"),
    (180.0, 300.0, "verspaetet_3_5min"),
    (300.0, 600.0, "stark_5_10min"),
    (600.0, float("inf"), "extrem_ueber_10min"),
]
UNKNOWN_CLASS = "unbekannt"
DELAY_CLASSES = [label for _, _, label in DELAY_BUCKETS]

LATE_AFTER_SEC = 180.0
EARLIEST_PLAUSIBLE_SEC = -600.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(c: Column | str) -> Column:
    """The value as double with NaN turned into null (Spark sorts NaN above all numbers)."""
    value = _col(c).cast("double")
    return F.when(~F.isnan(value), value)


def delay_class(c: Column | str) -> Column:
    """Label of the bucket a delay falls in; null, NaN and +infinity are unknown."""
    value = known(c)
    label = F.lit(UNKNOWN_CLASS)
    for low, high, name in reversed(DELAY_BUCKETS):
        label = F.when((value >= low) & (value < high), name).otherwise(label)
    return label


def late_flag(c: Column | str, threshold: float = LATE_AFTER_SEC) -> Column:
    """True only above the threshold; an unknown delay is not late."""
    return F.coalesce(known(c) > threshold, F.lit(False))


def clipped(c: Column | str, low: float, high: float) -> Column:
    """The value held inside [low, high]; null stays null."""
    value = known(c)
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """end - start in seconds with fraction, independent of the session time zone."""
    gap = _col(end) - _col(start)
    return gap.cast("interval second").cast("decimal(20,6)").cast("double")
