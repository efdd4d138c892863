"""Calendar features of naive timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Weekday labels, Monday first.
WEEKDAYS = ["Mo", "Di", "Mi", "Do", "Fr", "Sa", "So"]

# Day parts, lower hour excluded, upper hour included.
DAY_PARTS = [(0, 6, "Nacht"), (6, 12, "Vormittag"), (12, 18, "Nachmittag"), (18, 24, "Abend")]

# A date with the day first; what follows it may be a time of day.
DAY_FIRST = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_time(c: Column | str) -> Column:
    """Naive timestamp from day-first or ISO text; null if the text is neither.

    The cast knows no time zone, so an hour that a clock change skips is read as it stands.
    """
    return F.regexp_replace(F.trim(_col(c)), DAY_FIRST, "$3-$2-$1").try_cast("timestamp_ntz")


def weekday_label(num: Column) -> Column:
    """Label for 0 (Monday) to 6; null for null."""
    return F.get(F.array(*[F.lit(d) for d in WEEKDAYS]), num)


def weekday_from_sunday(day: Column | str) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(_col(day)) - 1


def time_features(ts: Column | str) -> dict[str, Column]:
    """hour, weekday_num, weekday, is_weekend and is_rush_hour of a timestamp.

    Without a timestamp both flags are false, so the row counts as an off-peak workday.
    """
    ts = _col(ts)
    hour, num = F.hour(ts), F.weekday(ts)
    weekend = F.coalesce(num.isin(5, 6), F.lit(False))
    peak = F.coalesce(hour.between(6, 8) | hour.between(16, 18), F.lit(False))
    return {
        "hour": hour,
        "weekday_num": num,
        "weekday": weekday_label(num),
        "is_weekend": weekend,
        "is_rush_hour": ~weekend & peak,
    }


def hour_floor(ts: Column | str) -> Column:
    """Start of the hour; built from its parts so that no time zone enters."""
    ts = _col(ts)
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts),
                                F.lit(0), F.lit(0))


def day_part(hour: Column | str) -> Column:
    """Name of the part of the day; hour 0 lies in none."""
    hour = _col(hour)
    part = F.lit(None).cast("string")
    for low, high, name in DAY_PARTS:
        part = F.when((hour > low) & (hour <= high), name).otherwise(part)
    return part
