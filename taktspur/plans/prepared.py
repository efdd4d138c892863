"""The prepared table: measured, plausible events with time, weather and class columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.delay import EARLIEST_PLAUSIBLE_SEC, delay_class, late_flag
from ..functions.time import hour_floor, time_features
from ..operators.filters import measured, plausible
from ..operators.joins import station_lookup, with_nearest_point, with_weather
from ..schemas import EVENTS, PREPARED
from ..sources.events import without_nan
from ..sources.stations import one_per_key
from ..sources.tables import conform
from ..sources.weather import hourly_measures


def cleaned(events: DataFrame, earliest: float = EARLIEST_PLAUSIBLE_SEC) -> DataFrame:
    """Events in the fixed schema, measured and plausible."""
    kept = plausible(measured(conform(events, EVENTS)), earliest=earliest)
    return without_nan(kept, ["delay_dep_sec"])


def with_features(events: DataFrame, ts: str = "ankunftszeit",
                  delay: str = "delay_arr_sec") -> DataFrame:
    """Time features, delay class and late flag; needs no join."""
    return events.withColumns({
        **time_features(ts),
        "delay_class": delay_class(delay),
        "is_late_3min": late_flag(delay),
    })


def prepare(events: DataFrame, stations: DataFrame, weather: DataFrame,
            shift_hours: int = 0) -> DataFrame:
    """The full prepared table; the events are not moved while both look-up tables are small."""
    points = with_nearest_point(one_per_key(stations)).select("number", "nearest_weather_abbr")
    near = station_lookup(with_features(cleaned(events)), points,
                          {"nearest_weather_abbr": "weather_abbr"})
    near = near.withColumn("delay_ts_hour", hour_floor("ankunftszeit"))
    return with_weather(near, hourly_measures(weather, shift_hours)).select(*PREPARED.fieldNames())


def station_points(stations: DataFrame) -> DataFrame:
    """Stations per weather point, most first."""
    mapped = with_nearest_point(one_per_key(stations))
    return (mapped.where(F.col("nearest_weather_abbr").isNotNull())
            .groupBy("nearest_weather_abbr").agg(F.count("*").alias("n_stations"))
            .orderBy(F.desc("n_stations"), "nearest_weather_abbr"))
