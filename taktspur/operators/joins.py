"""Look-ups against master data, weather and rank tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schemas import WEATHER_NAMES
from ..sources.stations import one_per_key

# Weather points as (abbreviation, latitude, longitude).
WEATHER_POINTS = [
    ("SMA", 47.3784, 8.5660),
    ("KLO", 47.4800, 8.5360),
    ("BER", 46.9908, 7.4646),
    ("GVE", 46.2477, 6.1276),
    ("BAS", 47.5418, 7.5836),
    ("LUG", 46.0044, 8.9601),
    ("LUZ", 47.0367, 8.3010),
    ("STG", 47.4253, 9.3996),
    ("SIO", 46.2188, 7.3308),
    ("DAV", 46.8127, 9.8438),
    ("CHU", 46.8703, 9.5302),
    ("NEU", 47.0000, 6.9533),
    ("INT", 46.6724, 7.8704),
    ("WYN", 47.2538, 7.7878),
    ("MAG", 46.1601, 8.9337),
]
KM_PER_DEGREE = 111.0

# Parts into which the events of each key, and those without a key, are dealt in a look-up.
SHARES, KEYLESS_SHARES = 8, 1024


def nearest_point(lat: str, lon: str,
                  points: list[tuple[str, float, float]] = WEATHER_POINTS) -> Column:
    """struct(km, abbr) of the nearest point on a plane scaled at the points' mean latitude.

    The points are a fixed list, so this is one expression per station and no join.
    Equal distances go to the smaller abbreviation; a missing coordinate gives null.
    """
    shrink = math.cos(math.radians(sum(p[1] for p in points) / len(points)))
    y, x = f"`{lat}`", f"`{lon}`"
    away = [
        f"named_struct('km', sqrt(({y} - {p_lat}D) * ({y} - {p_lat}D) + ({x} - {p_lon}D) * ({x} - {p_lon}D)"
        f" * {shrink * shrink!r}D) * {KM_PER_DEGREE}D, 'abbr', '{abbr}')"
        for abbr, p_lat, p_lon in points
    ]
    nearest = F.array_min(F.expr(f"array({', '.join(away)})"))
    return F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), nearest)


def with_nearest_point(stations: DataFrame, lat: str = "lat", lon: str = "lon",
                       points: list[tuple[str, float, float]] = WEATHER_POINTS) -> DataFrame:
    near = nearest_point(lat, lon, points)
    return stations.withColumns({
        "nearest_weather_abbr": near["abbr"],
        "weather_distance_km": near["km"],
    })


def lookup(events: DataFrame, table: DataFrame, on: list[str], shares: int = SHARES,
           spread: str | None = None) -> DataFrame:
    """Left join of events to a table with one row per key; no match gives nulls.

    One plan at every size and no job while it is built: whether the table is broadcast is left to
    the adaptive plan, which knows its bytes. Where the two are merged by key, the events of a key
    are dealt into ``shares`` parts by a hash of one column, and the table is repeated as often, so
    that a hot key is not one task's work. Events without a key match nothing and are dealt into
    more parts. ``spread`` is that column, by default the first plain one that is no key.
    """
    added = [c for c in table.columns if c not in on]
    plain = [f.name for f in events.schema.fields
             if f.name not in on and not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]
    spread = spread or (plain[0] if plain else on[0])
    no_key = F.lit(False)
    for key in on:
        no_key = no_key | F.col(key).isNull()
    mixed = F.xxhash64(F.col(spread))
    share = F.when(no_key, F.pmod(mixed, F.lit(KEYLESS_SHARES)) + shares).otherwise(F.pmod(mixed, F.lit(shares)))
    parts = table.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    joined = events.withColumn("_share", share).join(parts, [*on, "_share"], "left")
    return joined.select(*events.columns, *added)


def split_join(left: DataFrame, right: DataFrame, on: list[str], rows: str, share: float = 1e-3) -> DataFrame:
    """Inner join where a few keys may hold most rows of the left side.

    ``right`` has one row per key, and its column ``rows`` says how many left rows have that
    key. At most 1/share keys can hold that share of the left rows each: those are
    broadcast, and only the other keys are shuffled.
    """
    total = right.agg(F.sum(rows)).scalar()
    hot = right.where(F.col(rows) >= share * total)
    cold = right.where(F.col(rows) < share * total)
    at_hot = left.join(F.broadcast(hot), on)
    elsewhere = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return at_hot.unionByName(elsewhere)


def station_lookup(events: DataFrame, stations: DataFrame, attributes: dict[str, str],
                   event_key: str = "bpuic", station_key: str = "number") -> DataFrame:
    """Station attributes by station number; ``attributes`` maps station column to new name.

    A number with several records counts with the smallest of them, so no event is doubled.
    """
    table = one_per_key(stations.select(station_key, *attributes), station_key).select(F.col(station_key).alias(event_key),
                            *[F.col(src).alias(out) for src, out in attributes.items()])
    return lookup(events, table, [event_key])


def match_rate(df: DataFrame, column: str) -> DataFrame:
    """Rows with a value in the column, all rows, share in percent."""
    return df.agg(F.count(column).alias("n_matched"), F.count("*").alias("n_rows"),
                  F.try_divide(100.0 * F.count(column), F.count("*")).alias("pct_matched"))


def with_weather(events: DataFrame, hourly: DataFrame) -> DataFrame:
    """Measures of the hour at the weather point; typed nulls for measures not given.

    Where two weather rows stand for one hour, as in files that overlap, the smaller one counts.
    """
    on = ["weather_abbr", "delay_ts_hour"]
    joined = lookup(events, one_per_key(hourly, on), on)
    present = set(joined.columns)
    absent = [m for m in WEATHER_NAMES.values() if m not in present]
    return joined.withColumns({m: F.lit(None).cast("double") for m in absent})
