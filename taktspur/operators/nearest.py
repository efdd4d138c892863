"""Nearest point of a table, for every row of another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.delay import known
from ..session import materialized
from .joins import KM_PER_DEGREE, lookup

#: Points of a cell that need no further split, binary digits of a place on the map, and digits by which
#: cells are split at a time (64 cells of each).
LEAF, DIGITS, STEP = 32, 27, 3
#: Bounds are compared with this much room, as distances are rounded.
ROOM = 1e-9


def _apart(lat: Column, lon: Column, to_lat: Column, to_lon: Column, shrink2: Column) -> Column:
    return F.sqrt((lat - to_lat) * (lat - to_lat) + (lon - to_lon) * (lon - to_lon) * shrink2) * KM_PER_DEGREE


def _cells(points: DataFrame, leaf: int) -> list[DataFrame]:
    """Per depth the split cells as (py, px, cells): the cells inside with their bounds and number of
    points; those with few points also carry them. A depth splits only what the one before left too full."""
    depths, rows = [], points
    for depth in range(1, DIGITS // STEP + 1):
        open_bits = DIGITS - STEP * depth
        placed = rows.select("*", F.shiftright("iy", open_bits).alias("cy"), F.shiftright("ix", open_bits).alias("cx"))
        last = open_bits == 0
        counted = materialized(placed.groupBy("cy", "cx").agg(
            F.count("*").alias("n"), F.min("lat").alias("south"), F.max("lat").alias("north"),
            F.min("lon").alias("west"), F.max("lon").alias("east")))
        full = counted.where((F.col("n") > leaf) & F.lit(not last))
        small = counted.where((F.col("n") <= leaf) | F.lit(last)).select("cy", "cx", F.lit(True).alias("_small"))
        inside = (lookup(placed, small, ["cy", "cx"]).where("_small").groupBy("cy", "cx")
                  .agg(F.collect_list(F.struct("lat", "lon", "key")).alias("points")))
        cell = F.struct("cy", "cx", "south", "north", "west", "east", "points")
        depths.append(materialized(
            counted.join(inside, ["cy", "cx"], "left")
            .groupBy(F.shiftright("cy", STEP).alias("py"), F.shiftright("cx", STEP).alias("px"))
            .agg(F.collect_list(cell).alias("cells"))))
        if last or full.isEmpty():
            return depths
        rows = materialized(lookup(placed, full.select("cy", "cx", F.lit(True).alias("_full")), ["cy", "cx"])
                            .where("_full").select(*points.columns))
    return depths


def with_nearest(places: DataFrame, points: DataFrame, key: str, lat: str = "lat", lon: str = "lon",
                 point_lat: str = "lat", point_lon: str = "lon", out: str = "nearest", km: str = "distance_km",
                 leaf: int = LEAF) -> DataFrame:
    """Adds the ``key`` of the nearest of ``points`` and its distance, on a plane scaled at the points' mean latitude.

    Exact at any number of points. These are cut into cells, full cells again and again, so that crowded
    regions get finer ones. Every place starts at the whole map and keeps the cells that can still
    hold its nearest point: those no farther at their nearest corner than the closest cell is at its
    farthest. Cells meet places by equi-joins, in which a place has a few cells at each depth.

    Equal distances go to the smaller key. Points without a coordinate or key are left out; a place
    without a coordinate, and every place where there are no points, gets nulls. Points at one spot count
    as one, places at one spot are looked up once.
    """
    spots = (points.where(known(point_lat).isNotNull() & known(point_lon).isNotNull() & F.col(key).isNotNull())
             .groupBy(F.col(point_lat).cast("double").alias("lat"), F.col(point_lon).cast("double").alias("lon"))
             .agg(F.min(key).alias("key"), F.count("*").alias("n")))
    frame = spots.agg(
        F.struct(F.min("lat").alias("south"), F.min("lon").alias("west"),
                 F.greatest(F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon")).alias("side"),
                 F.pow(F.cos(F.radians(F.sum(F.col("lat") * F.col("n")) / F.sum("n"))), 2).alias("shrink2")).alias("f"))
    frame = materialized(frame)
    side = F.greatest(F.col("f.side"), F.lit(1e-300))

    def digit(value: Column) -> Column:
        return F.least((value / side * (1 << DIGITS)).cast("long"), F.lit((1 << DIGITS) - 1))

    spots = materialized(spots.withColumn("f", frame.scalar()).select(
        "lat", "lon", "key", digit(F.col("lat") - F.col("f.south")).alias("iy"),
        digit(F.col("lon") - F.col("f.west")).alias("ix")))

    wanted = places.where(known(lat).isNotNull() & known(lon).isNotNull()).select(
        F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x")).distinct()
    start = wanted.withColumn("f", frame.scalar()).select("y", "x", F.col("f.shrink2").alias("shrink2"))
    y, x, shrink2 = F.col("y"), F.col("x"), F.col("shrink2")
    # Of one place: no group is larger than the cells that are still possible for it.
    place = Window.partitionBy("y", "x")
    none = F.lit(0).cast("long")
    open_cells, found = start.withColumns({"py": none, "px": none, "best": F.lit(float("inf"))}), []
    for cells in _cells(spots, leaf):
        met = lookup(open_cells, cells, ["py", "px"], spread="x").select(
            "y", "x", "shrink2", "best", F.explode("cells").alias("c"))
        near_y, near_x = (F.greatest(F.least(v, F.col(f"c.{b}")), F.col(f"c.{a}"))
                          for v, a, b in ((y, "south", "north"), (x, "west", "east")))
        far_y, far_x = (F.when(F.abs(v - F.col(f"c.{a}")) > F.abs(v - F.col(f"c.{b}")), F.col(f"c.{a}"))
                        .otherwise(F.col(f"c.{b}")) for v, a, b in ((y, "south", "north"), (x, "west", "east")))
        bounded = met.withColumns({"near": _apart(y, x, near_y, near_x, shrink2),
                                   "far": _apart(y, x, far_y, far_x, shrink2)})
        # The bound of earlier depths still holds, though its cell may have been closed there.
        bounded = bounded.withColumn("best", F.least("best", F.min("far").over(place)))
        left = materialized(bounded.where(F.col("near") <= F.col("best") * (1 + ROOM)).select(
            "y", "x", "shrink2", "best", "c.cy", "c.cx", "c.points"))
        at = F.transform("points", lambda p: F.struct(
            _apart(y, x, p["lat"], p["lon"], shrink2).alias("km"), p["key"].alias("key")))
        found.append(left.where("points is not null").select("y", "x", F.array_min(at).alias("hit")))
        open_cells = left.where("points is null").select(
            "y", "x", "shrink2", "best", F.col("cy").alias("py"), F.col("cx").alias("px"))
    hits = reduce(DataFrame.unionAll, found).groupBy(F.col("y").alias("_y"), F.col("x").alias("_x")).agg(
        F.min("hit").alias("_hit"))
    asked = places.withColumns({"_y": F.col(lat).cast("double"), "_x": F.col(lon).cast("double")})
    return lookup(asked, hits, ["_y", "_x"]).select(
        *places.columns, F.col("_hit.key").alias(out), F.col("_hit.km").alias(km))
