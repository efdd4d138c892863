"""Look-ups, nearest points, weather, keyword match."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from taktspur.functions.text import STOPWORDS
from taktspur.operators import joins as jn
from taktspur.operators.names import match_questions
from taktspur.operators.nearest import with_nearest
from taktspur.plans import fact_sheet, prepared, station_map

from .registry import query, r, rounded
from .tables import (clean_events, feature_events, prepared_events, sql, sql_more, stations,
                     stations_raw, stop_events, table)


@query("nearest_point", sql("near", f"""
    SELECT number, best.abbr AS nearest_weather_abbr, {r("best.km AS weather_distance_km")} FROM near"""))
def nearest_point(spark, sf_dir):
    return rounded(jn.with_nearest_point(stations(spark, sf_dir)).select(
        "number", "nearest_weather_abbr", "weather_distance_km"))


_SPOT = {"s_lat": "45.8{d} + (s_suppkey * 53 % 211) / 100{d} + s_suppkey / 1000000{d}",
         "s_lon": "6.0{d} + (s_suppkey * 17 % 449) / 100{d}"}
_SPOT_SQL = ", ".join(f"{re.sub(r'([0-9.]+){d}', r'cast(' + chr(92) + '1 AS double)', e)} AS {n}" for n, e in _SPOT.items())


@query("nearest_of_table", sql_more("stations_raw", f"""points AS (SELECT s_suppkey, {_SPOT_SQL} FROM supplier),
    apart AS (
        SELECT number, s_suppkey, sqrt((lat - s_lat) * (lat - s_lat) + (lon - s_lon) * (lon - s_lon)
               * pow(cos(radians((SELECT avg(s_lat) FROM points))), 2)) * 111.0 AS km FROM stations_raw, points)""", f"""
    SELECT number, s_suppkey AS nearest, {r("km AS distance_km")} FROM apart
    QUALIFY row_number() OVER (PARTITION BY number ORDER BY km, s_suppkey) = 1"""))
def nearest_of_table(spark, sf_dir):
    """The nearest supplier of every customer."""
    points = table(spark, sf_dir, "supplier").select(
        "s_suppkey", *[F.expr(e.format(d="D")).alias(n) for n, e in _SPOT.items()])
    places = stations_raw(spark, sf_dir).select("number", "lat", "lon")
    near = with_nearest(places, points, "s_suppkey", point_lat="s_lat", point_lon="s_lon")
    return rounded(near.select("number", "nearest", "distance_km"))


@query("station_points", sql("near", """
    SELECT best.abbr AS nearest_weather_abbr, count(*) AS n_stations FROM near GROUP BY 1"""))
def station_points(spark, sf_dir):
    return prepared.station_points(stations(spark, sf_dir))


@query("weather_join", sql("prep", f"""
    SELECT fahrt_bezeichner, weather_abbr, delay_ts_hour,
           {r('temperatur_c', 'niederschlag_mm', 'wind_ms', 'feuchte_pct', 'sonne_min')} FROM prep"""))
def weather_join(spark, sf_dir):
    return rounded(prepared_events(spark, sf_dir).select(
        "fahrt_bezeichner", "weather_abbr", "delay_ts_hour", "temperatur_c", "niederschlag_mm",
        "wind_ms", "feuchte_pct", "sonne_min"))


@query("prepared", sql("prep", f"""
    SELECT betriebstag, fahrt_bezeichner, linien_text, verkehrsmittel_text, bpuic, haltestellen_name,
           cast(NULL AS varchar) AS sloid, ankunftszeit, an_prognose, an_prognose_status, abfahrtszeit,
           ab_prognose, 'REAL' AS ab_prognose_status, {r('delay_arr_sec', 'delay_dep_sec')}, faellt_aus_tf,
           false AS durchfahrt_tf, hour, weekday_num, weekday, is_weekend, is_rush_hour, weather_abbr,
           delay_ts_hour, {r('temperatur_c', 'niederschlag_mm', 'wind_ms', 'feuchte_pct', 'sonne_min')},
           delay_class, is_late_3min FROM prep"""))
def prepared_table(spark, sf_dir):
    """The whole prepared table, all 31 columns."""
    return rounded(prepared_events(spark, sf_dir))


@query("station_lookup", sql("clean stations", """
    SELECT fahrt_bezeichner, bpuic, designationofficial AS station, cantonabbreviation AS canton
    FROM clean LEFT JOIN stations ON bpuic = number"""))
def station_lookup(spark, sf_dir):
    found = jn.station_lookup(clean_events(spark, sf_dir), stations(spark, sf_dir),
                              {"designationofficial": "station", "cantonabbreviation": "canton"})
    return found.select("fahrt_bezeichner", "bpuic", "station", "canton")


@query("match_rate", sql("clean stations", f"""
    SELECT count(number) AS n_matched, count(*) AS n_rows, {r("100.0 * count(number) / count(*) AS pct_matched")}
    FROM clean LEFT JOIN stations ON bpuic = number"""))
def match_rate(spark, sf_dir):
    found = jn.station_lookup(clean_events(spark, sf_dir), stations(spark, sf_dir), {"sloid": "station"})
    return rounded(jn.match_rate(found, "station"))


_STATION_TABLE = """
    agg AS (SELECT bpuic, count(*) AS n_halte, round_even(avg(delay_arr_sec), 1) AS mean_delay,
                   round_even(100.0 * count(*) FILTER (is_late_3min) / count(*), 1) AS pct_late
            FROM feat GROUP BY bpuic HAVING count(*) >= 30),
    st AS (SELECT bpuic, n_halte, mean_delay, pct_late, designationofficial, lat, lon, cantonabbreviation
           FROM agg JOIN stations ON bpuic = number)"""


def _station_table(spark, sf_dir):
    return station_map.station_table(feature_events(spark, sf_dir), stations(spark, sf_dir), min_n=30)


@query("station_map_table", sql_more("feat stations", _STATION_TABLE, f"""
    SELECT bpuic, n_halte, {r('mean_delay', 'pct_late')}, designationofficial, {r('lat', 'lon')},
           cantonabbreviation FROM st"""))
def station_map_table(spark, sf_dir):
    return rounded(_station_table(spark, sf_dir))


@query("hotspots", sql_more("feat stations", _STATION_TABLE, f"""
    SELECT bpuic, designationofficial, cantonabbreviation, n_halte, {r('mean_delay', 'pct_late')}
    FROM (SELECT * FROM st WHERE mean_delay >= 100 ORDER BY mean_delay DESC, bpuic LIMIT 20)"""))
def hotspots(spark, sf_dir):
    top = station_map.top_hotspots(_station_table(spark, sf_dir), 100)
    return rounded(top.select("bpuic", "designationofficial", "cantonabbreviation", "n_halte",
                              "mean_delay", "pct_late"))


@query("map_scale", sql_more("feat stations", _STATION_TABLE + """,
    q AS (SELECT quantile_cont(mean_delay, 0.05) AS low, quantile_cont(mean_delay, 0.95) AS hi0 FROM st),
    e AS (SELECT low, CASE WHEN hi0 <= low THEN low + 1 ELSE hi0 END AS high FROM q)""", f"""
    SELECT bpuic, {r("low AS scale_low", "high AS scale_high",
                     "greatest(0, least(1, (mean_delay - low) / (high - low))) AS scale_position",
                     "4 + least(n_halte / 500.0, 9) AS radius")}
    FROM st, e WHERE mean_delay >= 50"""))
def map_scale(spark, sf_dir):
    scaled = station_map.map_scale(_station_table(spark, sf_dir), 50)
    return rounded(scaled.select("bpuic", "scale_low", "scale_high", "scale_position", "radius"))


QUESTION = "Wie zuverlässig ist der Halt beim Widget oder Bolt am Wochenende wirklich?"


@query("keyword_match", f"""
    WITH s AS (
        SELECT p_name, l_quantity * 20 - 300 AS delay FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT p_name AS haltestellen_name, count(*) AS n, {r("avg(delay) AS mean_delay")} FROM s
    WHERE contains(lower(p_name), 'halt') OR contains(lower(p_name), 'beim')
       OR contains(lower(p_name), 'widget') OR contains(lower(p_name), 'bolt')
    GROUP BY p_name HAVING count(*) >= 30 ORDER BY n DESC, p_name LIMIT 8""")
def keyword_match(spark, sf_dir):
    """Part names that hold a word of the question; shipped parts stand for stops."""
    per_part = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), F.expr("l_quantity * 20 - 300").alias("delay_arr_sec"))
    named = jn.lookup(per_part, table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("haltestellen_name")), ["p_partkey"])
    return rounded(fact_sheet.keyword_stations(named, QUESTION))


_WORDS = "[a-zäöü]{4,}"
_SKIPPED = ", ".join(f"'{w}'" for w in STOPWORDS)


@query("question_names", f"""
    WITH names AS (
        SELECT name, count(*) AS n, avg(turn) AS mean_turn
        FROM (SELECT turn, unnest(regexp_extract_all(lower(text), '[a-zäöü]{{6,}}')) AS name
              FROM conversations WHERE role = 'assistant') GROUP BY name HAVING count(*) >= 2),
    asked AS (
        SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '{_WORDS}')) AS word
        FROM conversations WHERE role = 'user'),
    words AS (SELECT DISTINCT word FROM asked WHERE word NOT IN ({_SKIPPED})),
    held AS (SELECT word, name, n, mean_turn FROM words, names WHERE contains(name, word)),
    hits AS (SELECT DISTINCT conv_id, turn, name, n, mean_turn FROM asked JOIN held USING (word))
    SELECT conv_id, turn, name, n, {r("mean_turn")},
           row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, name) AS rank
    FROM hits QUALIFY rank <= 8""")
def question_names(spark, sf_dir):
    """For every user turn the names that hold one of its keywords; longer words of the answers are the names."""
    turns = table(spark, sf_dir, "conversations")
    spoken = turns.where("role = 'assistant'").select(
        "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zäöü]{6,}"), F.lit(0))).alias("name"))
    names = spoken.groupBy("name").agg(F.count("*").alias("n"), F.avg("turn").alias("mean_turn")).where("n >= 2")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    return rounded(match_questions(asked, names, ["conv_id", "turn"], name="name"))


@query("station_events_inner", sql("ev stations", f"""
    SELECT cantonabbreviation AS canton, count(*) AS n, {r("avg(delay_arr_sec) AS mean_delay")}
    FROM ev JOIN stations ON bpuic = number GROUP BY cantonabbreviation"""))
def station_events_inner(spark, sf_dir):
    """Events per canton; summed per station before the join."""
    per_station = stop_events(spark, sf_dir).groupBy("bpuic").agg(
        F.count("*").alias("n"), F.sum("delay_arr_sec").alias("total"))
    joined = per_station.join(stations(spark, sf_dir).select(
        F.col("number").alias("bpuic"), F.col("cantonabbreviation").alias("canton")), "bpuic")
    return rounded(joined.groupBy("canton").agg(
        F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean_delay")))
