"""The railway tables, derived from the test tables in Spark and, in words of SQL, again.

An ``events`` row stands for a stop, its value for the delay; customers stand for
stations and nations for cantons; the events of a weather point and hour give its weather.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from taktspur.functions.time import hour_floor
from taktspur.operators.joins import WEATHER_POINTS
from taktspur.schemas import PREPARED
from taktspur.plans.prepared import cleaned, prepare, with_features
from taktspur.session import materialized, new_run_dir
from taktspur.sources.events import read_days, write_days


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumns({
        "k": F.regexp_extract("props", "([0-9]+)", 1).cast("int"),
        "delay_arr_sec": F.expr("value * 4 - 60 - CASE WHEN event_id % 20 = 0 THEN 700 ELSE 0 END"),
    }).select(
        "event_id",
        F.expr("cast(ts - interval 3 hours AS date)").alias("betriebstag"),
        F.col("event_id").cast("string").alias("fahrt_bezeichner"),
        F.expr("CASE WHEN k > 0 THEN concat('L', k) END").alias("linien_text"),
        F.expr("CASE WHEN k < 5 THEN concat(event_type, '_N') ELSE event_type END")
        .alias("verkehrsmittel_text"),
        F.col("user_id").alias("bpuic"),
        F.concat(F.lit("Halt "), F.col("user_id").cast("string")).alias("haltestellen_name"),
        F.lit(None).cast("string").alias("sloid"),
        F.col("ts").alias("ankunftszeit"),
        F.expr("timestampadd(MICROSECOND, cast(round(delay_arr_sec * 1000000) AS bigint), ts)")
        .alias("an_prognose"),
        F.expr("CASE WHEN event_type = 'error' THEN 'PROGNOSE' ELSE 'REAL' END")
        .alias("an_prognose_status"),
        F.expr("ts + interval 60 seconds").alias("abfahrtszeit"),
        F.expr("timestampadd(MICROSECOND, cast(round((delay_arr_sec + 90) * 1000000) AS bigint), ts)")
        .alias("ab_prognose"),
        F.lit("REAL").alias("ab_prognose_status"),
        "delay_arr_sec",
        F.expr("delay_arr_sec + 30").alias("delay_dep_sec"),
        F.expr("event_type = 'error'").alias("faellt_aus_tf"),
        F.lit(False).alias("durchfahrt_tf"),
        F.expr("CASE WHEN event_type = 'signup' THEN 'Bus' ELSE 'Zug' END").alias("produkt_id"),
        F.expr("CASE WHEN k < 50 THEN 'EINS' ELSE 'ZWEI' END").alias("betreiber_abk"),
    )


EV = """ev AS (
    SELECT event_id, cast(ts - interval 3 hours AS date) AS betriebstag,
           cast(event_id AS varchar) AS fahrt_bezeichner,
           CASE WHEN k > 0 THEN concat('L', k) END AS linien_text,
           CASE WHEN k < 5 THEN concat(event_type, '_N') ELSE event_type END AS verkehrsmittel_text,
           user_id AS bpuic, concat('Halt ', user_id) AS haltestellen_name, ts AS ankunftszeit,
           ts + to_microseconds(cast(round(delay_arr_sec * 1000000) AS bigint)) AS an_prognose,
           CASE WHEN event_type = 'error' THEN 'PROGNOSE' ELSE 'REAL' END AS an_prognose_status,
           ts + interval 60 seconds AS abfahrtszeit,
           ts + to_microseconds(cast(round((delay_arr_sec + 90) * 1000000) AS bigint)) AS ab_prognose,
           delay_arr_sec, delay_arr_sec + 30 AS delay_dep_sec, event_type = 'error' AS faellt_aus_tf,
           CASE WHEN event_type = 'signup' THEN 'Bus' ELSE 'Zug' END AS produkt_id,
           CASE WHEN k < 50 THEN 'EINS' ELSE 'ZWEI' END AS betreiber_abk
    FROM (SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k,
                 value * 4 - 60 - CASE WHEN event_id % 20 = 0 THEN 700 ELSE 0 END AS delay_arr_sec
          FROM events))"""


def stations_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station records before the filter: transport, validity and position as text."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").join(nation, "c_nationkey").select(
        F.col("c_custkey").alias("number"),
        F.concat(F.lit("ch:"), F.col("c_custkey").cast("string")).alias("sloid"),
        F.col("c_name").alias("designationofficial"),
        F.col("c_mktsegment").alias("abbreviation"),
        F.col("n_name").alias("cantonabbreviation"),
        F.col("n_name").alias("cantonname"),
        F.expr("45.8D + (c_custkey * 37 % 200) / 100D").alias("lat"),
        F.expr("6.0D + (c_custkey * 91 % 450) / 100D").alias("lon"),
        F.expr("""CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Bus|Train' WHEN 'MACHINERY' THEN 'TRAIN'
                  WHEN 'FURNITURE' THEN NULL ELSE 'BUS' END""").alias("meansoftransport"),
        F.expr("c_acctbal >= 0").alias("hasgeolocation"),
        F.expr("CASE WHEN c_acctbal < 9000 THEN '9999-12-31' ELSE '2024-12-31' END").alias("validto"),
    ).withColumn("geopos", F.format_string("%.2f, %.2f", "lat", "lon"))


STATIONS_RAW = """stations_raw AS (
    SELECT c_custkey AS number, concat('ch:', c_custkey) AS sloid, c_name AS designationofficial,
           c_mktsegment AS abbreviation, n_name AS cantonabbreviation, n_name AS cantonname,
           cast(45.8 AS double) + (c_custkey * 37 % 200) / cast(100 AS double) AS lat,
           cast(6.0 AS double) + (c_custkey * 91 % 450) / cast(100 AS double) AS lon,
           CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Bus|Train' WHEN 'MACHINERY' THEN 'TRAIN'
                WHEN 'FURNITURE' THEN NULL ELSE 'BUS' END AS meansoftransport,
           c_acctbal >= 0 AS hasgeolocation,
           CASE WHEN c_acctbal < 9000 THEN '9999-12-31' ELSE '2024-12-31' END AS validto
    FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations with coordinates; events at the others find no station."""
    return stations_raw(spark, sf_dir).where("hasgeolocation").drop("hasgeolocation", "validto", "geopos")


STATIONS = STATIONS_RAW + """,
stations AS (SELECT * FROM stations_raw WHERE hasgeolocation)"""


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly measures per weather point, stored once as the railway's weather table is."""
    abbr = F.get(F.array(*[F.lit(p[0]) for p in WEATHER_POINTS]), (F.col("user_id") % 15).cast("int"))

    def of(kind: str):
        return F.when(F.col("event_type") == kind, F.col("value"))

    hourly = table(spark, sf_dir, "events").groupBy(
        abbr.alias("station_abbr"), hour_floor("ts").alias("reference_timestamp")
    ).agg(
        F.avg(of("view")).alias("tre200h0"),
        # Summed as decimals, so that the order of summing cannot show.
        F.coalesce(F.sum(of("click").cast("decimal(18,2)")).cast("double"), F.lit(0.0)).alias("rre150h0"),
        F.avg(of("purchase")).alias("fkl010h0"),
        F.avg(of("signup")).alias("ure200h0"),
        F.count(of("error")).cast("double").alias("sre000h0"),
    )
    return materialized(hourly)


_ABBRS = ", ".join(f"'{p[0]}'" for p in WEATHER_POINTS)
WEATHER = f"""weather AS (
    SELECT [{_ABBRS}][cast(user_id % 15 AS int) + 1] AS station_abbr,
           date_trunc('hour', ts) AS reference_timestamp,
           avg(value) FILTER (event_type = 'view') AS tre200h0,
           coalesce(cast(sum(cast(value AS decimal(18, 2))) FILTER (event_type = 'click') AS double), 0.0) AS rre150h0,
           avg(value) FILTER (event_type = 'purchase') AS fkl010h0,
           avg(value) FILTER (event_type = 'signup') AS ure200h0,
           cast(count(*) FILTER (event_type = 'error') AS double) AS sre000h0
    FROM events GROUP BY 1, 2)"""

CLEAN = "clean AS (SELECT * FROM ev WHERE an_prognose_status = 'REAL' AND delay_arr_sec >= -600)"

CLASS_SQL = """CASE WHEN delay_arr_sec < -30 THEN 'frueh_30+s' WHEN delay_arr_sec < 0 THEN 'frueh_unter_30s'
    WHEN delay_arr_sec < 60 THEN 'puenktlich_unter_1min' WHEN delay_arr_sec < 180 THEN 'leicht_1_3min'
    WHEN delay_arr_sec < 300 THEN 'verspaetet_3_5min' WHEN delay_arr_sec < 600 THEN 'stark_5_10min'
    WHEN delay_arr_sec >= 600 THEN 'extrem_ueber_10min' ELSE 'unbekannt' END"""

FEATURE_SQL = f"""hour(ankunftszeit) AS hour, isodow(ankunftszeit) - 1 AS weekday_num,
    ['Mo', 'Di', 'Mi', 'Do', 'Fr', 'Sa', 'So'][cast(isodow(ankunftszeit) AS int)] AS weekday,
    isodow(ankunftszeit) >= 6 AS is_weekend,
    isodow(ankunftszeit) < 6 AND hour(ankunftszeit) IN (6, 7, 8, 16, 17, 18) AS is_rush_hour,
    {CLASS_SQL} AS delay_class, delay_arr_sec > 180 AS is_late_3min"""

FEAT = f"feat AS (SELECT *, {FEATURE_SQL} FROM clean)"

_LAT0 = sum(p[1] for p in WEATHER_POINTS) / len(WEATHER_POINTS)
_VALUES = ", ".join(f"('{a}', {lat}, {lon})" for a, lat, lon in WEATHER_POINTS)
NEAR = f"""near AS (
    SELECT number, min(struct_pack(km := sqrt((lat - p_lat) * (lat - p_lat)
             + (lon - p_lon) * (lon - p_lon) * pow(cos(radians({_LAT0!r})), 2)) * 111.0, abbr := abbr)) AS best
    FROM stations, (VALUES {_VALUES}) AS p(abbr, p_lat, p_lon) GROUP BY number)"""

PREP = """prep AS (
    SELECT f.*, near.best.abbr AS weather_abbr, date_trunc('hour', ankunftszeit) AS delay_ts_hour,
           tre200h0 AS temperatur_c, rre150h0 AS niederschlag_mm, fkl010h0 AS wind_ms,
           ure200h0 AS feuchte_pct, sre000h0 AS sonne_min
    FROM feat f LEFT JOIN near ON f.bpuic = near.number
    LEFT JOIN weather w ON w.station_abbr = near.best.abbr
         AND w.reference_timestamp = date_trunc('hour', ankunftszeit))"""

_ORDER = {"ev": [EV], "clean": [EV, CLEAN], "feat": [EV, CLEAN, FEAT], "stations_raw": [STATIONS_RAW],
          "stations": [STATIONS], "weather": [WEATHER], "near": [STATIONS, NEAR],
          "prep": [EV, CLEAN, FEAT, STATIONS, NEAR, WEATHER, PREP]}


def sql(needs: str, body: str) -> str:
    """The body with the derived tables it names in front."""
    ctes: list[str] = []
    for name in needs.split():
        ctes += [c for c in _ORDER[name] if c not in ctes]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def sql_more(needs: str, more: str, body: str) -> str:
    """The same with further derived tables after those."""
    return sql(needs, "").rstrip() + ",\n" + more + "\n" + body


def clean_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(stop_events(spark, sf_dir))


def feature_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned events with time and class columns; no join."""
    return with_features(clean_events(spark, sf_dir))


def prepared_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(stop_events(spark, sf_dir), stations(spark, sf_dir), weather(spark, sf_dir))


def stored_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared table written by operating day and read back, as the reports use it."""
    path = new_run_dir(spark, "prepared")
    write_days(prepared_events(spark, sf_dir), path)
    return read_days(spark, path, PREPARED)


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large table: line items with a delay and the ship day; no time of day."""
    return table(spark, sf_dir, "lineitem").select(
        F.expr("l_quantity * 20 - 300").alias("delay_arr_sec"),
        F.col("l_shipdate").cast("date").alias("betriebstag"),
        F.col("l_returnflag").alias("verkehrsmittel_text"),
        F.col("l_suppkey").alias("bpuic"),
        F.col("l_partkey").alias("part"),
        F.expr("l_quantity * 20 - 300 > 180").alias("is_late_3min"))


SHIP = """ship AS (
    SELECT l_quantity * 20 - 300 AS delay_arr_sec, cast(l_shipdate AS date) AS betriebstag,
           l_returnflag AS verkehrsmittel_text, l_suppkey AS bpuic, l_partkey AS part,
           l_quantity * 20 - 300 > 180 AS is_late_3min
    FROM lineitem)"""
_ORDER["ship"] = [SHIP]
