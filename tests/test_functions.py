"""Column functions: buckets, flags, time features, nearest points, text."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from taktspur.functions import delay as dl, effect, text as tx, time as tm
from taktspur.operators import filters as fl, joins as jn
from taktspur.plans.prepared import with_features
from taktspur.sources.tables import optional_parquet
from taktspur.schemas import PREPARED

NAN, INF = float("nan"), float("inf")


def column(spark, values, kind, expr, name="v"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} {kind}")
    return [r[0] for r in df.select("i", expr.alias("out")).orderBy("i").select("out").collect()]


@pytest.mark.parametrize("values, label", [
    ([None, NAN, INF], "unbekannt"),
    ([0.0, 30.0, 59.9], "puenktlich_unter_1min"),
    ([60.0, 120.0, 179.9], "leicht_1_3min"),
    ([180.0, 299.9], "verspaetet_3_5min"),
    ([300.0, 599.9], "stark_5_10min"),
    ([600.0, 10000.0], "extrem_ueber_10min"),
    ([-5.0, -29.9, -30.0], "frueh_unter_30s"),
    ([-30.01, -300.0, -INF], "frueh_30+s"),
])
def test_delay_class(spark, values, label):
    assert column(spark, values, "double", dl.delay_class("v")) == [label] * len(values)


def test_buckets_have_no_gap_and_unique_labels():
    for (_, high, _), (low, _, _) in zip(dl.DELAY_BUCKETS, dl.DELAY_BUCKETS[1:]):
        assert high == low
    assert len(set(dl.DELAY_CLASSES)) == len(dl.DELAY_CLASSES) == 7


def test_late_flag(spark):
    values = [None, NAN, 0.0, 180.0, 180.01, 181.0, 3600.0]
    assert column(spark, values, "double", dl.late_flag("v")) == [False] * 4 + [True] * 3
    assert column(spark, [50.0, 20.0], "double", dl.late_flag("v", 30)) == [True, False]


def test_class_column_is_added_and_input_kept(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 200.0, 400.0, NAN, -50.0]], "delay_arr_sec double")
    out = df.withColumn("delay_class", dl.delay_class("delay_arr_sec"))
    assert "delay_class" not in df.columns and out.count() == 5
    assert [r.delay_class for r in out.collect()] == [
        "puenktlich_unter_1min", "verspaetet_3_5min", "stark_5_10min", "unbekannt", "frueh_30+s"]


@pytest.mark.parametrize("values, earliest, kept", [
    ([-173092.0, -601.0, -600.0, -300.0, 0.0, 4000.0], None, [-600.0, -300.0, 0.0, 4000.0]),
    ([14620.0, 7200.0, 100.0], None, [14620.0, 7200.0, 100.0]),
    ([-100.0, -50.0, 0.0], -60.0, [-50.0, 0.0]),
    ([None, NAN, 5.0], None, [5.0]),
])
def test_plausible(spark, values, earliest, kept):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, delay_arr_sec double")
    out = fl.plausible(df) if earliest is None else fl.plausible(df, earliest=earliest)
    assert [r.delay_arr_sec for r in out.orderBy("i").collect()] == kept
    assert df.count() == len(values)


def test_measured_needs_status_and_value(spark):
    df = spark.createDataFrame(
        [("REAL", 1.0), ("REAL", None), ("REAL", NAN), ("PROGNOSE", 1.0), (None, 1.0)],
        "an_prognose_status string, delay_arr_sec double")
    assert fl.measured(df).count() == 1
    row = fl.measured_share(df).first()
    assert (row.n_before, row.n_after, row.pct_kept) == (5, 1, 20.0)


def test_clip_keeps_null(spark):
    assert column(spark, [-100.0, 5.0, 900.0, None, NAN], "double", dl.clipped("v", -60.0, 600.0)) == [
        -60.0, 5.0, 600.0, None, None]


def test_time_features(spark):
    stamps = ["2026-04-13 08:30:00", "2026-04-18 14:00:00", "2026-04-15 12:00:00", "2026-04-13 17:30:00",
              "2026-04-18 08:00:00", "not-a-date"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "i int, s string")
    df = df.withColumn("ts", tm.parse_time("s"))
    rows = df.withColumns(tm.time_features("ts")).orderBy("i").collect()
    assert [r.hour for r in rows] == [8, 14, 12, 17, 8, None]
    assert [r.weekday_num for r in rows] == [0, 5, 2, 0, 5, None]
    assert [r.weekday for r in rows] == ["Mo", "Sa", "Mi", "Mo", "Sa", None]
    assert [r.is_weekend for r in rows] == [False, True, False, False, True, False]
    assert [r.is_rush_hour for r in rows] == [True, False, False, True, False, False]


def test_rush_hour_edges(spark):
    df = spark.createDataFrame([(h, dt.datetime(2026, 4, 13, h, 59)) for h in range(24)], "h int, ts timestamp_ntz")
    rows = df.withColumns(tm.time_features("ts")).where("is_rush_hour").collect()
    assert sorted(r.h for r in rows) == [6, 7, 8, 16, 17, 18]


def test_day_parts_are_closed_on_the_right(spark):
    hours = [0, 1, 6, 7, 12, 13, 18, 19, 23, None]
    assert column(spark, hours, "int", tm.day_part("v")) == [
        None, "Nacht", "Nacht", "Vormittag", "Vormittag", "Nachmittag", "Nachmittag", "Abend", "Abend", None]


def test_weekday_counts_from_sunday_in_the_sql_reports(spark):
    assert column(spark, [dt.date(2026, 4, 12), dt.date(2026, 4, 13)], "date", tm.weekday_from_sunday("v")) == [0, 1]


@pytest.mark.parametrize("zone", ["UTC", "Europe/Zurich", "America/New_York"])
def test_naive_times_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 02:30 does not exist in Zurich on that night
        df = spark.createDataFrame([("29.03.2026 02:30:10", "29.03.2026 03:30:12")], "a string, b string")
        row = df.select(tm.parse_time("a").alias("a"), tm.parse_time("b").alias("b")).select(
            F.hour("a").alias("hour"), tm.hour_floor("a").alias("floor"),
            dl.seconds_between("a", "b").alias("gap")).first()
        assert (row.hour, row.floor, row.gap) == (2, dt.datetime(2026, 3, 29, 2), 3602.0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_parse_time_is_day_first_and_gives_null_for_nonsense(spark):
    values = ["05.04.2026 07:08:09", "05.04.2026 07:08", "05.04.2026", "2026-04-05 07:08:09", "31.02.2026", "", None]
    got = column(spark, values, "string", tm.parse_time("v"))
    assert got == [dt.datetime(2026, 4, 5, 7, 8, 9), dt.datetime(2026, 4, 5, 7, 8), dt.datetime(2026, 4, 5),
                   dt.datetime(2026, 4, 5, 7, 8, 9), None, None, None]


@pytest.mark.parametrize("lat, lon, abbr", [
    (47.378, 8.540, "SMA"), (46.948, 7.439, "BER"), (46.005, 8.951, "LUG")])
def test_nearest_point(spark, lat, lon, abbr):
    row = spark.createDataFrame([(lat, lon)], "lat double, lon double").select(
        jn.nearest_point("lat", "lon").alias("p")).first().p
    assert row.abbr == abbr and 0 <= row.km < 10
    if abbr == "SMA":
        assert row.km < 5


def test_nearest_point_against_brute_force(spark):
    import random
    rng = random.Random(7)
    spots = [(45.8 + 2 * rng.random(), 6 + 4.5 * rng.random()) for _ in range(300)]
    got = spark.createDataFrame(spots, "lat double, lon double").select(
        "lat", "lon", jn.nearest_point("lat", "lon").alias("p")).collect()
    points = jn.WEATHER_POINTS
    scale = math.cos(math.radians(sum(p[1] for p in points) / len(points)))
    for r in got:
        best = min((math.dist((r.lat, r.lon * scale), (a, o * scale)) * 111.0, n) for n, a, o in points)
        assert r.p.abbr == best[1] and r.p.km == pytest.approx(best[0], abs=1e-9)


def test_station_mapping_adds_columns(spark):
    df = spark.createDataFrame([("Zuerich HB", 47.378, 8.540), ("Bern HB", 46.948, 7.439), ("Nirgends", None, None)],
                               "name string, lat double, lon double")
    rows = {r.name: r for r in jn.with_nearest_point(df).collect()}
    assert rows["Zuerich HB"].nearest_weather_abbr == "SMA" and rows["Bern HB"].nearest_weather_abbr == "BER"
    assert rows["Bern HB"].weather_distance_km >= 0 and rows["Nirgends"].nearest_weather_abbr is None


def test_keywords(spark):
    asked = ["Wie pünktlich ist der Zug in Zürich und WINTERTHUR wirklich?", "S-Bahn nach Bern", "", None]
    assert column(spark, asked, "string", tx.keywords("v")) == [
        ["zürich", "winterthur"], ["nach", "bern"], [], None]


def test_contains_any_takes_words_literally(spark):
    names = ["Zürich HB", "Biel/Bienne", "St. Gallen", None]
    words = F.array(F.lit("zürich"), F.lit("st."))
    assert column(spark, names, "string", tx.contains_any("v", words)) == [True, False, True, False]


def test_swiss_number(spark):
    assert column(spark, [20444, 999, 1234567], "bigint", tx.swiss_number("v")) == ["20'444", "999", "1'234'567"]


@pytest.mark.parametrize("reply, expected", [
    ('Gern: {"primaere_ursache": "wetter_regen", "konfidenz": "hoch", "begruendung": "Regen"} Ende',
     ("wetter_regen", "hoch", "Regen")),
    ('{"konfidenz": "mittel"}', ("fehler", "mittel", "")),
    ('{}', ("fehler", "niedrig", "")),
    ("kein Objekt", ("parse_error", "niedrig", "JSON-Parse-Fehler")),
    ('} falsch {', ("parse_error", "niedrig", "JSON-Parse-Fehler")),
    ('{"a": 1} und {"b": 2}', ("parse_error", "niedrig", "JSON-Parse-Fehler")),
    ('{"a": 1}, {"b": 2}', ("parse_error", "niedrig", "JSON-Parse-Fehler")),
    (None, ("parse_error", "niedrig", "JSON-Parse-Fehler")),
    ('{\n "primaere_ursache": "frei erfunden",\n "begruendung": "x {y} z"\n}',
     ("frei erfunden", "niedrig", "x {y} z")),
])
def test_parsed_reply(spark, reply, expected):
    df = spark.createDataFrame([(reply,)], "reply string").select(
        *[c.alias(n) for n, c in tx.parsed_reply("reply").items()])
    assert tuple(df.first()) == expected


def test_marks_and_sizes(spark):
    assert column(spark, [0.0009, 0.001, 0.01, 0.05], "double", effect.stars("v")) == ["***", "**", "*", "n.s."]
    assert column(spark, [-0.19, 0.2, 0.5, -0.8], "double", effect.cohen_label("v")) == [
        "vernachlaessigbar", "klein", "mittel", "gross"]
    assert column(spark, [0.05, 0.06, 0.14], "double", effect.eta_label("v")) == ["klein", "mittel", "gross"]
    flags = effect.bonferroni_flags("v")
    assert column(spark, [0.0124, 0.0125, 0.04, 0.05], "double", flags["significant_at_bonferroni"]) == [
        True, False, False, False]
    assert column(spark, [0.04, 0.05], "double", flags["significant_at_005"]) == [True, False]


def test_optional_table_is_empty_when_absent(spark, tmp_path):
    df = optional_parquet(spark, str(tmp_path / "nothing"), PREPARED)
    assert df.schema == PREPARED and df.isEmpty()
    assert len(PREPARED) == 31


def test_features_without_time_count_as_workday(spark):
    df = spark.createDataFrame([(None, 200.0)], "ankunftszeit timestamp_ntz, delay_arr_sec double")
    row = with_features(df).first()
    assert (row.hour, row.is_weekend, row.is_rush_hour, row.is_late_3min) == (None, False, False, True)
