"""Composed tables: prepared rows, station map, day context, labels, fact sheet, SQL reports."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from query_set import tables as stand_in
from taktspur.operators import grouped as gr, quality as qu
from taktspur.plans import day_labels as dlb, fact_sheet, sql_reports, station_map
from taktspur.plans.prepared import prepare
from taktspur.schemas import EVENTS, PREPARED, STATIONS, WEATHER
from taktspur.sources.tables import conform, empty_table


def events(spark, rows):
    base = {"betriebstag": dt.date(2026, 4, 13), "bpuic": 1, "haltestellen_name": "A", "an_prognose_status": "REAL",
            "ankunftszeit": dt.datetime(2026, 4, 13, 8, 30), "delay_arr_sec": 10.0, "delay_dep_sec": float("nan")}
    full = [{**dict.fromkeys(EVENTS.fieldNames()), **base, **row} for row in rows]
    return spark.createDataFrame([tuple(r[c] for c in EVENTS.fieldNames()) for r in full], EVENTS)


def stations(spark):
    rows = [(1, 47.378, 8.54, "ZH"), (1, 47.378, 8.54, "ZH"), (2, 46.948, 7.439, "BE")]
    return conform(spark.createDataFrame(rows, "number bigint, lat double, lon double, cantonabbreviation string"), STATIONS)


def weather(spark):
    rows = [("SMA", dt.datetime(2026, 4, 13, 8), 5.0), ("SMA", None, 9.0), ("BER", dt.datetime(2026, 4, 13, 9), 6.0)]
    return conform(spark.createDataFrame(rows, "station_abbr string, reference_timestamp timestamp_ntz, tre200h0 double"), WEATHER)


def test_prepare(spark):
    df = events(spark, [
        {"fahrt_bezeichner": "hit"}, {"fahrt_bezeichner": "no station", "bpuic": 99},
        {"fahrt_bezeichner": "null station", "bpuic": None}, {"fahrt_bezeichner": "no hour", "bpuic": 2},
        {"fahrt_bezeichner": "no time", "ankunftszeit": None}, {"fahrt_bezeichner": "edge", "delay_arr_sec": -600.0},
        {"fahrt_bezeichner": "early", "delay_arr_sec": -600.5}, {"fahrt_bezeichner": "nan", "delay_arr_sec": float("nan")},
        {"fahrt_bezeichner": "guess", "an_prognose_status": "PROGNOSE"}])
    out = prepare(df, stations(spark), weather(spark))
    assert out.schema.names == PREPARED.names and [f.dataType for f in out.schema] == [f.dataType for f in PREPARED]
    rows = {r.fahrt_bezeichner: r for r in out.collect()}
    assert set(rows) == {"hit", "no station", "null station", "no hour", "no time", "edge"}
    assert (rows["hit"].weather_abbr, rows["hit"].temperatur_c, rows["hit"].delay_dep_sec) == ("SMA", 5.0, None)
    assert rows["no station"].weather_abbr is None and rows["null station"].temperatur_c is None
    assert (rows["no hour"].weather_abbr, rows["no hour"].temperatur_c) == ("BER", None)
    assert rows["no time"].temperatur_c is None and rows["no time"].is_weekend is False
    shifted = prepare(df, stations(spark), weather(spark), shift_hours=-1)
    assert {r.fahrt_bezeichner: r.temperatur_c for r in shifted.collect()}["no hour"] == 6.0


def test_prepare_without_any_weather(spark):
    out = prepare(events(spark, [{}]), stations(spark), empty_table(spark, WEATHER))
    assert out.first().temperatur_c is None


@pytest.fixture(scope="module")
def prepared(spark, sf_dir):
    return stand_in.prepared_events(spark, sf_dir).cache()


def test_station_map(spark, prepared):
    table = station_map.station_table(prepared.withColumn("bpuic", F.lit(1)), stations(spark).dropDuplicates(["number"]), min_n=1)
    assert table.count() == 1
    means = spark.createDataFrame([(1, -5.0, 600), (2, 0.0, 10), (3, 20.0, 10), (4, 20.1, 9000)],
                                  "bpuic int, mean_delay double, n_halte int")
    assert station_map.hotspots(means, 0).count() == 4 and station_map.hotspots(means, 20).count() == 2
    scaled = {r.bpuic: r for r in station_map.map_scale(means, 20).collect()}
    assert set(scaled) == {3, 4} and scaled[4].radius == 13 and scaled[3].radius == 4.02
    assert all(0 <= r.scale_position <= 1 for r in scaled.values())
    one = station_map.map_scale(means.where("bpuic = 2")).first()
    assert one.scale_high == one.scale_low + 1


def test_regions_empty_means_all(spark):
    df = events(spark, [{"bpuic": 1}, {"bpuic": 2}, {"bpuic": None}])
    from taktspur.operators.filters import in_regions
    assert in_regions(df, stations(spark), []).count() == 3
    assert in_regions(df, stations(spark), ["ZH"]).count() == 1


def test_day_context_against_pandas(prepared):
    pdf = prepared.toPandas()
    rows = {r.betriebstag: r for r in dlb.day_context(prepared, min_n=2, k=3).collect()}
    assert set(rows) == set(pdf.betriebstag)
    for day, part in pdf.groupby("betriebstag"):
        r = rows[day]
        assert r.n_halte == len(part) and r.mean_delay == pytest.approx(part.delay_arr_sec.mean())
        assert r.weekday == part.sort_values("ankunftszeit").weekday.iloc[0]
        top = part.groupby("haltestellen_name").delay_arr_sec.agg(["mean", "count"]).query("count >= 2")
        top = top.reset_index().sort_values(["mean", "haltestellen_name"], ascending=[False, True]).head(3)
        assert [s.name for s in r.top_stations] == top.haltestellen_name.tolist()
        assert [s.n_halte for s in r.top_stations] == top["count"].tolist()
        evening = part.delay_arr_sec[part.hour > 18]
        assert (r.by_daytime.Abend is None) if evening.empty else r.by_daytime.Abend == pytest.approx(evening.mean(), abs=0.51)


def test_doubled_weather_hours_do_not_double_events(spark):
    from taktspur.operators.joins import with_weather
    hour = dt.datetime(2026, 4, 13, 8)
    hourly = spark.createDataFrame([("SMA", hour, 4.0), ("SMA", hour, 3.0), ("BER", hour, 9.0)],
                                   "weather_abbr string, delay_ts_hour timestamp, temperatur_c double")
    rows = spark.createDataFrame([(1, "SMA", hour), (2, "BER", hour), (3, None, hour)],
                                 "id int, weather_abbr string, delay_ts_hour timestamp")
    got = with_weather(rows, hourly.unionAll(hourly)).orderBy("id").collect()
    assert [(r.id, r.temperatur_c) for r in got] == [(1, 3.0), (2, 9.0), (3, None)]


def test_days_are_labelled_and_cost_is_summed(prepared):
    def client(rules, prompt):
        assert "primaere_ursache" in rules
        if "(Mo)" in prompt:
            return "keine Antwort", 10, 1
        return 'Text {"primaere_ursache": "wetter_regen", "konfidenz": "hoch", "begruendung": "x"} Ende', 1000, 200

    context = dlb.worst_day_context(prepared, k_days=10, min_n=1)
    labelled = dlb.classify_days(context, client).collect()
    assert len(labelled) == 10
    for r in labelled:
        monday = r.wochentag == "Mo"
        assert r.llm_ursache == ("parse_error" if monday else "wetter_regen")
        assert r.cost == pytest.approx((10 * 3 + 15) / 1e6 if monday else (1000 * 3 + 200 * 15) / 1e6)
    total = dlb.total_cost(dlb.classify_days(context, client)).first()
    assert total.n_calls == 10 and total.cost == pytest.approx(sum(r.cost for r in labelled))


def test_each_day_is_asked_once(prepared, tmp_path):
    log = str(tmp_path / "calls")

    def client(rules, prompt):
        with open(log, "a") as f:
            f.write("x\n")
        return "{}", 1, 1

    labelled = dlb.classify_days(dlb.worst_day_context(prepared, k_days=4, min_n=1), client)
    assert labelled.count() == 4 and dlb.total_cost(labelled).first().n_calls == 4 and len(labelled.collect()) == 4
    with open(log) as f:
        assert len(f.readlines()) == 4


def test_answers_outlive_failures_and_runs(prepared, tmp_path, monkeypatch):
    log, store = str(tmp_path / "calls"), str(tmp_path / "answers")
    context = dlb.worst_day_context(prepared, k_days=8, min_n=1)
    bad = str(dlb.prompt_rows(context).agg(F.max("betriebstag")).first()[0])

    def client_that(ends):
        def client(rules, prompt):
            if ends and f"Tages {bad}" in prompt:
                ends()
            with open(log, "a") as f:
                f.write(prompt[-400:].replace("\n", " ") + "\n")
            return "{}", 1, 1
        return client

    def fail():
        raise ValueError("no connection")

    def calls():
        with open(log) as f:
            return f.readlines()

    with pytest.raises(RuntimeError, match="1 of 8 requests failed .*no connection"):
        dlb.classify_days(context, client_that(fail), answers=store)
    assert len(calls()) == 7
    assert dlb.classify_days(context, client_that(None), answers=store).count() == 8
    assert len(calls()) == len(set(calls())) == 8
    # More days later: only the new ones are asked. Other rules are other requests.
    assert dlb.classify_days(dlb.worst_day_context(prepared, k_days=10, min_n=1), client_that(None), answers=store).count() == 10
    assert len(set(calls())) == len(calls()) == 10
    dlb.classify_days(context, client_that(None), rules="other rules", answers=store)
    assert len(calls()) == 18


def test_answers_before_a_lost_worker_are_kept(prepared, tmp_path, monkeypatch):
    log, store = str(tmp_path / "calls"), str(tmp_path / "answers")
    monkeypatch.setattr(dlb, "WAVE", 3)
    monkeypatch.setattr(dlb, "PER_TASK", 1)
    context = dlb.worst_day_context(prepared, k_days=8, min_n=1)

    def client(rules, prompt):
        import os
        with open(log, "a") as f:
            f.write(prompt + "\n=====\n")
        with open(log) as f:
            done = f.read().count("=====")
        if done == 5 and not os.path.exists(log + ".lost"):
            open(log + ".lost", "w").close()
            os._exit(1)
        return "{}", 1, 1

    with pytest.raises(Exception):
        dlb.classify_days(context, client, answers=store).collect()
    assert dlb.classify_days(context, client, answers=store).count() == 8
    with open(log) as f:
        # The three answers of the first wave were kept; only what that wave left open was asked.
        assert f.read().count("=====") <= 8 + 3


def test_prompt_holds_taxonomy_day_and_context(prepared):
    row = dlb.prompt_rows(dlb.worst_day_context(prepared, k_days=1, min_n=1)).first()
    assert all(f"- {t}\n" in row.prompt + "\n" for t in dlb.TAXONOMY) and str(row.betriebstag) in row.prompt
    body = json.loads(row.prompt[row.prompt.index("{"):row.prompt.rindex("}") + 1])
    assert body["n_halte"] == row.n_halte and set(body["weather"]) == {
        "temperatur_c", "niederschlag_mm", "wind_ms", "niederschlag_max"}
    assert "Abend" in body["by_daytime"]
    reply, tokens_in, _ = dlb.offline_client(dlb.RULES, row.prompt)
    assert "primaere_ursache" in reply and tokens_in > 0


def test_fact_sheet(prepared):
    facts = fact_sheet.fact_rows(prepared, "Wie ist der Halt 1?", min_type=1, min_worst=1, min_asked=1, min_weather=1)
    pdf = facts.toPandas()
    source = prepared.toPandas()
    overall = pdf[pdf.section == "overall"].set_index("key").value
    assert overall["mean_delay"] == pytest.approx(source.delay_arr_sec.mean())
    assert overall["off_peak"] == pytest.approx(source.delay_arr_sec[~source.is_rush_hour].mean())
    assert (pdf.section == "worst_station").sum() == 5 and (pdf.section == "asked_station").sum() == 8
    assert (pdf.section == "hour").sum() == source.hour.nunique()
    lines = fact_sheet.fact_lines(facts).toPandas()
    assert lines.section_no.is_monotonic_increasing and len(lines) == len(pdf)
    few = fact_sheet.fact_rows(prepared, "?", min_weather=10 ** 6)
    assert few.where("section IN ('weather', 'asked_station')").isEmpty()


def test_rain_effect_needs_enough_rows(prepared):
    n = prepared.where("niederschlag_mm IS NOT NULL").count()
    assert gr.rain_effect(prepared, more_than=n).isEmpty() and not gr.rain_effect(prepared, more_than=n - 1).isEmpty()


def test_grids_and_shares(prepared):
    pdf = prepared.toPandas()
    grid = gr.time_of_day_grid(prepared).toPandas()
    assert grid.weekday.tolist() == [d for d in ["Mo", "Di", "Mi", "Do", "Fr", "Sa", "So"] if d in set(pdf.weekday)]
    assert gr.time_of_day_counts(prepared).toPandas().filter(regex="^h").to_numpy().sum() == len(pdf)
    shares = gr.class_shares(prepared, "verkehrsmittel_text", k=3).toPandas()
    assert len(shares) == 3 and shares.iloc[:, 2:].sum(axis=1).round(9).eq(100).all()


def test_group_keys_of_null_are_dropped_in_frames_but_kept_in_sql(spark):
    df = events(spark, [{"haltestellen_name": None}, {"haltestellen_name": "A"}])
    assert gr.group_means(df, "haltestellen_name").count() == 1
    df.createOrReplaceTempView("delays")
    assert sql_reports.top_stations(spark, min_n=1).count() == 2


def test_weekday_report_starts_on_sunday(spark):
    events(spark, [{"betriebstag": dt.date(2026, 4, 12)}, {"betriebstag": dt.date(2026, 4, 13), "delay_arr_sec": 181.0}]
           ).createOrReplaceTempView("delays")
    rows = sql_reports.by_weekday(spark).collect()
    assert [(r.weekday_num, r.weekday, float(r.pct_late_over_3min)) for r in rows] == [(0, "So", 0.0), (1, "Mo", 100.0)]


def test_quality(spark):
    df = spark.createDataFrame([(1, None, float("nan")), (1, None, float("nan")), (2, "x", 1.0)], "a int, b string, c double")
    assert {r.column: (r.missing, r.pct) for r in qu.null_report(df).collect()} == {"b": (2, 66.67), "c": (2, 66.67)}
    assert qu.duplicate_rows(df).first().n_duplicates == 1 and qu.duplicate_rows(df.limit(0)).first().n_duplicates == 0


def test_samples_are_repeatable_and_bounded(spark):
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * 90 + ["b"] * 10, "i": range(100)}))
    pick = lambda seed: {r.i for r in gr.sample_per_group(df.repartition(7), "g", 20, gr.seeded(seed, "i")).collect()}
    assert pick(42) == pick(42) != pick(43) and len(pick(42)) == 30
    hashes = df.withColumn("h", gr.seeded(42, "i")).toPandas().sort_values("h")
    assert pick(42) == set(hashes.groupby("g").head(20).i)
    assert gr.sample_rows(df, 5, gr.seeded(1, "i")).count() == 5


def test_empty_table_gives_null_figures(spark):
    none = events(spark, []).withColumn("is_late_3min", F.lit(True))
    row = gr.kpis(none).first()
    assert (row.n_rows, row.mean_delay, row.pct_late, row.n_days) == (0, None, None, 0)


def test_empty_tables_go_through_every_operator(spark, prepared):
    from taktspur.operators import hypothesis as h, shape
    from taktspur.plans.statistics import result_document, result_rows
    none = prepared.where("false")
    assert shape.describe(none).first().n == 0 and shape.describe(none, by="weekday").isEmpty()
    assert shape.histogram(none, "delay_arr_sec").agg(F.sum("n")).first()[0] == 0
    assert shape.box_stats(none, "delay_arr_sec", "weekday").isEmpty()
    assert h.spearman(none, ["temperatur_c"]).isEmpty() and h.tukey_pairs(none, "weekday").isEmpty()
    assert gr.class_shares(none, "verkehrsmittel_text").isEmpty() and gr.time_of_day_grid(none).isEmpty()
    assert gr.sample_per_group(none, "weekday", 5, gr.seeded(1, "bpuic")).isEmpty()
    assert dlb.day_context(none).isEmpty() and dlb.classify_days(dlb.worst_day_context(none)).isEmpty()
    assert station_map.map_scale(station_map.station_table(none, stations(spark))).isEmpty()
    assert gr.day_range(none).first().n_days == 0
    assert fact_sheet.fact_rows(none, "Halt").where("section = 'hour'").isEmpty()
    assert result_rows(none).where("section = 'test_ols'").isEmpty()
    document = result_document(none).first()
    assert document.n_total_events == 0 and document.mean_delay_sec is None and document.test_ols is None


def test_ties_go_to_the_smaller_key(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "k string, v double")
    assert [r.k for r in gr.top_by(df, "v", "k", 2).collect()] == ["c", "a"]
