"""Readers, writers, daily set logic."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from taktspur.schemas import RAW_EVENTS, STATIONS
from taktspur.sources import days, events as ev, stations as st, tables as tb, weather as we
from taktspur.streaming.daily_files import load_new_days

HEADER = ";".join(RAW_EVENTS.fieldNames())


def feed_line(day, product="Zug", operator="EINS", number="8503000", planned="08:00:00", actual="08:01:30"):
    stamp = day.strftime("%d.%m.%Y")
    return ";".join([
        stamp, "f1", product, operator, number, "7", "S 7", "S", "Zürich HB", "",
        f"{stamp} {planned}", f"{stamp} {actual}", "REAL", f"{stamp} 08:02", "kaputt", "PROGNOSE",
        "false", "false"])


def write_day(folder, day, lines):
    path = folder / f"{day.isoformat()}_feed.csv"
    path.write_text("\n".join([HEADER, *lines]) + "\n", encoding="utf-8")
    return str(path)


DAY = dt.date(2026, 4, 13)


def test_ingest_csv(spark, tmp_path):
    lines = [feed_line(DAY), feed_line(DAY, product="Bus"), feed_line(DAY, operator="ZWEI"),
             feed_line(DAY, product=""), feed_line(DAY, number="x")]
    raw = ev.read_event_csv(spark, write_day(tmp_path, DAY, lines))
    rows = ev.ingest(raw, "Zug", "EINS").orderBy("bpuic").collect()
    assert [r.bpuic for r in rows] == [None, 8503000]
    r = rows[1]
    assert r.betriebstag == DAY and r.delay_arr_sec == 90.0 and r.delay_dep_sec is None
    assert r.haltestellen_name == "Zürich HB" and r.linien_id == "7"
    got = ev.ingest_summary(raw, ev.kept_rows("Zug", "EINS")).first()
    assert (got.raw_rows, got.kept_rows, got.kept_pct) == (5, 2, 40.0)
    assert ev.ingest_summary(raw.limit(0), ev.kept_rows("Zug", "EINS")).first().kept_pct == 0.0


def test_days_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.createDataFrame([(DAY, 1.0), (DAY + dt.timedelta(1), 2.0)], "betriebstag date, v double")
    ev.write_days(df, path)
    ev.write_days(spark.createDataFrame([(DAY, 5.0), (DAY, 6.0)], "betriebstag date, v double"), path)
    got = spark.read.parquet(path).groupBy("betriebstag").agg(F.sum("v").alias("s")).orderBy("betriebstag").collect()
    assert [r.s for r in got] == [11.0, 2.0]


def test_new_files_are_loaded_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    table, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    write_day(folder, DAY, [feed_line(DAY), feed_line(DAY, product="Bus")])
    load_new_days(spark, str(folder), table, mark, "Zug", "EINS")
    load_new_days(spark, str(folder), table, mark, "Zug", "EINS")
    assert spark.read.parquet(table).count() == 1
    later = DAY + dt.timedelta(1)
    write_day(folder, later, [feed_line(later), feed_line(later, actual="08:10:00")])
    load_new_days(spark, str(folder), table, mark, "Zug", "EINS")
    rows = spark.read.parquet(table).groupBy("betriebstag").count().orderBy("betriebstag").collect()
    assert [(r.betriebstag, r["count"]) for r in rows] == [(DAY, 1), (later, 2)]


def test_day_sets(spark):
    spine = days.date_spine(spark, "2026-04-01", "2026-04-05")
    assert [r.day.day for r in spine.orderBy("day").collect()] == [1, 2, 3, 4, 5]
    assert days.date_spine(spark, DAY, DAY).count() == 1
    with pytest.raises(ValueError):
        days.date_spine(spark, "2026-04-05", "2026-04-01")
    have = spark.createDataFrame([(dt.date(2026, 4, d),) for d in (2, 4, 4, 9)], "day date")
    assert sorted(r.day.day for r in days.days_to_load(spine, have).collect()) == [1, 3, 5]
    assert [r.day.day for r in days.latest_days(have, "day", 2).collect()] == [4, 9]
    assert days.spine_of(have.where("false"), "day").isEmpty()


def test_first_link_per_key_wins(spark):
    pages = spark.createDataFrame([
        (1, '<a href="/r/aa/2026-04-01_x.csv"><a href="/r/bb/2026-04-02_x.csv"><a href="/r/cc/2026-04-01_x.csv">'),
        (2, '<a href="/r/dd/2026-04-02_x.csv"> nothing'), (3, None)], "id int, html string")
    got = days.extract_links(pages, "html", "id", r"/r/[a-z]+/(\d{4}-\d{2}-\d{2})_x\.csv")
    assert {r.key: (r.link, r.page, r.pos) for r in got.collect()} == {
        "2026-04-01": ("/r/aa/2026-04-01_x.csv", 1, 0), "2026-04-02": ("/r/bb/2026-04-02_x.csv", 1, 1)}


def test_stations(spark, tmp_path):
    raw = spark.createDataFrame([
        (1, "BUS|TRAIN", True, "9999-12-31", "47.37, 8.54"), (2, "train", True, "9999-12-31", "46.0,7.0"),
        (3, "BUS", True, "9999-12-31", ""), (4, None, True, "9999-12-31", ""), (5, "TRAIN", None, "9999-12-31", ""),
        (6, "TRAIN", False, "9999-12-31", ""), (7, "TRAIN", True, "2020-01-01", ""), (8, "TRAIN", True, None, "")],
        "number bigint, meansoftransport string, hasgeolocation boolean, validto string, geopos string")
    kept = st.with_coordinates(st.active_stations(raw))
    assert [(r.number, r.lat, r.lon) for r in kept.orderBy("number").collect()] == [(1, 47.37, 8.54), (2, 46.0, 7.0)]
    full = tb.conform(kept.withColumn("designationofficial", F.lit("Genève; Gare")), STATIONS)
    path = str(tmp_path / "stations")
    st.write_stations_csv(full, path)
    assert sorted(map(tuple, st.read_stations_csv(spark, path).collect())) == sorted(map(tuple, full.collect()))


def test_doubled_station_does_not_fan_out(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (None, "d")], "number bigint, name string")
    assert sorted(map(tuple, st.one_per_key(df).collect())) == [(1, "a"), (2, "c")]


def test_weather_files(spark, tmp_path):
    for abbr, place in (("SMA", "Zürich"), ("GVE", "Genève")):
        raw = f"Station_Abbr;Reference_Timestamp;TRE200H0;Ort\n{abbr.lower()};01.04.2026 13:00;7.5;{place}\n" \
              f"{abbr.lower()};kaputt;1.0;{place}\n{abbr.lower()};01.04.2026 14:00;-;{place}\n"
        (tmp_path / f"{abbr}.csv").write_bytes(raw.encode("latin-1"))
    parsed = we.parsed_weather(we.read_latin1_csv(spark, [str(tmp_path / "SMA.csv"), str(tmp_path / "GVE.csv")]))
    rows = parsed.orderBy("ort", "reference_timestamp").collect()
    assert [(r.ort, r.reference_timestamp.hour, r.tre200h0) for r in rows] == [
        ("Genève", 13, 7.5), ("Genève", 14, None), ("Zürich", 13, 7.5), ("Zürich", 14, None)]


def test_tag_comes_from_the_file_name(spark, tmp_path):
    pa, pq = pytest.importorskip("pyarrow"), pytest.importorskip("pyarrow.parquet")
    for abbr in ("SMA", "BER"):
        pq.write_table(pa.table({"TRE200H0": [1.0, 2.0], "extra": ["x", "y"]}), tmp_path / f"{abbr}_hourly_recent.parquet")
    tagged = we.weather_table(we.read_tagged_parquet(spark, f"{tmp_path}/*_hourly_recent.parquet"))
    assert tagged.columns == ["station_abbr", "tre200h0"]
    assert {r.station_abbr: r["count"] for r in tagged.groupBy("station_abbr").count().collect()} == {"SMA": 2, "BER": 2}


def test_absent_keys_ignore_case_and_null(spark):
    wanted = spark.createDataFrame([("SMA",), ("XYZ",)], "station_abbr string")
    meta = spark.createDataFrame([("sma",), (None,)], "station_abbr string")
    assert [r.station_abbr for r in we.absent_keys(wanted, meta).collect()] == ["XYZ"]


def test_tables_and_parameters(spark, tmp_path):
    tb.replace_table(spark.range(5), "t_counted", str(tmp_path / "t"))
    tb.replace_table(spark.range(3), "t_counted", str(tmp_path / "t"))
    assert tb.table_counts(spark, ["t_counted"]).first().n == 3
    assert tb.run_sql(spark, "SELECT * FROM t_counted WHERE id >= ?", [1]).count() == 2
    assert tb.run_sql(spark, "SELECT * FROM t_counted WHERE id = :id", {"id": 1}).count() == 1


def test_union_fills_absent_columns(spark):
    got = ev.union_days([spark.createDataFrame([(1, "a")], "x int, y string"), spark.createDataFrame([(2,)], "x int")])
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [(1, "a"), (2, None)]


def test_rows_without_a_day_outlive_later_loads(spark, tmp_path):
    path = str(tmp_path / "table")
    for v in (1.0, 2.0):
        ev.write_days(spark.createDataFrame([(DAY, v), (None, v)], "betriebstag date, v double"), path)
    got = ev.read_days(spark, path)
    assert got.columns == ["v", "betriebstag"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(2.0, DAY), (1.0, None), (2.0, None)], key=str)


def test_files_differ_and_share_days(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    table, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    lines = [feed_line(DAY), feed_line(DAY, number="7"), "x" + feed_line(DAY)[1:]]
    write_day(folder, DAY, lines)
    load_new_days(spark, str(folder), table, mark, "Zug", "EINS")
    # The same day again in a second file, columns turned round, one row without a readable day.
    names = HEADER.split(";")
    turned = "\n".join(";".join(reversed(line.split(";"))) for line in [HEADER, *lines])
    (folder / "second.csv").write_text(turned + "\n", encoding="utf-8")
    load_new_days(spark, str(folder), table, mark, "Zug", "EINS")
    got = ev.read_days(spark, table)
    assert got.count() == 6 and got.where("betriebstag is null").count() == 2
    assert sorted(r.bpuic for r in got.collect()) == [7, 7, 8503000, 8503000, 8503000, 8503000]
    assert len(names) > 5


def test_quotes_are_doubled_in_files(spark, tmp_path):
    row = (8503000, 'Halt "Nord"; X')
    df = spark.createDataFrame([row], "number bigint, designationofficial string")
    st.write_stations_csv(df, str(tmp_path / "s"))
    text = "".join(p.read_text() for p in (tmp_path / "s").glob("part-*"))
    assert '"Halt ""Nord""; X"' in text
    (tmp_path / "w.csv").write_text('a;b\n1;"Halt ""Süd"" X"\n2;"zwei\nZeilen"\n', encoding="latin-1")
    got = we.read_latin1_csv(spark, str(tmp_path / "w.csv"), multi_line=True).collect()
    assert [r.b for r in got] == ['Halt "Süd" X', "zwei\nZeilen"]


def pushed(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("PushedFilters"):].split("]")[0]


def test_feed_filter_reaches_the_file(spark, tmp_path):
    path = str(tmp_path / "raw")
    spark.createDataFrame([("Zug", "EINS", 1.0)], "p string, o string, v double").write.parquet(path)
    text = pushed(spark.read.parquet(path).where(ev.kept_rows("Zug", "EINS", "p", "o")))
    assert "EqualTo(p,Zug)" in text and "EqualTo(o,EINS)" in text
    from taktspur.operators.regression import complete_rows
    assert "IsNotNull(v)" in pushed(complete_rows(spark.read.parquet(path), ["v"]))


def read_rows(spark, path):
    return [tuple(r) for frame in tb.read_by_header(spark, str(path)) for r in frame.collect()]


def test_cells_beyond_the_header_fail(spark, tmp_path):
    for name, text in (("good", 'a;b\n"x;y;""z";1\n2\n\n3;\n'), ("wide", "a;b\n1;2;3\n"), ("blank", "a;b\n1;2;;4\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    assert read_rows(spark, tmp_path / "good.csv") == [('x;y;"z', "1"), ("2", None), ("3", None)]
    for name in ("wide", "blank"):
        with pytest.raises(Exception, match="more than 2 cells"):
            read_rows(spark, tmp_path / f"{name}.csv")


def test_headers_of_many_files_are_found_by_tasks(spark, tmp_path):
    kinds = [["a", "b"], ["b", "a"], ["a", "b", "c"]]
    for i in range(60):
        names = kinds[i % 3]
        values = {"a": f"a{i}", "b": f"b{i}", "c": f"c{i}"}
        (tmp_path / f"f{i:02d}.csv").write_text(";".join(names) + "\n" + (";".join(values[n] for n in names) + "\n") * 3)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n\n")
    (tmp_path / "mark.csv").write_bytes(b"\xef\xbb\xbfa;b\r\n1;2\r\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = tb.csv_headers(spark, str(tmp_path))
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert {k: len(v) for k, v in found.items()} == {("a", "b"): 21, ("b", "a"): 20, ("a", "b", "c"): 20}
    schema = "a string, b string, c string"
    got = ev.read_event_csv(spark, str(tmp_path), spark.createDataFrame([], schema).schema)
    rows = got.select("a", "b", "c").distinct().collect()
    assert got.count() == 181 and len(rows) == 61
    assert all(r.a == "1" or (r.a[1:] == r.b[1:] and r.c in (None, f"c{r.a[1:]}")) for r in rows)
    # The same where tasks hold several files and files are split.
    lines = spark.read.text(str(tmp_path)).where("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where("line <> ''").coalesce(2)
    assert len(tb._first_lines(lines, once=False)) == 61


def test_header_of_a_large_file(spark, tmp_path):
    (tmp_path / "large.csv").write_text("a;b\n" + "1;2\n" * 400_000)
    read = spark.read.text(str(tmp_path)).select(F.lit("f").alias("file"), F.col("value").alias("line"))
    assert [r.line for r in tb._first_lines(read.coalesce(1), once=True)] == ["a;b"]
    assert tb.csv_headers(spark, str(tmp_path)) == {("a", "b"): [f"file:{tmp_path}/large.csv"]}


def test_file_names_with_blanks_and_signs(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "x y%z+ä.csv").write_text(HEADER + "\n" + feed_line(DAY) + "\n", encoding="utf-8")
    (folder / "none.csv").write_text("")
    load_new_days(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "mark"), "Zug", "EINS")
    load_new_days(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "mark"), "Zug", "EINS")
    assert ev.read_days(spark, str(tmp_path / "out")).count() == 1


def test_filter_reaches_the_feed_file(spark, tmp_path):
    (tmp_path / "x.csv").write_text("PRODUKT_ID;BETREIBER_ABK;v\nZug;EINS;1\nBus;EINS;2\n")
    schema = spark.createDataFrame([], "PRODUKT_ID string, BETREIBER_ABK string, v int").schema
    kept = ev.read_event_csv(spark, str(tmp_path), schema).where(ev.kept_rows("Zug", "EINS"))
    text = pushed(kept)
    assert "EqualTo(PRODUKT_ID,Zug)" in text and "EqualTo(BETREIBER_ABK" in text
    assert [r.v for r in kept.collect()] == [1]


def test_file_without_the_key_column_fails(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a;b\n1;2\n")
    with pytest.raises(ValueError, match="no column BETRIEBSTAG"):
        ev.read_event_csv(spark, str(tmp_path), key="BETRIEBSTAG")


def test_scratch_folders_are_deleted(spark):
    import os

    from taktspur.session import materialized, new_run_dir, scratch
    with scratch(spark):
        outer = new_run_dir(spark, "outer")
        spark.range(3).write.parquet(outer)
        with scratch(spark):
            inner = new_run_dir(spark, "inner")
            spark.range(3).write.parquet(inner)
            new_run_dir(spark, "never-written")
        assert os.path.isdir(outer) and not os.path.exists(inner)
        assert materialized(spark.read.parquet(outer)).count() == 3
    assert not os.path.exists(outer)


def test_run_folders_go_when_the_program_ends(tmp_path):
    import os
    import subprocess
    import sys
    code = ("from taktspur.session import build_session, materialized, new_run_dir; import sys; "
            "s = build_session('x', 'local[1]', spark__ui__enabled='false', spark__checkpoint__dir=sys.argv[1]); "
            "p = new_run_dir(s, 'kept'); s.range(2).write.parquet(p); assert materialized(s.read.parquet(p)).count() == 2; s.stop()")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path)], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert os.listdir(tmp_path) == [], done.stderr[-500:]
