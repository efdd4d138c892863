"""Sources, sinks, daily loads."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from taktspur.functions.time import parse_time
from taktspur.plans import sql_reports
from taktspur.session import new_run_dir
from taktspur.sources import days, events as ev, stations as st, tables as tb, weather as we
from taktspur.streaming.daily_files import load_new_days

from .registry import query, r, rounded
from .tables import sql, sql_more, stations, stations_raw, stop_events, table, weather

_FEED = ["BETRIEBSTAG", "PRODUKT_ID", "BETREIBER_ABK", "BPUIC", "LINIEN_TEXT", "ANKUNFTSZEIT",
         "AN_PROGNOSE", "ABFAHRTSZEIT", "AB_PROGNOSE", "FAHRT_BEZEICHNER"]
_TIME = "dd.MM.yyyy HH:mm:ss"
_FEED_TYPES = T.StructType([T.StructField(c, T.LongType() if c == "BPUIC" else T.StringType()) for c in _FEED])


def _feed(spark, sf_dir):
    """All stops as feed rows: upper-case names, day-first times in whole seconds as text."""
    df = stop_events(spark, sf_dir)
    df = df.withColumns({
        "betriebstag": F.date_format("betriebstag", "dd.MM.yyyy"),
        **{c: F.date_format(c, _TIME) for c in
           ("ankunftszeit", "an_prognose", "abfahrtszeit", "ab_prognose")},
    })
    return df.select(*[F.col(c.lower()).alias(c) for c in _FEED])


_SEC = "date_trunc('second', {c})"
_INGESTED = """
    SELECT betriebstag, produkt_id, betreiber_abk, bpuic, linien_text,
           date_trunc('second', ankunftszeit) AS ankunftszeit,
           date_trunc('second', an_prognose) AS an_prognose,
           date_trunc('second', abfahrtszeit) AS abfahrtszeit,
           date_trunc('second', ab_prognose) AS ab_prognose, fahrt_bezeichner,
           cast(date_diff('second', date_trunc('second', ankunftszeit),
                          date_trunc('second', an_prognose)) AS double) AS delay_arr_sec,
           cast(date_diff('second', date_trunc('second', abfahrtszeit),
                          date_trunc('second', ab_prognose)) AS double) AS delay_dep_sec
    FROM ev WHERE produkt_id = 'Zug' AND betreiber_abk = 'EINS'"""


@query("ingest_csv_events", sql("ev", _INGESTED))
def ingest_csv_events(spark, sf_dir):
    """Write the feed as semicolon files, read it back, filter, parse, delays."""
    path = new_run_dir(spark, "feed")
    _feed(spark, sf_dir).write.options(**tb.CSV).option("header", True).csv(path)
    return ev.ingest(ev.read_event_csv(spark, path, _FEED_TYPES), "Zug", "EINS")


@query("ingest_swapped_columns", sql("ev", _INGESTED))
def ingest_swapped_columns(spark, sf_dir):
    """Two sets of files whose headers differ in order, read as one table by name."""
    path = new_run_dir(spark, "swapped")
    feed = _feed(spark, sf_dir)
    odd = F.col("FAHRT_BEZEICHNER").cast("bigint") % 2 == 1
    for name, part in (("a", feed.where(~odd)), ("b", feed.where(odd).select(*reversed(_FEED)))):
        part.write.options(**tb.CSV).option("header", True).csv(f"{path}/{name}")
    return ev.ingest(ev.read_event_csv(spark, [f"{path}/a", f"{path}/b"], _FEED_TYPES), "Zug", "EINS")


@query("daily_loads", sql("ev", f"""
    SELECT CASE WHEN event_id % 50 = 0 THEN NULL ELSE betriebstag END AS betriebstag, count(*) AS n,
           {r("cast(sum(date_diff('second', date_trunc('second', ankunftszeit), date_trunc('second', an_prognose))) AS double) AS total")}
    FROM ev WHERE produkt_id = 'Zug' AND betreiber_abk = 'EINS' GROUP BY 1"""))
def daily_loads(spark, sf_dir):
    """Two loads, the second over files of both: unreadable days and days in both sets stay whole."""
    folder, target, mark = (new_run_dir(spark, f"daily-{n}") for n in ("in", "out", "mark"))
    number = F.col("FAHRT_BEZEICHNER").cast("bigint")
    feed = _feed(spark, sf_dir).withColumn(
        "BETRIEBSTAG", F.when(number % 50 == 0, "unlesbar").otherwise(F.col("BETRIEBSTAG")))
    for name, part in (("a", feed.where(number % 3 == 0)), ("b", feed.where(number % 3 != 0).select(*reversed(_FEED)))):
        part.write.options(**tb.CSV).option("header", True).csv(f"{folder}/{name}")
        load_new_days(spark, f"{folder}/*", target, mark, "Zug", "EINS", _FEED_TYPES)
    return rounded(ev.read_days(spark, target).groupBy("betriebstag").agg(
        F.count("*").alias("n"), F.sum("delay_arr_sec").alias("total")))


@query("ingest_filter", sql("ev", """
    SELECT fahrt_bezeichner, produkt_id, betreiber_abk, bpuic FROM ev
    WHERE produkt_id = 'Zug' AND betreiber_abk = 'EINS'"""))
def ingest_filter(spark, sf_dir):
    keep = ev.kept_rows("Zug", "EINS", "produkt_id", "betreiber_abk")
    return stop_events(spark, sf_dir).where(keep).select(
        "fahrt_bezeichner", "produkt_id", "betreiber_abk", "bpuic")


@query("parse_timestamps", """
    SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('second', ts) END AS parsed,
           cast(ts AS date) AS parsed_day
    FROM events""")
def parse_timestamps(spark, sf_dir):
    """Day-first text, unreadable for errors, becomes a timestamp or null."""
    text = F.when(F.col("event_type") == "error", "kein Datum").otherwise(F.date_format("ts", _TIME))
    return table(spark, sf_dir, "events").select(
        "event_id", parse_time(text).alias("parsed"),
        parse_time(F.date_format("ts", "dd.MM.yyyy")).cast("date").alias("parsed_day"))


@query("delay_seconds", sql("ev", f"""
    SELECT event_id, {r("date_diff('microsecond', ankunftszeit, an_prognose) / 1000000.0 AS delay_arr_sec",
                        "date_diff('microsecond', abfahrtszeit, ab_prognose) / 1000000.0 AS delay_dep_sec")}
    FROM ev"""))
def delay_seconds(spark, sf_dir):
    pairs = {"delay_arr_sec": ("ankunftszeit", "an_prognose"),
             "delay_dep_sec": ("abfahrtszeit", "ab_prognose")}
    times = stop_events(spark, sf_dir).drop("delay_arr_sec", "delay_dep_sec")
    return rounded(ev.with_delays(times, pairs).select("event_id", *pairs))


@query("roundtrip_parquet", sql("ev", f"""
    SELECT betriebstag, count(*) AS n, {r("sum(delay_arr_sec) AS total", digits=3)}
    FROM ev GROUP BY betriebstag"""))
def roundtrip_parquet(spark, sf_dir):
    """Write one folder per operating day, read back, sum per day."""
    path = new_run_dir(spark, "days")
    ev.write_days(stop_events(spark, sf_dir), path)
    back = ev.read_days(spark, path)
    return rounded(back.groupBy("betriebstag").agg(
        F.count("*").alias("n"), F.sum("delay_arr_sec").alias("total")), 3)


_STORED = "cast(ts AS date) AS day FROM events WHERE event_type = 'purchase' AND value > 250"
_SPINE = """spine AS (SELECT cast(unnest(generate_series(min(betriebstag), max(betriebstag),
                                          interval 1 day)) AS date) AS day FROM ev)"""


def _stored(spark, sf_dir):
    return (table(spark, sf_dir, "events").where("event_type = 'purchase' AND value > 250")
            .select(F.col("ts").cast("date").alias("day")))


@query("days_to_load", sql_more("ev", _SPINE, f"""
    SELECT day FROM spine WHERE day NOT IN (SELECT {_STORED})"""))
def days_to_load(spark, sf_dir):
    wanted = days.spine_of(stop_events(spark, sf_dir), "betriebstag")
    return days.days_to_load(wanted, _stored(spark, sf_dir))


@query("date_spine", sql_more("ev", _SPINE, "SELECT day FROM spine"))
def date_spine(spark, sf_dir):
    return days.spine_of(stop_events(spark, sf_dir), "betriebstag")


@query("latest_days", sql("ev", """
    SELECT DISTINCT betriebstag AS day FROM ev ORDER BY day DESC LIMIT 3"""))
def latest_days(spark, sf_dir):
    return days.latest_days(stop_events(spark, sf_dir), "betriebstag", 3)


@query("missing_days", """
    WITH spine AS (SELECT cast(unnest(generate_series(min(cast(o_orderdate AS date)),
                          max(cast(o_orderdate AS date)), interval 1 day)) AS date) AS day FROM orders)
    SELECT day FROM spine WHERE day NOT IN (
        SELECT cast(o_orderdate AS date) FROM orders WHERE o_orderpriority = '1-URGENT')""")
def missing_days(spark, sf_dir):
    """Calendar days of the orders without an urgent one."""
    dated = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority")
    return days.missing_days(days.spine_of(dated, "day"), dated.where("o_orderpriority = '1-URGENT'"))


_LINK = r'href="/([^"/]+)"'


@query("extract_links", f"""
    WITH hits AS (
        SELECT page_id, unnest(regexp_extract_all(html, '{_LINK}', 0)) AS link,
               unnest(regexp_extract_all(html, '{_LINK}', 1)) AS key,
               unnest(range(len(regexp_extract_all(html, '{_LINK}', 0)))) AS pos
        FROM pages)
    SELECT key, link, page_id AS page, pos FROM hits
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY page_id, pos) = 1""")
def extract_links(spark, sf_dir):
    return rounded(days.extract_links(table(spark, sf_dir, "pages"), "html", "page_id", _LINK))


@query("ingest_summary", sql("ev", f"""
    SELECT count(*) AS raw_rows, count(*) FILTER (produkt_id = 'Zug' AND betreiber_abk = 'EINS') AS kept_rows,
           {r("100.0 * count(*) FILTER (produkt_id = 'Zug' AND betreiber_abk = 'EINS') / greatest(count(*), 1) AS kept_pct")}
    FROM ev"""))
def ingest_summary(spark, sf_dir):
    keep = ev.kept_rows("Zug", "EINS", "produkt_id", "betreiber_abk")
    return rounded(ev.ingest_summary(stop_events(spark, sf_dir), keep))


@query("tag_from_filename", f"""
    SELECT event_type AS station_abbr, count(*) AS n, {r("sum(value) AS total", digits=3)}
    FROM events GROUP BY event_type""")
def tag_from_filename(spark, sf_dir):
    """One set of files per event type, read together; the type comes from the path.

    Spark names its part files itself, so the type is the head of the folder's name here, up to the
    first underscore as in the default pattern.
    """
    root = new_run_dir(spark, "tagged")
    events = table(spark, sf_dir, "events")
    (events.select("value", F.concat("event_type", F.lit("_h_recent")).alias("kind"))
     .write.partitionBy("kind").parquet(root, compression="snappy"))
    tagged = we.read_tagged_parquet(spark, f"{root}/*", pattern=r"/kind=([^/_]+)_[^/]*/[^/]*$")
    return rounded(tagged.groupBy("station_abbr").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")), 3)


@query("project_optional", sql("ev", "SELECT betriebstag, bpuic, linien_text FROM ev"))
def project_optional(spark, sf_dir):
    """Listed columns that exist; two of the five do not."""
    wanted = ["betriebstag", "gleis", "bpuic", "linien_text", "zugtyp"]
    return tb.project_optional(stop_events(spark, sf_dir), wanted)


@query("station_filter", sql("stations_raw", """
    SELECT number, designationofficial, meansoftransport, validto FROM stations_raw
    WHERE contains(upper(meansoftransport), 'TRAIN') AND hasgeolocation AND validto = '9999-12-31'"""))
def station_filter(spark, sf_dir):
    return st.active_stations(stations_raw(spark, sf_dir)).select(
        "number", "designationofficial", "meansoftransport", "validto")


@query("split_geopos", sql("stations_raw", f"SELECT number, {r('lat', 'lon')} FROM stations_raw"))
def split_geopos(spark, sf_dir):
    raw = stations_raw(spark, sf_dir).drop("lat", "lon")
    return rounded(st.with_coordinates(raw).select("number", "lat", "lon"))


@query("roundtrip_csv", sql("stations", f"""
    SELECT number, sloid, designationofficial, cantonabbreviation, meansoftransport, {r('lat', 'lon')}
    FROM stations"""))
def roundtrip_csv(spark, sf_dir):
    path = new_run_dir(spark, "stations")
    st.write_stations_csv(tb.conform(stations(spark, sf_dir), st.STATIONS), path)
    return rounded(st.read_stations_csv(spark, path).select(
        "number", "sloid", "designationofficial", "cantonabbreviation", "meansoftransport", "lat", "lon"))


# Characters that ISO-8859-1 lacks become a question mark.
_BEYOND = r"[^\x00-\xFF]"


@query("latin1_csv", f"""
    SELECT cast(doc_id AS varchar) AS doc_id, lang,
           md5(regexp_replace(concat('"', text, '; "" '), '{_BEYOND}', '?', 'g')) AS text_md5
    FROM documents""".replace("\\xFF", "\\x{FF}"))
def latin1_csv(spark, sf_dir):
    """Whole document texts, with quotes, separators and line ends, through files in ISO-8859-1."""
    path = new_run_dir(spark, "latin1")
    text = F.regexp_replace(F.concat(F.lit('"'), "text", F.lit('; "" ')), _BEYOND, "?")
    (table(spark, sf_dir, "documents").select("doc_id", "lang", text.alias("text"))
     .write.options(**tb.CSV).option("header", True).option("encoding", "ISO-8859-1")
     .option("quoteAll", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return we.read_latin1_csv(spark, path, multi_line=True).select(
        "doc_id", "lang", F.md5("text").alias("text_md5"))


@query("requested_absent", """
    SELECT DISTINCT upper(c_name) AS station_abbr FROM customer
    WHERE upper(c_name) NOT IN (SELECT upper(c_name) FROM customer JOIN orders ON o_custkey = c_custkey
                                WHERE o_orderstatus = 'P' AND o_custkey % 3 <> 0)""")
def requested_absent(spark, sf_dir):
    """Customers without an open order at one of two in three counters, by name in upper case."""
    customer = table(spark, sf_dir, "customer")
    ordered = customer.join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_custkey % 3 <> 0"),
                            F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return we.absent_keys(customer.select(F.upper("c_name").alias("station_abbr")),
                          ordered.select(F.col("c_name").alias("station_abbr")))


@query("union_days", sql("ev", f"""
    SELECT betriebstag, count(*) AS n, count(delay_dep_sec) AS n_dep, {r("sum(delay_arr_sec) AS total", digits=3)}
    FROM (SELECT betriebstag, delay_arr_sec, CASE WHEN produkt_id = 'Zug' THEN delay_dep_sec END AS delay_dep_sec
          FROM ev) GROUP BY betriebstag"""))
def union_days(spark, sf_dir):
    """Two frames with different columns as one table."""
    df = stop_events(spark, sf_dir).select("betriebstag", "delay_arr_sec", "delay_dep_sec", "produkt_id")
    both = ev.union_days([df.where("produkt_id = 'Zug'"),
                          df.where("produkt_id <> 'Zug'").drop("delay_dep_sec")])
    return rounded(both.groupBy("betriebstag").agg(
        F.count("*").alias("n"), F.count("delay_dep_sec").alias("n_dep"),
        F.sum("delay_arr_sec").alias("total")), 3)


def _register(spark, sf_dir):
    tb.replace_table(stop_events(spark, sf_dir), "delays")
    tb.replace_table(stations(spark, sf_dir), "stations")


_MEASURED = "an_prognose_status = 'REAL' AND delay_arr_sec IS NOT NULL"


@query("sql_top_stations", sql("ev", f"""
    SELECT haltestellen_name, count(*) AS n_halte, {r("avg(delay_arr_sec) AS avg_delay_sec", digits=1)},
           {r("avg(delay_arr_sec) / 60.0 AS avg_delay_min", digits=2)}
    FROM ev WHERE {_MEASURED} GROUP BY haltestellen_name HAVING count(*) >= 50
    ORDER BY avg_delay_sec DESC, haltestellen_name LIMIT 10"""))
def sql_top_stations(spark, sf_dir):
    _register(spark, sf_dir)
    return rounded(sql_reports.top_stations(spark, min_n=50))


@query("sql_by_weekday", sql("ev", f"""
    SELECT dayofweek(betriebstag) AS weekday_num,
           ['So', 'Mo', 'Di', 'Mi', 'Do', 'Fr', 'Sa'][cast(dayofweek(betriebstag) AS int) + 1] AS weekday,
           count(*) AS n_events, {r("avg(delay_arr_sec) AS avg_delay_sec", digits=1)},
           {r("100.0 * count(*) FILTER (delay_arr_sec > 180) / count(*) AS pct_late_over_3min", digits=2)}
    FROM ev WHERE {_MEASURED} GROUP BY dayofweek(betriebstag)"""))
def sql_by_weekday(spark, sf_dir):
    _register(spark, sf_dir)
    return rounded(sql_reports.by_weekday(spark))


@query("sql_by_canton", sql("ev stations", f"""
    SELECT cantonabbreviation AS kanton, count(*) AS n_events, {r("avg(delay_arr_sec) AS avg_delay_sec", digits=1)}
    FROM ev JOIN stations ON bpuic = number WHERE {_MEASURED}
    GROUP BY cantonabbreviation HAVING count(*) >= 200"""))
def sql_by_canton(spark, sf_dir):
    _register(spark, sf_dir)
    return rounded(sql_reports.by_canton(spark, min_n=200))


@query("sql_top_lines", sql("ev", """
    SELECT linien_text, count(*) AS n_halte FROM ev WHERE linien_text IS NOT NULL
    GROUP BY linien_text ORDER BY n_halte DESC, linien_text LIMIT 10"""))
def sql_top_lines(spark, sf_dir):
    _register(spark, sf_dir)
    return sql_reports.top_lines(spark)


@query("sql_param", f"""
    SELECT o_orderpriority, count(*) AS n, {r("avg(o_totalprice) AS mean_price", digits=4)}
    FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 GROUP BY o_orderpriority""")
def sql_param(spark, sf_dir):
    tb.replace_table(table(spark, sf_dir, "orders"), "orders_table")
    return rounded(tb.run_sql(spark, """
        SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS mean_price
        FROM orders_table WHERE o_orderstatus = ? AND o_totalprice > ? GROUP BY o_orderpriority
    """, ["F", 100000]), 4)


_COUNTED = ["benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem",
            "nation", "orders", "pages", "part", "region", "supplier"]


@query("table_counts", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS n FROM {name}" for name in _COUNTED))
def table_counts(spark, sf_dir):
    for name in _COUNTED:
        tb.replace_table(table(spark, sf_dir, name), name)
    return tb.table_counts(spark, _COUNTED)


@query("optional_input", sql("weather", f"""
    SELECT station_abbr, count(*) AS n, {r("sum(tre200h0) AS warmth", digits=3)}, cast(NULL AS double) AS extra
    FROM weather GROUP BY station_abbr"""))
def optional_input(spark, sf_dir):
    """Stored weather and a table not stored yet, read in the same way and put together."""
    path = new_run_dir(spark, "optional")
    tb.replace_table(weather(spark, sf_dir), "weather_stored", path)
    schema = T.StructType([T.StructField("station_abbr", T.StringType()), T.StructField("tre200h0", T.DoubleType()),
                           T.StructField("extra", T.DoubleType())])
    both = [tb.optional_parquet(spark, p, schema) for p in (path, f"{path}-absent")]
    return rounded(ev.union_days(both).groupBy("station_abbr").agg(
        F.count("*").alias("n"), F.sum("tre200h0").alias("warmth"), F.max("extra").alias("extra")), 3)
