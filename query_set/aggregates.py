"""Grouped aggregates, top lists, distributions, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from taktspur.functions.delay import DELAY_CLASSES, clipped
from taktspur.operators import grouped as gr, shape
from taktspur.operators.filters import measured
from taktspur.operators.ranks import quantiles
from taktspur.plans import fact_sheet
from taktspur.sources.stations import region_list as regions_of

from .registry import query, r, rounded
from .tables import (clean_events, feature_events, prepared_events, shipments, sql, sql_more,
                     stations, stop_events, table)

_KPI = f"""count(*) AS n_rows, {r("avg(delay_arr_sec) AS mean_delay",
           "100.0 * count(*) FILTER (is_late_3min) / count(*) AS pct_late")},
           count(DISTINCT betriebstag) AS n_days"""


@query("kpi", sql("feat", f"SELECT {_KPI} FROM feat"))
def kpi(spark, sf_dir):
    return rounded(gr.kpis(feature_events(spark, sf_dir)))


@query("kpi_large", sql("ship", f"SELECT {_KPI} FROM ship"))
def kpi_large(spark, sf_dir):
    return rounded(gr.kpis(shipments(spark, sf_dir)))


@query("top_stations", sql("clean", f"""
    SELECT haltestellen_name, count(*) AS n, {r("avg(delay_arr_sec) AS mean_delay")} FROM clean
    GROUP BY haltestellen_name HAVING count(*) >= 40 ORDER BY avg(delay_arr_sec) DESC, haltestellen_name LIMIT 10"""))
def top_stations(spark, sf_dir):
    means = gr.group_means(clean_events(spark, sf_dir), "haltestellen_name", min_n=40)
    return rounded(gr.top_by(means, "mean_delay", "haltestellen_name", 10))


@query("top_stations_large", sql("ship", f"""
    SELECT bpuic, count(*) AS n, {r("avg(delay_arr_sec) AS mean_delay")} FROM ship
    GROUP BY bpuic HAVING count(*) >= 500 ORDER BY avg(delay_arr_sec) DESC, bpuic LIMIT 10"""))
def top_stations_large(spark, sf_dir):
    return rounded(gr.top_by(gr.group_means(shipments(spark, sf_dir), "bpuic", min_n=500),
                             "mean_delay", "bpuic", 10))


@query("worst_stations", sql("clean", f"""
    SELECT haltestellen_name, count(*) AS n, {r("avg(delay_arr_sec) AS mean_delay")} FROM clean
    GROUP BY haltestellen_name HAVING count(*) >= 30 ORDER BY avg(delay_arr_sec) DESC, haltestellen_name LIMIT 5"""))
def worst_stations(spark, sf_dir):
    return rounded(fact_sheet.worst_stations(clean_events(spark, sf_dir), min_n=30))


_HOURS = range(24)


@query("tod_heatmap", sql("feat", f"""
    SELECT weekday_num AS weekday_order, weekday,
           {r(*[f"avg(delay_arr_sec) FILTER (hour = {h}) AS h{h:02d}" for h in _HOURS])}
    FROM feat GROUP BY weekday_num, weekday"""))
def tod_heatmap(spark, sf_dir):
    return rounded(gr.time_of_day_grid(feature_events(spark, sf_dir)))


@query("tod_long", sql("feat", f"""
    SELECT weekday, hour, {r("avg(delay_arr_sec) AS mean_delay")}, count(*) AS n FROM feat GROUP BY weekday, hour"""))
def tod_long(spark, sf_dir):
    return rounded(gr.time_of_day_means(feature_events(spark, sf_dir)))


@query("tod_counts", sql("feat", f"""
    SELECT weekday_num AS weekday_order, weekday,
           {", ".join(f"count(*) FILTER (hour = {h}) AS h{h:02d}" for h in _HOURS)}
    FROM feat GROUP BY weekday_num, weekday"""))
def tod_counts(spark, sf_dir):
    return rounded(gr.time_of_day_counts(feature_events(spark, sf_dir)))


_SHARES = ", ".join(
    f"(round(100.0 * count(*) FILTER (delay_class = '{c}') / count(*), 6) + 0.0) AS \"{c}\"" for c in DELAY_CLASSES)


@query("class_share", sql("feat", f"""
    SELECT verkehrsmittel_text, count(*) AS n, {_SHARES} FROM feat GROUP BY verkehrsmittel_text
    ORDER BY n DESC, verkehrsmittel_text LIMIT 5"""))
def class_share(spark, sf_dir):
    return rounded(gr.class_shares(feature_events(spark, sf_dir), "verkehrsmittel_text"))


def _split(flag):
    yes, no = f"FILTER ({flag})", f"FILTER (NOT {flag})"
    means = r(f"avg(delay_arr_sec) {yes} AS mean_yes", f"avg(delay_arr_sec) {no} AS mean_no",
              f"avg(delay_arr_sec) {yes} - avg(delay_arr_sec) {no} AS difference",
              f"(avg(delay_arr_sec) {yes} / avg(delay_arr_sec) {no} - 1) * 100 AS difference_pct")
    return f"SELECT '{flag}' AS split, count(*) {yes} AS n_yes, count(*) {no} AS n_no, {means} FROM feat"


@query("split_means", sql("feat", _split("is_rush_hour") + " UNION ALL " + _split("is_weekend")))
def split_means(spark, sf_dir):
    """Rush hour against off-peak, weekend against workday."""
    df = feature_events(spark, sf_dir)
    parts = [gr.two_group_means(df, F.col(flag)).withColumn("split", F.lit(flag))
             for flag in ("is_rush_hour", "is_weekend")]
    return rounded(parts[0].unionByName(parts[1]))


@query("split_medians", sql("feat", f"""
    SELECT is_weekend, count(*) AS n, {r("avg(delay_arr_sec) AS mean", "quantile_cont(delay_arr_sec, 0.5) AS median")}
    FROM feat GROUP BY is_weekend"""))
def split_medians(spark, sf_dir):
    """Workday and weekend: n, mean, exact median."""
    df = feature_events(spark, sf_dir)
    out = shape.describe(df, by="is_weekend", at={"median": 0.5})
    return rounded(out.select("is_weekend", "n", "mean", "median"))


@query("rain_effect", sql("prep", f"""
    SELECT count(niederschlag_mm) AS n_weather,
           {r("avg(delay_arr_sec) FILTER (niederschlag_mm > 0) AS mean_rain",
              "avg(delay_arr_sec) FILTER (niederschlag_mm = 0) AS mean_dry")}
    FROM prep HAVING count(niederschlag_mm) > 1000"""))
def rain_effect(spark, sf_dir):
    return rounded(gr.rain_effect(prepared_events(spark, sf_dir)))


@query("by_hour", sql("feat", f"""
    SELECT hour, {r("round_even(avg(delay_arr_sec), 0) AS mean_delay", digits=0)} FROM feat GROUP BY hour"""))
def by_hour(spark, sf_dir):
    return rounded(fact_sheet.by_hour(feature_events(spark, sf_dir)), 0)


@query("by_type", sql("clean", f"""
    SELECT verkehrsmittel_text, count(*) AS n, {r("avg(delay_arr_sec) AS mean_delay")} FROM clean
    GROUP BY verkehrsmittel_text HAVING count(*) >= 100"""))
def by_type(spark, sf_dir):
    return rounded(fact_sheet.by_type(clean_events(spark, sf_dir)))


@query("by_type_large", sql("ship", f"""
    SELECT verkehrsmittel_text, count(*) AS n, {r("avg(delay_arr_sec) AS mean_delay")} FROM ship
    GROUP BY verkehrsmittel_text HAVING count(*) >= 100"""))
def by_type_large(spark, sf_dir):
    return rounded(fact_sheet.by_type(shipments(spark, sf_dir)))


_DAILY = f"""SELECT betriebstag, count(*) AS n_halte, {r("avg(delay_arr_sec) AS mean_delay",
    "100.0 * count(*) FILTER (is_late_3min) / count(*) AS pct_late_3min")} FROM"""


@query("worst_days", sql("feat", f"""{_DAILY} feat GROUP BY betriebstag
    ORDER BY 100.0 * count(*) FILTER (is_late_3min) / count(*) DESC, betriebstag LIMIT 10"""))
def worst_days(spark, sf_dir):
    return rounded(gr.worst_days(feature_events(spark, sf_dir)))


@query("daily_large", sql("ship", f"{_DAILY} ship GROUP BY betriebstag"))
def daily_large(spark, sf_dir):
    return rounded(gr.daily(shipments(spark, sf_dir)))


_AT = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def _describe(value):
    q = [f"quantile_cont({value}, {p}) AS {name}" for name, p in _AT.items()]
    return f"""count({value}) AS n, {r(f"avg({value}) AS mean", f"stddev_samp({value}) AS sd",
        f"min({value}) AS min", f"max({value}) AS max",
        f"100.0 * count(*) FILTER ({value} > 180) / count({value}) AS pct_late",
        f"100.0 * count(*) FILTER ({value} <= 0) / count({value}) AS pct_early_or_punctual", *q)}"""


@query("describe", sql("clean", f"SELECT {_describe('delay_arr_sec')} FROM clean"))
def describe(spark, sf_dir):
    return rounded(shape.describe(clean_events(spark, sf_dir)))


@query("describe_by_type", sql("clean", f"""
    SELECT verkehrsmittel_text, {_describe('delay_arr_sec')} FROM clean GROUP BY verkehrsmittel_text"""))
def describe_by_type(spark, sf_dir):
    return rounded(shape.describe(clean_events(spark, sf_dir), by="verkehrsmittel_text"))


@query("describe_large", f"SELECT {_describe('l_extendedprice')} FROM lineitem")
def describe_large(spark, sf_dir):
    """Descriptives of a value with almost as many levels as rows."""
    return rounded(shape.describe(table(spark, sf_dir, "lineitem"), "l_extendedprice"))


@query("median_per_station", f"""
    SELECT l_suppkey, {r("quantile_cont(l_extendedprice, 0.5) AS median")} FROM lineitem GROUP BY l_suppkey""")
def median_per_station(spark, sf_dir):
    return rounded(quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", {"median": 0.5}, ["l_suppkey"]))


@query("value_counts", sql("feat", """
    SELECT 'type' AS what, verkehrsmittel_text AS value, count(*) AS n FROM feat GROUP BY 2
    UNION ALL SELECT 'class', delay_class, count(*) FROM feat GROUP BY 2
    UNION ALL SELECT 'line', linien_text, count(*) FROM feat WHERE linien_text IS NOT NULL GROUP BY 2"""))
def value_counts(spark, sf_dir):
    df = feature_events(spark, sf_dir)
    columns = {"type": "verkehrsmittel_text", "class": "delay_class", "line": "linien_text"}
    parts = [gr.value_counts(df, c).select(F.lit(what).alias("what"), F.col(c).alias("value"), "n")
             for what, c in columns.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("day_range", sql("clean", """
    SELECT min(betriebstag) AS "start", max(betriebstag) AS "end", count(DISTINCT betriebstag) AS n_days,
           date_diff('day', min(betriebstag), max(betriebstag)) + 1 AS n_calendar_span FROM clean"""))
def day_range(spark, sf_dir):
    return rounded(gr.day_range(clean_events(spark, sf_dir)))


@query("distincts", sql("clean", """
    SELECT 'haltestellen_name' AS "column", count(DISTINCT haltestellen_name) AS n_distinct FROM clean
    UNION ALL SELECT 'linien_text', count(DISTINCT linien_text) FROM clean"""))
def distincts(spark, sf_dir):
    return gr.distinct_counts(clean_events(spark, sf_dir), ["haltestellen_name", "linien_text"])


@query("region_list", sql("stations", """
    SELECT DISTINCT cantonabbreviation FROM stations WHERE cantonabbreviation IS NOT NULL"""))
def region_list(spark, sf_dir):
    return regions_of(stations(spark, sf_dir))


@query("histogram", sql_more("clean", """
    x AS (SELECT least(greatest(delay_arr_sec, -60), 600) AS v FROM clean),
    e AS (SELECT min(v) AS low, max(v) AS high FROM x),
    g AS (SELECT v, low, (high - low) / 50 AS width, floor((v - low) / (high - low) * 50) AS i FROM x, e),
    c AS (SELECT cast(least(CASE WHEN v < low + width * i THEN i - 1 WHEN v >= low + width * (i + 1) THEN i + 1
                                 ELSE i END, 49) AS bigint) AS bin, count(*) AS n FROM g GROUP BY 1)""", f"""
    SELECT b AS bin, {r("low + (high - low) / 50 * b AS bin_low", "low + (high - low) / 50 * (b + 1) AS bin_high")},
           coalesce(n, 0) AS n FROM range(50) t(b) CROSS JOIN e LEFT JOIN c ON c.bin = b"""))
def histogram(spark, sf_dir):
    df = clean_events(spark, sf_dir).withColumn("v", clipped("delay_arr_sec", -60.0, 600.0))
    return rounded(shape.histogram(df, "v"))


@query("box_stats", sql_more("clean", """
    x AS (SELECT verkehrsmittel_text, least(greatest(delay_arr_sec, -60), 600) AS v FROM clean),
    q AS (SELECT verkehrsmittel_text, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
                 quantile_cont(v, 0.75) AS q3 FROM x GROUP BY 1)""", f"""
    SELECT verkehrsmittel_text, n,
           {r("least(q1, min(v) FILTER (v >= q1 - 1.5 * (q3 - q1))) AS whisker_low", "q1", "median", "q3",
              "greatest(q3, max(v) FILTER (v <= q3 + 1.5 * (q3 - q1))) AS whisker_high")}
    FROM x JOIN q USING (verkehrsmittel_text) GROUP BY verkehrsmittel_text, n, q1, median, q3"""))
def box_stats(spark, sf_dir):
    df = clean_events(spark, sf_dir).withColumn("v", clipped("delay_arr_sec", -60.0, 600.0))
    return rounded(shape.box_stats(df, "v", "verkehrsmittel_text"))


@query("extremes", sql("ev", f"""
    SELECT betriebstag, fahrt_bezeichner, {r('delay_arr_sec')} FROM ev
    WHERE an_prognose_status = 'REAL' ORDER BY delay_arr_sec, fahrt_bezeichner LIMIT 3"""))
def extremes(spark, sf_dir):
    """The three earliest arrivals before the plausibility filter."""
    lowest = gr.top_by(measured(stop_events(spark, sf_dir)), "delay_arr_sec", "fahrt_bezeichner", 3, ascending=True)
    return rounded(lowest.select("betriebstag", "fahrt_bezeichner", "delay_arr_sec"))


_HASH = "substr(md5(concat('42-', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)), 1, 15)"


@query("sample_per_group", f"""
    SELECT l_returnflag, l_orderkey, l_linenumber FROM (
        SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {_HASH}) AS rn FROM lineitem)
    WHERE rn <= 1000""")
def sample_per_group(spark, sf_dir):
    """1,000 line items per return flag, in the order of a hash both engines have."""
    order = F.conv(F.expr(_HASH), 16, 10).cast("bigint")
    picked = gr.sample_per_group(table(spark, sf_dir, "lineitem"), "l_returnflag", 1000, order)
    return rounded(picked.select("l_returnflag", "l_orderkey", "l_linenumber"))


_EVENT_HASH = "substr(md5(concat('42-', fahrt_bezeichner)), 1, 15)"


@query("sample_rows", sql("clean", f"""
    SELECT fahrt_bezeichner, {r('delay_arr_sec')} FROM (SELECT * FROM clean ORDER BY {_EVENT_HASH} LIMIT 5000)"""))
def sample_rows(spark, sf_dir):
    """5,000 events in the order of a hash both engines have."""
    order = F.conv(F.expr(_EVENT_HASH), 16, 10).cast("bigint")
    picked = gr.sample_rows(clean_events(spark, sf_dir), 5000, order)
    return rounded(picked.select("fahrt_bezeichner", "delay_arr_sec"))


@query("late_summary", sql("clean", f"""
    SELECT count(*) FILTER (delay_arr_sec > 180) AS n_late,
           {r("100.0 * count(*) FILTER (delay_arr_sec > 180) / count(*) AS pct_late",
              "100.0 * count(*) FILTER (delay_arr_sec <= 0) / count(*) AS pct_early_or_punctual")} FROM clean"""))
def late_summary(spark, sf_dir):
    return rounded(gr.late_summary(clean_events(spark, sf_dir)))
