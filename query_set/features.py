"""Filters and column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from taktspur.functions import delay as dl, effect, text as tx, time as tm
from taktspur.operators import filters as fl, grouped as gr, quality as qu
from taktspur.schemas import PREPARED

from .registry import query, r, rounded
from .tables import (CLASS_SQL, clean_events, feature_events, prepared_events, shipments, sql,
                     sql_more, stations, stop_events, table)


@query("filter_measured", sql("ev", f"""
    SELECT count(*) AS n_before, count(*) FILTER (an_prognose_status = 'REAL') AS n_after,
           {r("100.0 * count(*) FILTER (an_prognose_status = 'REAL') / count(*) AS pct_kept")} FROM ev"""))
def filter_measured(spark, sf_dir):
    return rounded(fl.measured_share(stop_events(spark, sf_dir)))


@query("filter_implausible", sql("ev", f"""
    SELECT event_id, {r('delay_arr_sec')} FROM ev WHERE delay_arr_sec >= -600"""))
def filter_implausible(spark, sf_dir):
    return rounded(fl.plausible(stop_events(spark, sf_dir)).select("event_id", "delay_arr_sec"))


@query("filter_report", sql("ev", f"""
    SELECT count(*) FILTER (delay_arr_sec < -600) AS n_removed,
           {r("100.0 * count(*) FILTER (delay_arr_sec < -600) / count(*) AS pct_removed")},
           count(*) FILTER (delay_arr_sec >= -600) AS n_kept,
           {r("min(delay_arr_sec) FILTER (delay_arr_sec >= -600) AS min_delay",
              "max(delay_arr_sec) FILTER (delay_arr_sec >= -600) AS max_delay")},
           count(*) FILTER (delay_arr_sec > 1800) AS n_extreme,
           {r("100.0 * count(*) FILTER (delay_arr_sec > 1800) / count(*) FILTER (delay_arr_sec >= -600) AS pct_extreme")}
    FROM ev WHERE an_prognose_status = 'REAL'"""))
def filter_report(spark, sf_dir):
    return rounded(fl.plausible_report(fl.measured(stop_events(spark, sf_dir))))


@query("filter_region", sql("clean stations", f"""
    SELECT event_id, bpuic, {r('delay_arr_sec')} FROM clean
    WHERE bpuic IN (SELECT number FROM stations WHERE cantonabbreviation IN ('NATION_3', 'NATION_7'))"""))
def filter_region(spark, sf_dir):
    chosen = fl.in_regions(clean_events(spark, sf_dir), stations(spark, sf_dir), ["NATION_3", "NATION_7"])
    return rounded(chosen.select(F.col("fahrt_bezeichner").cast("bigint").alias("event_id"),
                                 "bpuic", "delay_arr_sec"))


@query("drilldown", sql("feat", f"""
    SELECT count(*) FILTER (weekday = 'Mo' AND hour = 8) AS n_selected,
           {r("avg(delay_arr_sec) FILTER (weekday = 'Mo' AND hour = 8) AS mean_selected",
              "avg(delay_arr_sec) AS mean_all",
              "avg(delay_arr_sec) FILTER (weekday = 'Mo' AND hour = 8) - avg(delay_arr_sec) AS difference",
              "(avg(delay_arr_sec) FILTER (weekday = 'Mo' AND hour = 8) / avg(delay_arr_sec) - 1) * 100 AS deviation_pct")}
    FROM feat"""))
def drilldown(spark, sf_dir):
    return rounded(gr.selection_vs_all(feature_events(spark, sf_dir), fl.at_time("Mo", 8)))


@query("filter_top_types", f"""
    WITH best AS (SELECT p_type FROM part GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 5)
    SELECT p_partkey, p_type FROM part WHERE p_type IN (SELECT p_type FROM best)""")
def filter_top_types(spark, sf_dir):
    return fl.of_top_groups(table(spark, sf_dir, "part"), "p_type", 5).select("p_partkey", "p_type")


@query("clip_values", sql("ev", f"""
    SELECT event_id, {r("least(greatest(delay_arr_sec, -60), 600) AS clipped")} FROM ev"""))
def clip_values(spark, sf_dir):
    return rounded(stop_events(spark, sf_dir).select(
        "event_id", dl.clipped("delay_arr_sec", -60.0, 600.0).alias("clipped")))


@query("delay_class", sql("ev", f"SELECT event_id, {CLASS_SQL} AS delay_class FROM ev"))
def delay_class(spark, sf_dir):
    return stop_events(spark, sf_dir).select("event_id", dl.delay_class("delay_arr_sec").alias("delay_class"))


@query("late_flag", sql("ev", """
    SELECT event_id, delay_arr_sec > 180 AS is_late_3min, delay_arr_sec > 60 AS is_late_1min FROM ev"""))
def late_flag(spark, sf_dir):
    return stop_events(spark, sf_dir).select(
        "event_id", dl.late_flag("delay_arr_sec").alias("is_late_3min"),
        dl.late_flag("delay_arr_sec", 60.0).alias("is_late_1min"))


@query("time_features", """
    SELECT event_id, hour(ts) AS hour, isodow(ts) - 1 AS weekday_num,
           ['Mo', 'Di', 'Mi', 'Do', 'Fr', 'Sa', 'So'][cast(isodow(ts) AS int)] AS weekday,
           isodow(ts) >= 6 AS is_weekend,
           isodow(ts) < 6 AND hour(ts) IN (6, 7, 8, 16, 17, 18) AS is_rush_hour
    FROM events""")
def time_features(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return rounded(events.withColumns(tm.time_features("ts")).drop("ts"))


@query("hour_floor", "SELECT event_id, date_trunc('hour', ts) AS ts_hour FROM events")
def hour_floor(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tm.hour_floor("ts").alias("ts_hour"))


@query("day_part", """
    SELECT event_id, CASE WHEN hour(ts) BETWEEN 1 AND 6 THEN 'Nacht' WHEN hour(ts) BETWEEN 7 AND 12 THEN 'Vormittag'
           WHEN hour(ts) BETWEEN 13 AND 18 THEN 'Nachmittag' WHEN hour(ts) > 18 THEN 'Abend' END AS day_part
    FROM events""")
def day_part(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tm.day_part(F.hour("ts")).alias("day_part"))


_STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


@query("keywords", f"""
    SELECT conv_id, turn, array_to_string(list_filter(
        regexp_extract_all(lower(text), '[a-zäöü]{{4,}}'), lambda w: NOT list_contains([{_STOP}], w)), ' ') AS keywords
    FROM conversations WHERE role = 'user'""")
def keywords(spark, sf_dir):
    """Keywords of all user questions, whole texts."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select(
        "conv_id", "turn", F.concat_ws(" ", tx.keywords("text")).alias("keywords"))


@query("effect_labels", sql_more("feat", """
    d AS (SELECT verkehrsmittel_text,
          (avg(delay_arr_sec) FILTER (NOT is_weekend) - avg(delay_arr_sec) FILTER (is_weekend))
          / sqrt((var_samp(delay_arr_sec) FILTER (NOT is_weekend) + var_samp(delay_arr_sec) FILTER (is_weekend)) / 2)
          AS d FROM feat GROUP BY verkehrsmittel_text)""", f"""
    SELECT verkehrsmittel_text, {r('d')},
           CASE WHEN abs(d) < 0.2 THEN 'vernachlaessigbar' WHEN abs(d) < 0.5 THEN 'klein'
                WHEN abs(d) < 0.8 THEN 'mittel' ELSE 'gross' END AS size,
           CASE WHEN abs(d) < 0.001 THEN '***' WHEN abs(d) < 0.01 THEN '**' WHEN abs(d) < 0.05 THEN '*'
                ELSE 'n.s.' END AS marks,
           CASE WHEN abs(d) < 0.06 THEN 'klein' WHEN abs(d) < 0.14 THEN 'mittel' ELSE 'gross' END AS eta_size
    FROM d"""))
def effect_labels(spark, sf_dir):
    """Weekday effect per type in words; the marks are applied to the same number."""
    df = feature_events(spark, sf_dir)
    one = F.when(~F.col("is_weekend"), F.col("delay_arr_sec"))
    two = F.when(F.col("is_weekend"), F.col("delay_arr_sec"))
    d = df.groupBy("verkehrsmittel_text").agg(F.try_divide(
        F.avg(one) - F.avg(two), F.sqrt((F.var_samp(one) + F.var_samp(two)) / 2)).alias("d"))
    return rounded(d.withColumns({
        "size": effect.cohen_label("d"), "marks": effect.stars(F.abs("d")),
        "eta_size": effect.eta_label(F.abs("d"))}))


@query("format_thousands", """
    SELECT o_orderkey, replace(format('{:,}', cast(floor(o_totalprice) AS bigint)), ',', '''') AS shown
    FROM orders""")
def format_thousands(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", tx.swiss_number(F.floor("o_totalprice")).alias("shown"))


@query("bonferroni", sql_more("ship", """
    c AS (SELECT verkehrsmittel_text, count(*) FILTER (is_late_3min) / cast(count(*) AS double) AS share
          FROM ship GROUP BY verkehrsmittel_text)""", f"""
    SELECT verkehrsmittel_text, {r('share')}, share < 0.05 AS significant_at_005,
           share < 0.0125 AS significant_at_bonferroni FROM c"""))
def bonferroni(spark, sf_dir):
    """Flags at both levels, here for the late share of each type in place of a p-value."""
    share = shipments(spark, sf_dir).groupBy("verkehrsmittel_text").agg(
        (gr.pct(F.col("is_late_3min")) / 100).alias("share"))
    return rounded(share.withColumns(effect.bonferroni_flags("share")))


@query("quality_nulls", sql_more("prep", """prep_all AS (
    SELECT *, NULL AS sloid, 'REAL' AS ab_prognose_status, false AS durchfahrt_tf FROM prep)""", " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{c}' AS "column", count(*) - count({c}) AS missing,
        {r(f"round_even(100.0 * (count(*) - count({c})) / count(*), 2) AS pct", digits=2)} FROM prep_all) WHERE missing > 0"""
    for c in PREPARED.fieldNames())))
def quality_nulls(spark, sf_dir):
    """All columns of the prepared table; one of them, sloid, is empty throughout."""
    return rounded(qu.null_report(prepared_events(spark, sf_dir)), 2)


@query("quality_duplicates", """
    SELECT cast(sum(n - 1) AS bigint) AS n_duplicates FROM (
        SELECT *, count(*) AS n FROM (
            SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1) GROUP BY ALL)""")
def quality_duplicates(spark, sf_dir):
    """All columns of the line items, with the first item of each order in the table twice."""
    items = table(spark, sf_dir, "lineitem")
    return qu.duplicate_rows(items.unionByName(items.where("l_linenumber = 1")))


@query("duplicate_texts", """
    SELECT cast(sum(n - 1) AS bigint) AS n_duplicates FROM (
        SELECT count(*) AS n FROM documents GROUP BY text, lang, source, n_chars)""")
def duplicate_texts(spark, sf_dir):
    """Exact duplicate documents, whole texts."""
    return qu.duplicate_rows(table(spark, sf_dir, "documents").drop("doc_id"))


@query("prepared_summary", sql("prep", """
    SELECT count(*) AS n_rows, min(betriebstag) AS first_day, max(betriebstag) AS last_day,
           count(temperatur_c) AS n_weather FROM prep"""))
def prepared_summary(spark, sf_dir):
    return qu.coverage(prepared_events(spark, sf_dir))
