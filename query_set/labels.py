"""Context of days, requests, replies, fact sheet."""

from __future__ import annotations

from pyspark.sql import functions as F

from taktspur.functions.text import parsed_reply
from taktspur.operators.grouped import daily, worst_days
from taktspur.plans import day_labels as dlb, fact_sheet

from .registry import query, r, rounded
from .tables import feature_events, prepared_events, sql, sql_more, stop_events, stored_prepared, table

_PARTS = {"Nacht": "hour BETWEEN 1 AND 6", "Vormittag": "hour BETWEEN 7 AND 12",
          "Nachmittag": "hour BETWEEN 13 AND 18", "Abend": "hour BETWEEN 19 AND 24"}


_TOP_STATIONS = """
    g AS (SELECT betriebstag, haltestellen_name, avg(delay_arr_sec) AS m, count(*) AS n FROM prep
          GROUP BY 1, 2 HAVING count(*) >= 3),
    worst AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY betriebstag
              ORDER BY m DESC, haltestellen_name) <= 5)"""


@query("day_context", sql_more("prep", _TOP_STATIONS + """,
    t AS (SELECT betriebstag, string_agg(concat(haltestellen_name, '|', cast(round_even(m, 0) AS bigint), '|', n), ';'
                 ORDER BY m DESC, haltestellen_name) AS top_stations
          FROM worst GROUP BY 1)""", f"""
    SELECT p.betriebstag, arg_min(weekday, ankunftszeit) AS weekday, count(*) AS n_halte,
           {r("avg(delay_arr_sec) AS mean_delay", "100.0 * count(*) FILTER (is_late_3min) / count(*) AS pct_late_3min",
              "round_even(avg(temperatur_c), 1) AS temperatur_c", "round_even(avg(niederschlag_mm), 1) AS niederschlag_mm",
              "round_even(avg(wind_ms), 1) AS wind_ms", "round_even(max(niederschlag_mm), 1) AS niederschlag_max",
              *[f"round_even(avg(delay_arr_sec) FILTER ({c}), 0) AS {name}" for name, c in _PARTS.items()])},
           coalesce(any_value(top_stations), '') AS top_stations
    FROM prep p LEFT JOIN t ON t.betriebstag = p.betriebstag GROUP BY p.betriebstag"""))
def day_context(spark, sf_dir):
    """Context of every day, flattened to plain columns."""
    out = dlb.day_context(prepared_events(spark, sf_dir), min_n=3)
    listed = F.transform("top_stations", lambda s: F.concat_ws(
        "|", s["name"], s["mean_delay_sec"].cast("bigint").cast("string"), s["n_halte"].cast("string")))
    return rounded(out.select(
        "betriebstag", "weekday", "n_halte", "mean_delay", "pct_late_3min", "weather.*", "by_daytime.*",
        F.concat_ws(";", listed).alias("top_stations")))


_CAUSES = "\n".join(f"- {c}" for c in dlb.TAXONOMY)
_MEANS = {"temperatur_c": "avg(temperatur_c)", "niederschlag_mm": "avg(niederschlag_mm)", "wind_ms": "avg(wind_ms)",
          "niederschlag_max": "max(niederschlag_mm)"}

# The ten worst days with the text of their request.
_REQUESTS = _TOP_STATIONS + f""",
    listed AS (SELECT betriebstag, list({{'name': haltestellen_name, 'mean_delay_sec': round_even(m, 0), 'n_halte': n}}
                      ORDER BY m DESC, haltestellen_name) AS top FROM worst GROUP BY 1),
    context AS (
        SELECT p.betriebstag, arg_min(weekday, ankunftszeit) AS wd, count(*) AS n, avg(delay_arr_sec) AS m,
               100.0 * count(*) FILTER (is_late_3min) / count(*) AS p,
               coalesce(any_value(top), []) AS top,
               {{{", ".join(f"'{k}': round_even({v}, 1)" for k, v in _MEANS.items())}}} AS weather,
               {{{", ".join(f"'{k}': round_even(avg(delay_arr_sec) FILTER ({c}), 0)" for k, c in _PARTS.items())}}} AS parts
        FROM prep p LEFT JOIN listed l ON l.betriebstag = p.betriebstag GROUP BY p.betriebstag
        ORDER BY p DESC, p.betriebstag LIMIT 10),
    requests AS (
        SELECT *, concat('Moegliche Ursachen:\n{_CAUSES}\n\nMesswerte des Tages ', betriebstag, ' (', coalesce(wd, '?'), ') als JSON:\n',
                         to_json({{'date': cast(betriebstag AS varchar), 'weekday': wd, 'n_halte': n, 'mean_delay': round(m, 1),
                                  'pct_late_3min': round(p, 1), 'top_stations': top, 'weather': weather, 'by_daytime': parts}}),
                         '\n\nNenne die Ursache, die am besten dazu passt.') AS prompt FROM context)"""


@query("prompt_rows", sql_more("prep", _REQUESTS, "SELECT betriebstag, prompt FROM requests"))
def prompt_rows(spark, sf_dir):
    """The requests about the ten worst days, word for word."""
    context = dlb.worst_day_context(stored_prepared(spark, sf_dir), min_n=3)
    return dlb.prompt_rows(context).select("betriebstag", "prompt")


_LABELLED = _REQUESTS + """,
    labelled AS (SELECT *, coalesce(weather.niederschlag_mm, 0) AS rain,
                        CASE WHEN coalesce(weather.niederschlag_mm, 0) > 1 THEN 'wetter_regen'
                             WHEN coalesce(weather.wind_ms, 0) > 10 THEN 'wetter_sturm'
                             WHEN wd IN ('Sa', 'So') THEN 'wochenende_baustelle' ELSE 'unbestimmbar' END AS cause,
                        printf('%.1f %% der Halte verspaetet.', round(p, 1)) AS reason FROM requests)"""


@query("classify_days", sql_more("prep", _LABELLED, f"""
    SELECT betriebstag AS datum, wd AS wochentag, {r("round_even(p, 1) AS pct_late_3min", "round_even(m, 1) AS mean_delay_s")},
           cause AS llm_ursache, 'niedrig' AS llm_konfidenz, reason AS llm_begruendung,
           {r("((length(prompt) // 4) * 3.0 + (length(concat('Antwort: {\"primaere_ursache\": \"', cause, '\", \"konfidenz\": \"niedrig\", \"begruendung\": \"', reason, '\"}')) // 4) * 15.0) / 1000000 AS cost", digits=9)} FROM labelled"""))
def classify_days(spark, sf_dir):
    """The ten worst days labelled by the offline stand-in for a model, with the cost of each call."""
    context = dlb.worst_day_context(stored_prepared(spark, sf_dir), min_n=3)
    return rounded(dlb.classify_days(context), 9)


_REPLY = """CASE WHEN event_type = 'error' THEN props
    WHEN event_type = 'view' THEN concat('Antwort: ', replace(props, '{', ''), ' Ende')
    WHEN event_type = 'click' THEN concat('Antwort: {', props, ' Ende')
    WHEN event_type = 'signup' THEN concat('Antwort: {"konfidenz": "hoch", "begruendung": "Halt ', user_id, '"} Ende')
    ELSE concat('Antwort: {"primaere_ursache": "wetter_regen", "konfidenz": "mittel", "begruendung": "Wert ', value, '"}') END"""


@query("parse_reply", f"""
    WITH t AS (SELECT event_id, {_REPLY} AS reply FROM events),
    b AS (SELECT event_id, nullif(regexp_extract(reply, '(?s)\\{{.*\\}}'), '') AS body FROM t),
    j AS (SELECT event_id, CASE WHEN json_valid(body) THEN body END AS j FROM b)
    SELECT event_id,
           CASE WHEN j IS NULL THEN 'parse_error' ELSE coalesce(json_extract_string(j, '$.primaere_ursache'), 'fehler') END AS llm_ursache,
           coalesce(json_extract_string(j, '$.konfidenz'), 'niedrig') AS llm_konfidenz,
           CASE WHEN j IS NULL THEN 'JSON-Parse-Fehler' ELSE coalesce(json_extract_string(j, '$.begruendung'), '') END AS llm_begruendung
    FROM j""")
def parse_reply(spark, sf_dir):
    """Replies with a full object, without a cause, without an object, with broken JSON."""
    replies = table(spark, sf_dir, "events").select("event_id", F.expr(_REPLY).alias("reply"))
    return replies.withColumns(parsed_reply("reply")).drop("reply")



@query("day_reasons", sql_more("feat", """
    d AS (SELECT betriebstag, count(*) AS n, avg(delay_arr_sec) AS m,
                 100.0 * count(*) FILTER (is_late_3min) / count(*) AS p FROM feat GROUP BY 1),
    w AS (SELECT * FROM d ORDER BY p DESC, betriebstag LIMIT 10),
    l AS (SELECT betriebstag AS day, CASE WHEN count(*) FILTER (faellt_aus_tf) > count(*) * 0.2 THEN 'stoerung_netzweit'
                 ELSE 'unbestimmbar' END AS cause FROM ev GROUP BY 1)""", f"""
    SELECT betriebstag AS datum, {r("round_even(p, 1) AS pct_late_3min", "round_even(m, 1) AS mean_delay_s")},
           cause AS llm_ursache, 'niedrig' AS llm_konfidenz, '' AS llm_begruendung
    FROM w JOIN l ON l.day = w.betriebstag"""))
def day_reasons(spark, sf_dir):
    """Labels per day, here by the share of cancelled stops, joined to the ten worst days."""
    labels = stop_events(spark, sf_dir).groupBy(F.col("betriebstag").alias("datum")).agg(
        F.when(F.count_if("faellt_aus_tf") > F.count("*") * 0.2, "stoerung_netzweit")
        .otherwise("unbestimmbar").alias("llm_ursache"),
    ).withColumns({"llm_konfidenz": F.lit("niedrig"), "llm_begruendung": F.lit("")})
    return rounded(dlb.day_reasons(worst_days(feature_events(spark, sf_dir)), labels))


QUESTION = "Wie pünktlich ist der Halt 17 am Morgen?"

_OVERALL = {"mean_delay": "true", "workday": "NOT is_weekend", "weekend": "is_weekend",
            "rush_hour": "is_rush_hour", "off_peak": "NOT is_rush_hour"}


_FACTS = f"""
    st AS (SELECT haltestellen_name AS s, avg(delay_arr_sec) AS m, count(*) AS n FROM prep GROUP BY 1),
    facts AS (
        SELECT 'period' AS section, concat(min(betriebstag), ' bis ', max(betriebstag)) AS key,
               count(DISTINCT betriebstag) AS value, NULL AS n FROM prep
        UNION ALL SELECT 'overall' AS section, 'pct_late' AS key,
               100.0 * count(*) FILTER (is_late_3min) / count(*) AS value, count(*) AS n FROM prep
        {" ".join(f"UNION ALL SELECT 'overall', '{k}', avg(delay_arr_sec), count(*) FROM prep WHERE {c}" for k, c in _OVERALL.items())}
        UNION ALL SELECT 'hour', cast(hour AS varchar), round_even(avg(delay_arr_sec), 0), count(*) FROM prep GROUP BY hour
        UNION ALL SELECT 'type', verkehrsmittel_text, avg(delay_arr_sec), count(*) FROM prep GROUP BY 2 HAVING count(*) >= 100
        UNION ALL (SELECT 'worst_station', s, m, n FROM st WHERE n >= 40 ORDER BY m DESC, s LIMIT 5)
        UNION ALL (SELECT 'asked_station', s, m, n FROM st WHERE n >= 30
                   AND (contains(lower(s), 'halt') OR contains(lower(s), 'morgen')) ORDER BY n DESC, s LIMIT 8)
        UNION ALL SELECT 'weather', 'rain', avg(delay_arr_sec) FILTER (niederschlag_mm > 0), count(niederschlag_mm) FROM prep
                  HAVING count(niederschlag_mm) > 1000
        UNION ALL SELECT 'weather', 'dry', avg(delay_arr_sec) FILTER (niederschlag_mm = 0), count(niederschlag_mm) FROM prep
                  HAVING count(niederschlag_mm) > 1000)"""


@query("fact_sheet", sql_more("prep", _FACTS, f"SELECT section, key, {r('value')}, n FROM facts"))
def facts(spark, sf_dir):
    return rounded(fact_sheet.fact_rows(prepared_events(spark, sf_dir), QUESTION, min_worst=40))


_SECTION_LIST = ", ".join(f"'{name}'" for name in fact_sheet.SECTIONS)


@query("fact_sheet_lines", sql_more("prep", _FACTS + "," + _LABELLED + """,
    sheet AS (SELECT section, key, cast(value AS double) AS value, n FROM facts
              UNION ALL (SELECT 'worst_day', concat_ws(' ', cast(betriebstag AS varchar), wd, cause), round_even(p, 1), NULL
                         FROM labelled ORDER BY round_even(p, 1) DESC, betriebstag LIMIT 5))""", f"""
    SELECT cast(list_position([{_SECTION_LIST}], section) AS bigint) AS section_no, section, key,
           concat(key, ': ', format('{{:,.1f}}', value),
                  CASE WHEN n IS NULL THEN '' ELSE concat(' (n=', replace(format('{{:,}}', cast(n AS bigint)), ',', ''''), ')') END) AS line
    FROM sheet"""))
def fact_lines(spark, sf_dir):
    """The same as text lines in reading order, with the five worst labelled days."""
    prepared = stored_prepared(spark, sf_dir)
    reasons = dlb.classify_days(dlb.worst_day_context(prepared, min_n=3))
    lines = fact_sheet.fact_lines(fact_sheet.fact_rows(prepared, QUESTION, reasons, min_worst=40))
    return rounded(lines)


@query("fact_sheet_text", sql_more("prep", _FACTS, f"""
    SELECT string_agg(line, chr(10) ORDER BY section_no, place, key) AS text FROM (
        SELECT key, list_position([{_SECTION_LIST}], section) AS section_no,
               CASE section WHEN 'hour' THEN try_cast(key AS double) WHEN 'type' THEN value
                    WHEN 'asked_station' THEN -n WHEN 'worst_station' THEN -value ELSE 0 END AS place,
               concat(section, ' | ', key, ': ',
                      CASE WHEN section IN ('hour', 'period') THEN format('{{:,.0f}}', round_even(round(cast(value AS double), 6), 0))
                           WHEN key = 'pct_late' THEN format('{{:,.2f}}', round_even(round(cast(value AS double), 6), 2))
                           ELSE format('{{:,.1f}}', round_even(round(cast(value AS double), 6), 1)) END,
                      CASE WHEN n IS NULL THEN '' ELSE concat(' (n=', replace(format('{{:,}}', cast(n AS bigint)), ',', ''''), ')') END) AS line
        FROM (SELECT section, CASE WHEN section = 'hour' THEN try_cast(key AS int)::varchar ELSE key END AS key, value, n
              FROM facts))"""))
def fact_text(spark, sf_dir):
    """The same as one text."""
    return fact_sheet.fact_text(fact_sheet.fact_rows(prepared_events(spark, sf_dir), QUESTION, min_worst=40))


@query("daily", sql("feat", f"""
    SELECT betriebstag, count(*) AS n_halte, {r("avg(delay_arr_sec) AS mean_delay",
           "100.0 * count(*) FILTER (is_late_3min) / count(*) AS pct_late_3min")} FROM feat GROUP BY betriebstag"""))
def daily_rows(spark, sf_dir):
    return rounded(daily(feature_events(spark, sf_dir)))
