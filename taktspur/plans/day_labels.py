"""Context of the worst days, the request made of it, and the labels that come back."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.delay import known
from ..functions.text import parsed_reply
from ..functions.time import day_part
from ..operators.grouped import daily, top_by
from ..session import materialized, new_run_dir
from ..sources.tables import optional_parquet

# The causes a reply may name, and prices per million tokens.
TAXONOMY = [
    "wetter_regen", "wetter_schnee_kalt", "wetter_sturm",
    "rush_hour_ueberlastung", "wochenende_baustelle",
    "stoerung_einzelner_bahnhof", "stoerung_netzweit",
    "saisonaler_betrieb", "unbestimmbar",
]
PRICE_IN, PRICE_OUT = 3.0, 15.0

# Causes, day, weekday, measurements as JSON.
REQUEST = ("Moegliche Ursachen:\n%s\n\n"
           "Messwerte des Tages %s (%s) als JSON:\n%s\n\n"
           "Nenne die Ursache, die am besten dazu passt.")

# Goes to the model with every request.
RULES = ('Du beurteilst Verspaetungen im oeffentlichen Verkehr. Stuetze dich nur auf die Messwerte der Anfrage; '
         'sind sie nicht eindeutig, ist die Ursache "unbestimmbar". Antworte mit genau einem JSON-Objekt mit den '
         'Feldern "primaere_ursache" (einer der moeglichen Ursachen), "begruendung" (zwei bis drei Saetze) und '
         '"konfidenz" (hoch, mittel oder niedrig).')

# A client takes the rules and a prompt and gives the reply with its token counts.
Client = Callable[[str, str], tuple[str, int, int]]

_ANSWERS = T.StructType([
    T.StructField("request", T.StringType()), T.StructField("reply", T.StringType()),
    T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType()),
    T.StructField("error", T.StringType())])
#: Requests asked between two writes of the answers, and by one task of these.
WAVE, PER_TASK = 512, 4


def day_context(prepared: DataFrame, days: DataFrame | None = None, day: str = "betriebstag",
                min_n: int = 50, k: int = 5) -> DataFrame:
    """Context of all days (or of the given ones) in one plan.

    Per day: rows, mean, late share, weekday of the first arrival, the k worst stations
    with at least min_n rows, weather means and most rain, mean per part of the day.
    """
    events = prepared.where(F.col(day).isNotNull())
    if days is not None:
        events = events.join(days.select(day).distinct(), day, "left_semi")
    delay, parts = known("delay_arr_sec"), day_part("hour")
    measures = {**{c: known(c) for c in ("temperatur_c", "niederschlag_mm", "wind_ms")},
                **{part: F.when(parts == part, delay) for part in ("Nacht", "Vormittag", "Nachmittag", "Abend")}}

    # One pass: days and stations are both read off the sums per day and station.
    cells = materialized(events.groupBy(day, "haltestellen_name").agg(
        F.min(F.struct("ankunftszeit", "weekday")).alias("first"), F.count("*").alias("rows"),
        F.count_if("is_late_3min").alias("late"), F.count(delay).alias("n"), F.sum(delay).alias("total"),
        F.max(known("niederschlag_mm")).alias("rain_max"),
        *[F.struct(F.sum(x).alias("total"), F.count(x).alias("n")).alias(name) for name, x in measures.items()]))

    def mean(name: str, digits: int) -> Column:
        average = F.try_divide(F.sum(f"{name}.total"), F.sum(f"{name}.n"))
        return F.bround(average, digits).alias(name)

    per_day = cells.groupBy(day).agg(
        F.min("first").alias("first"), F.sum("rows").alias("n_halte"),
        F.try_divide(F.sum("total"), F.sum("n")).alias("mean_delay"),
        (100.0 * F.sum("late") / F.sum("rows")).alias("pct_late_3min"),
        F.struct(mean("temperatur_c", 1), mean("niederschlag_mm", 1), mean("wind_ms", 1),
                 F.bround(F.max("rain_max"), 1).alias("niederschlag_max")).alias("weather"),
        F.struct(*[mean(part, 0) for part in ("Nacht", "Vormittag", "Nachmittag", "Abend")]).alias("by_daytime"),
    ).withColumn("first", F.col("first.weekday")).withColumnRenamed("first", "weekday")

    stations = cells.where(F.col("haltestellen_name").isNotNull() & (F.col("n") >= min_n)).select(
        day, "haltestellen_name", "n", (F.col("total") / F.col("n")).alias("mean_delay"))
    place = F.row_number().over(
        Window.partitionBy(day).orderBy(F.desc("mean_delay"), "haltestellen_name"))
    worst = stations.withColumn("place", place).where(F.col("place") <= k)
    entry = F.struct("place", F.col("haltestellen_name").alias("name"),
                     F.bround("mean_delay", 0).alias("mean_delay_sec"), F.col("n").alias("n_halte"))
    # At most k entries per day.
    lists = worst.groupBy(day).agg(F.array_sort(F.collect_list(entry)).alias("top"))
    listed = per_day.join(lists, day, "left")
    without_place = F.transform(F.coalesce("top", F.array()), lambda s: s.dropFields("place"))
    return listed.withColumn("top_stations", without_place).drop("top")


def worst_day_context(prepared: DataFrame, k_days: int = 10, **options) -> DataFrame:
    """Context of the days with the highest late share."""
    worst = top_by(daily(prepared), "pct_late_3min", "betriebstag", k_days)
    return day_context(prepared, worst, **options)


def prompt_rows(context: DataFrame, day: str = "betriebstag") -> DataFrame:
    """One request text per day: the causes, the day, its context as JSON with one digit after the point."""
    body = F.struct(F.col(day).cast("string").alias("date"), "weekday", "n_halte",
                    F.round("mean_delay", 1).alias("mean_delay"), F.round("pct_late_3min", 1).alias("pct_late_3min"),
                    "top_stations", "weather", "by_daytime")
    text = F.format_string(
        REQUEST, F.lit("\n".join(f"- {t}" for t in TAXONOMY)), F.col(day).cast("string"),
        F.coalesce("weekday", F.lit("?")),
        F.to_json(body, {"ignoreNullFields": "false"}))
    return context.withColumn("prompt", text)


def offline_client(rules: str, prompt: str) -> tuple[str, int, int]:
    """Stands in for a language model: names a cause from the numbers in the prompt."""
    context = json.loads(prompt[prompt.index("{"):prompt.rindex("}") + 1])
    weather = context["weather"]
    if (weather["niederschlag_mm"] or 0) > 1:
        cause = "wetter_regen"
    elif (weather["wind_ms"] or 0) > 10:
        cause = "wetter_sturm"
    elif context["weekday"] in ("Sa", "So"):
        cause = "wochenende_baustelle"
    else:
        cause = "unbestimmbar"
    reply = {"primaere_ursache": cause, "konfidenz": "niedrig",
             "begruendung": f"{context['pct_late_3min']:.1f} % der Halte verspaetet."}
    text = "Antwort: " + json.dumps(reply, ensure_ascii=False)
    return text, len(prompt) // 4, len(text) // 4


def ask(prompts: DataFrame, client: Client = offline_client, rules: str = RULES,
        answers: str | None = None) -> DataFrame:
    """Adds reply and token counts; the client runs on the executors.

    Answers are kept in the folder ``answers``, by a hash of rules and prompt, and written after every
    ``WAVE`` requests. Only requests without an answer there are asked, equal ones once, so that a run
    repeated after a failure, or with some days more, asks what is absent. A request whose client
    fails does not take others with it: their answers are written before the run ends with an
    error. A lost executor repeats at most the ``PER_TASK`` requests of each of its tasks. Without
    a folder the answers serve this frame only.
    """
    spark = prompts.sparkSession
    path = answers or new_run_dir(spark, "answers")
    request = F.sha2(F.concat(F.lit(rules), F.lit("\n"), F.col("prompt")), 256)
    asked = materialized(prompts.withColumn("request", request))
    distinct = materialized(asked.groupBy("request").agg(F.first("prompt").alias("prompt")))

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, prompt in zip(batch["request"], batch["prompt"]):
                try:
                    rows.append((key, *client(rules, prompt), None))
                except Exception as error:
                    rows.append((key, None, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["request", "reply", "input_tokens", "output_tokens", "error"]).astype(
                {"input_tokens": "Int64", "output_tokens": "Int64"})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _ANSWERS)
    while True:
        known = optional_parquet(spark, path, _ANSWERS).where("error is null").select(*_ANSWERS.names[:-1])
        absent = distinct.join(known, "request", "left_anti")
        wave = materialized(absent.orderBy("request").limit(WAVE))
        size = wave.count()
        if not size:
            break
        before = wave.select("request")
        wave.repartition(-(-size // PER_TASK), "request").mapInPandas(call, schema).write.mode("append").parquet(path)
        failed = (spark.read.schema(_ANSWERS).parquet(path).join(before, "request").groupBy("request")
                  .agg(F.count_if(F.col("error").isNull()).alias("ok"), F.max("error").alias("error"))
                  .where("ok = 0").agg(F.count("*").alias("n"), F.max("error").alias("error")).first())
        if failed["n"]:
            raise RuntimeError(f"{failed['n']} of {size} requests failed ({failed['error']}); the others are kept in {path}")
    one = known.groupBy("request").agg(F.first(F.struct("reply", "input_tokens", "output_tokens")).alias("a"))
    return asked.join(one, "request").select(*prompts.columns, "a.*")


def call_cost() -> Column:
    """Price of a call from its token counts."""
    return (F.col("input_tokens") * PRICE_IN + F.col("output_tokens") * PRICE_OUT) / 1e6


def classify_days(context: DataFrame, client: Client = offline_client, day: str = "betriebstag",
                  rules: str = RULES, answers: str | None = None) -> DataFrame:
    """One labelled row per context row, with the cost of its call; ``answers`` as for ``ask``."""
    requests = prompt_rows(context, day).select(
        day, "weekday", "pct_late_3min", "mean_delay", "prompt")
    answered = ask(requests, client, rules, answers)
    return answered.select(
        F.col(day).alias("datum"), F.col("weekday").alias("wochentag"),
        F.bround("pct_late_3min", 1).alias("pct_late_3min"),
        F.bround("mean_delay", 1).alias("mean_delay_s"),
        *[c.alias(name) for name, c in parsed_reply("reply").items()],
        call_cost().alias("cost"))


def total_cost(labelled: DataFrame) -> DataFrame:
    return labelled.agg(F.count("*").alias("n_calls"), F.sum("cost").alias("cost"))


def day_reasons(days: DataFrame, labels: DataFrame, day: str = "betriebstag") -> DataFrame:
    """Labels joined to the metrics of their day."""
    metrics = days.select(F.col(day).alias("datum"), F.bround("pct_late_3min", 1).alias("pct_late_3min"),
                          F.bround("mean_delay", 1).alias("mean_delay_s"))
    return metrics.join(
        labels.select("datum", "llm_ursache", "llm_konfidenz", "llm_begruendung"), "datum")
