"""All test results: as rows by section, and as one nested document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.delay import LATE_AFTER_SEC, known
from ..functions.effect import ALPHA_BONFERRONI, TEST_FAMILIES
from ..operators import hypothesis as h
from ..operators.grouped import day_range, group_means, top_by, value_counts
from ..operators.ranks import quantiles
from ..operators.regression import ols
from ..operators.shape import describe
from ..schemas import WEATHER_NAMES
from ..session import materialized


def result_rows(prepared: DataFrame, delay: str = "delay_arr_sec",
                kind: str = "verkehrsmittel_text", station: str = "haltestellen_name",
                more_than: int = 100, min_pairs: int = 1000, min_station: int = 1000) -> DataFrame:
    """(section, body): each result row as JSON; several rows where a section is a list."""
    valid = prepared.where(F.col(delay).isNotNull())
    weekend = F.col("is_weekend")
    present = set(valid.columns)
    weather = [c for c in WEATHER_NAMES.values() if c in present]
    fit = ols(valid, delay, ["niederschlag_mm", "temperatur_c"], ["is_rush_hour", "is_weekend", kind],
              also_known=["hour"])
    sections = {
        "settings": valid.sparkSession.range(1).select(
            F.lit(ALPHA_BONFERRONI).alias("alpha_bonferroni"),
            F.lit(TEST_FAMILIES).alias("n_test_families")),
        "events": prepared.agg(F.count("*").alias("n_total_events"),
                               F.count(delay).alias("n_valid_arrival")),
        "delay": describe(valid, delay),
        "test_welch_ttest": h.welch_test(valid, weekend, delay),
        "test_anova": h.with_f_test(h.anova(valid, kind, delay, more_than)),
        "anova_group": group_means(valid, kind, delay),
        "test_pearson": h.with_t_test(h.pearson(valid, weather, delay, min_pairs)),
        "test_spearman": h.with_t_test(h.spearman(valid, weather, delay, min_pairs)),
        "test_ols": fit,
        "top_station": top_by(group_means(valid, station, delay, min_station), "mean_delay", station, 10),
        "type_count": value_counts(valid, kind),
        "data_range": day_range(valid),
    }
    rows = [df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("body"))
            for name, df in sections.items()]
    return reduce(DataFrame.unionAll, rows)


def write_results(results: DataFrame, path: str) -> None:
    """One JSON object per line."""
    results.write.mode("overwrite").json(path)


#: What the document calls its tests.
TEST_NAMES = {"welch": "Welch's t-Test Werktag vs Wochenende", "anova": "One-Way ANOVA: Verspaetung nach Linien-Typ",
              "ols": "Multiple OLS-Regression"}
_NUMERIC, _FLAGS = ["niederschlag_mm", "temperatur_c"], ["is_rush_hour", "is_weekend"]


def _cells(prepared: DataFrame, delay: str, kind: str, station: str, day: str) -> DataFrame:
    """Counts, mean and variance per day, station, type and kind of day: read once, kept small."""
    x = known(delay)
    return materialized(prepared.groupBy(
        F.col(day).alias("day"), F.col(station).alias("station"), F.col(kind).alias("kind"), "is_weekend").agg(
        F.count("*").alias("rows"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"),
        F.count_if(x > LATE_AFTER_SEC).alias("late"), F.count_if(x <= 0).alias("early")))


def _pooled(cells: DataFrame, by: str) -> DataFrame:
    """(by, n, mean, var): the cells of each group as one, deviations taken from the overall mean."""
    n, gap = F.col("n"), F.col("mean") - F.col("_centre")
    centre = cells.agg(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n"))).scalar()
    sums = (cells.where((n > 0) & F.col(by).isNotNull()).withColumn("_centre", centre).groupBy(by).agg(
        F.sum("n").alias("n"), F.first("_centre").alias("_centre"), F.sum(n * gap).alias("_gap"),
        F.sum(n * (F.col("var") + gap * gap)).alias("_square")))
    away = F.col("_gap") / F.col("n")
    return sums.select(by, "n", (F.col("_centre") + away).alias("mean"), F.coalesce(
        F.try_divide(F.col("_square") - F.col("n") * away * away, F.col("n") - 1), F.lit(0.0)).alias("var"))


def _as_map(rows: DataFrame, key: str, value: Column, *order: Column) -> DataFrame:
    """One row with a map from key to value, in the given order (by key if none is given)."""
    entry = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(key).alias("key"), value.alias("value"))
    listed = F.array_sort(F.collect_list(entry))
    return rows.agg(F.map_from_entries(F.transform(listed, lambda e: F.struct(e["key"], e["value"]))).alias("m"))


def result_document(prepared: DataFrame, delay: str = "delay_arr_sec", kind: str = "verkehrsmittel_text",
                    station: str = "haltestellen_name", day: str = "betriebstag", more_than: int = 100,
                    min_pairs: int = 1000, min_station: int = 1000) -> DataFrame:
    """All results as one nested row, in the keys of the published result file.

    One pass over the events fills a small table of cells from which counts, shares, Welch's test, the
    analysis of variance, top stations and the range of days are read; quantiles, correlations and
    the fit take a pass of their own (ranks two).
    """
    cells = _cells(prepared, delay, kind, station, day)
    weather = [c for c in WEATHER_NAMES.values() if c in prepared.columns]

    total = cells.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_total_events"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_valid_arrival"),
        F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("mean_delay_sec"),
        F.try_divide(100.0 * F.sum("late"), F.sum("n")).alias("pct_classically_delayed"),
        F.try_divide(100.0 * F.sum("early"), F.sum("n")).alias("pct_early_or_punctual"))
    places = quantiles(prepared, delay, {"median": 0.5, "p95": 0.95}).select(F.struct("median", "p95")).scalar()

    flags = ["significant_at_005", "significant_at_bonferroni"]
    sides = _pooled(cells, "is_weekend").agg(*[
        F.max(F.when(F.col("is_weekend") == weekend, F.col(c))).alias(f"{c}{side}")
        for side, weekend in ((1, False), (2, True)) for c in ("n", "mean", "var")])
    welch = h.with_welch_p(h.welch_of(sides)).select(F.struct(
        F.lit(TEST_NAMES["welch"]).alias("name"), F.col("t").alias("t_statistic"), F.col("p").alias("p_value"),
        F.col("mean1").alias("mean_werktag_sec"), F.col("mean2").alias("mean_wochenende_sec"),
        F.col("n1").alias("n_werktag"), F.col("n2").alias("n_wochenende"), F.col("diff").alias("diff_sec"), "cohens_d",
        F.col("ci95_low").alias("diff_ci95_low"), F.col("ci95_high").alias("diff_ci95_high"), *flags).alias("d"))

    kinds = materialized(_pooled(cells, "kind"))
    tested = kinds.where(F.col("n") > more_than)
    names = tested.agg(F.array_sort(F.collect_list("kind"))).scalar()
    anova = h.with_f_test(h.anova_of(tested)).select(F.struct(
        F.lit(TEST_NAMES["anova"]).alias("name"), F.col("f").alias("f_statistic"), F.col("p").alias("p_value"), "df_between",
        "df_within", "eta_squared", names.alias("groups"), "n_groups",
        _as_map(kinds, "kind", F.col("mean")).scalar().alias("means_per_group"),
        _as_map(kinds, "kind", F.col("n")).scalar().alias("n_per_group"), *flags).alias("d"))

    pear = h.with_t_test(h.pearson(prepared, weather, delay, min_pairs))
    spear = h.with_t_test(h.spearman(prepared, weather, delay, min_pairs)).select(
        "variable", F.col("rho").alias("spearman_rho"), F.col("p").alias("spearman_p"))
    pairs = pear.join(spear, "variable").select("variable", F.struct(
        "n", F.col("r").alias("pearson_r"), F.col("p").alias("pearson_p"), F.col("ci95_low").alias("pearson_ci95_low"),
        F.col("ci95_high").alias("pearson_ci95_high"), "spearman_rho", "spearman_p", "significant_at_bonferroni").alias("d"))

    numeric = [c for c in _NUMERIC if c in prepared.columns]
    fit = ols(prepared, delay, numeric, [*_FLAGS, kind], also_known=["hour"])
    term = F.struct(F.col("coefficient").alias("value"), "p", "ci95_low", "ci95_high")
    listed = F.array_sort(F.collect_list(F.struct("term", term.alias("value"))))
    fitted = fit.groupBy("n", "r_squared", "adj_r_squared", "f", "f_p").agg(listed.alias("terms")).select(F.struct(
        F.lit(TEST_NAMES["ols"]).alias("name"),
        F.lit(f"{delay} ~ " + " + ".join([*[f"C({c})" for c in [*_FLAGS, kind]], *numeric])).alias("formula"),
        F.col("n").alias("n_observations"), "r_squared", "adj_r_squared", F.col("f").alias("f_statistic"),
        F.col("f_p").alias("f_p_value"), F.map_from_entries("terms").alias("coefficients")).alias("d"))

    top = top_by(_pooled(cells, "station").where(F.col("n") >= min_station), "mean", "station", 10)
    best = F.array_sort(F.collect_list(F.struct((-F.col("mean")).alias("o"), "station", "n", F.col("mean").alias("mean_sec"))))
    stations = top.agg(F.transform(best, lambda s: F.struct(s["station"], s["n"], s["mean_sec"])))
    days = cells.where((F.col("n") > 0) & F.col("day").isNotNull()).agg(F.struct(
        F.min("day").cast("string").alias("start"), F.max("day").cast("string").alias("end"),
        F.count_distinct("day").alias("n_days"), (F.datediff(F.max("day"), F.min("day")) + 1).cast("long").alias("n_calendar_span")))

    return total.withColumn("_at", places).select(
        F.lit(ALPHA_BONFERRONI).alias("alpha_bonferroni"), F.lit(TEST_FAMILIES).alias("n_test_families"),
        "n_total_events", "n_valid_arrival", "mean_delay_sec", F.col("_at.median").alias("median_delay_sec"),
        F.col("_at.p95").alias("p95_delay_sec"), "pct_classically_delayed", "pct_early_or_punctual",
        welch.scalar().alias("test_welch_ttest"), anova.scalar().alias("test_anova_linientyp"),
        F.array(*map(F.lit, weather)).cast("array<string>").alias("weather_columns_found"),
        _as_map(pairs, "variable", F.col("d")).scalar().alias("test_correlation"),
        fitted.scalar().alias("test_ols"), stations.scalar().alias("top_10_stations_highest_mean_delay"),
        _as_map(kinds, "kind", F.col("n"), -F.col("n")).scalar().alias("verkehrsmittel_text_distribution"),
        days.scalar().alias("data_range"))


def document_json(document: DataFrame) -> DataFrame:
    """The document as one text."""
    return document.select(F.to_json(F.struct(*document.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("document"))


def document_leaves(document: DataFrame) -> DataFrame:
    """(path, number, text): every single value of the nested document, flags as 0 and 1."""
    def leaves(path: Column, value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.concat(*[leaves(F.concat(path, F.lit(f".{f.name}")), value[f.name], f.dataType) for f in kind.fields])
        if isinstance(kind, T.MapType):
            found = F.flatten(F.transform(F.map_entries(value), lambda e: leaves(
                F.concat(path, F.lit("."), e["key"]), e["value"], kind.valueType)))
        elif isinstance(kind, T.ArrayType):
            found = F.flatten(F.transform(value, lambda x, i: leaves(
                F.concat(path, F.lit("."), i.cast("string")), x, kind.elementType)))
        else:
            is_text = isinstance(kind, T.StringType)
            return F.array(F.struct(
                path.alias("path"), (F.lit(None) if is_text else value).cast("double").alias("number"),
                (value if is_text else F.lit(None)).cast("string").alias("text")))
        return F.coalesce(found, F.array().cast("array<struct<path:string,number:double,text:string>>"))

    parts = [leaves(F.lit(f.name), F.col(f.name), f.dataType) for f in document.schema.fields]
    return document.select(F.explode(F.concat(*parts)).alias("leaf")).select("leaf.*")
