"""Tests and regressions against direct numpy and pandas calculations."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from taktspur.functions import dist
from taktspur.operators import hypothesis as h, regression as rg
from taktspur.plans.statistics import document_json, document_leaves, result_document, result_rows


def make(n=5000, seed=11):
    rng = np.random.default_rng(seed)
    kind = np.where(rng.random(n) < 0.62, "S", rng.choice(["IC", "IR", "RE", "EC", "AG", "NJ"], n))
    rain = np.where(rng.random(n) < 0.7, 0.0, np.round(rng.gamma(1, 2, n), 1))
    temp = np.round(rng.normal(12, 6, n), 1)
    weekend = rng.random(n) < 0.3
    rush = ~weekend & (rng.random(n) < 0.35)
    delay = np.round(45 + 10 * rush - 12 * weekend + 3 * rain - 0.2 * temp
                     + np.where(kind == "EC", 60, 0) + rng.gamma(1.2, 60, n) * (1 + rain / 5) - 70)
    pdf = pd.DataFrame({
        "delay_arr_sec": delay, "is_weekend": weekend, "is_rush_hour": rush, "verkehrsmittel_text": kind,
        "niederschlag_mm": rain, "temperatur_c": temp, "hour": rng.integers(0, 24, n),
        "betriebstag": pd.to_datetime("2026-04-01") + pd.to_timedelta(rng.integers(0, 30, n), "D"),
        "haltestellen_name": rng.choice(["A", "B", "C"], n)})
    pdf.loc[rng.random(n) < 0.05, "temperatur_c"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def data(spark):
    pdf = make()
    df = spark.createDataFrame(pdf).withColumn("betriebstag", F.col("betriebstag").cast("date"))
    return pdf, df.cache()


def test_welch(data):
    pdf, df = data
    a, b = (pdf.delay_arr_sec[pdf.is_weekend == w] for w in (False, True))
    row = h.welch_test(df, F.col("is_weekend")).first()
    ea, eb = a.var() / len(a), b.var() / len(b)
    assert row.t == pytest.approx((a.mean() - b.mean()) / math.sqrt(ea + eb))
    assert row.df == pytest.approx((ea + eb) ** 2 / (ea ** 2 / (len(a) - 1) + eb ** 2 / (len(b) - 1)))
    assert row.cohens_d == pytest.approx((a.mean() - b.mean()) / math.sqrt((a.var() + b.var()) / 2))
    assert row.ci95_low < row["diff"] < row.ci95_high and row.significant_at_bonferroni == (row.p < 0.0125)
    assert 10 ** row.log10_p == pytest.approx(row.p)


def test_published_welch_interval():
    # difference and t as published; the interval follows from both
    diff, t = 15.472700906758377, 94.97463161107054
    half = dist.t_critical(0.95, 1.6e6) * diff / t
    assert diff - half == pytest.approx(15.153395014793071, abs=1e-5)
    assert diff + half == pytest.approx(15.792006798723682, abs=1e-5)


def test_welch_on_daily_means_counts_a_mixed_day_twice(data):
    pdf, df = data
    daily = pdf.groupby(["betriebstag", "is_weekend"]).delay_arr_sec.mean().reset_index()
    row = h.welch_daily(df, F.col("is_weekend")).first()
    assert row.n1 + row.n2 == len(daily) > pdf.betriebstag.nunique()
    assert row.mean1 == pytest.approx(daily.delay_arr_sec[~daily.is_weekend].mean())


def test_mann_whitney(data):
    pdf, df = data
    ranks, one = pdf.delay_arr_sec.rank(), ~pdf.is_weekend
    n1, n2 = one.sum(), (~one).sum()
    n = n1 + n2
    u1 = ranks[one].sum() - n1 * (n1 + 1) / 2
    ties = (pdf.delay_arr_sec.value_counts() ** 3 - pdf.delay_arr_sec.value_counts()).sum()
    z = (max(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    row = h.mann_whitney_test(df, F.col("is_weekend")).first()
    assert (row.n1, row.n2, row.u) == (n1, n2, u1) and row.z == pytest.approx(z)
    assert row.p == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_anova_uses_large_groups_only(data):
    pdf, df = data
    for more_than in (100, 320):
        sizes = pdf.verkehrsmittel_text.value_counts()
        part = pdf[pdf.verkehrsmittel_text.isin(sizes[sizes > more_than].index)]
        groups = [g.delay_arr_sec for _, g in part.groupby("verkehrsmittel_text")]
        grand = part.delay_arr_sec.mean()
        ssb = sum(len(g) * (g.mean() - grand) ** 2 for g in groups)
        ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
        dfb, dfw = len(groups) - 1, len(part) - len(groups)
        row = h.with_f_test(h.anova(df, "verkehrsmittel_text", more_than=more_than)).first()
        assert row.f == pytest.approx(ssb / dfb / (ssw / dfw)) and (row.df_between, row.df_within) == (dfb, dfw)
        assert row.eta_squared == pytest.approx(ssb / (ssb + ssw))


def test_tukey_lists_each_pair_once(data):
    pdf, df = data
    rows = h.tukey_test(df, "verkehrsmittel_text", k=4).collect()
    top = pdf.verkehrsmittel_text.value_counts().rename_axis("t").reset_index(name="n")
    top = sorted(top.sort_values(["n", "t"], ascending=[False, True]).t.head(4))
    assert sorted((r.group1, r.group2) for r in rows) == [(a, b) for i, a in enumerate(top) for b in top[i + 1:]]
    means = pdf.groupby("verkehrsmittel_text").delay_arr_sec.mean()
    for r in rows:
        assert r.mean_diff == pytest.approx(means[r.group2] - means[r.group1])
        assert r.reject == (r.ci95_low > 0 or r.ci95_high < 0) == (r.p_adjusted < 0.05)


def test_pearson_and_spearman(data):
    pdf, df = data
    columns = ["temperatur_c", "niederschlag_mm"]
    pear = {r.variable: r for r in h.with_t_test(h.pearson(df, columns)).collect()}
    spear = {r.variable: r for r in h.with_t_test(h.spearman(df, columns)).collect()}
    for c in columns:
        part = pdf[[c, "delay_arr_sec"]].dropna()
        assert pear[c].n == spear[c].n == len(part)
        assert pear[c].r == pytest.approx(part[c].corr(part.delay_arr_sec))
        assert spear[c].rho == pytest.approx(part[c].rank().corr(part.delay_arr_sec.rank()))
    z, half = math.atanh(pear["temperatur_c"].r), 1.96 / math.sqrt(pear["temperatur_c"].n - 3)
    assert pear["temperatur_c"].ci95_low == pytest.approx(math.tanh(z - half))


def test_few_pairs_give_no_correlation(data):
    _, df = data
    assert h.pearson(df.limit(500), ["niederschlag_mm"]).isEmpty()
    assert h.spearman(df.limit(500), ["niederschlag_mm"]).isEmpty()


def design(pdf, factors, numeric):
    x = [np.ones(len(pdf))]
    names = ["Intercept"]
    for f in factors:
        for level in sorted(pdf[f].astype(str).unique())[1:]:
            x.append((pdf[f].astype(str) == level).to_numpy(float))
            names.append(f"C({f})[T.{level}]")
    for c in numeric:
        x.append(pdf[c].to_numpy(float))
        names.append(c)
    return np.column_stack(x), names


def direct_fit(x, y):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    resid = y - x @ beta
    df = len(y) - x.shape[1]
    s2 = resid @ resid / df
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * s2)
    return beta, se, resid, 1 - resid @ resid / ((y - y.mean()) @ (y - y.mean()))


FACTORS, NUMERIC = ["is_rush_hour", "is_weekend", "verkehrsmittel_text"], ["niederschlag_mm", "temperatur_c"]


def test_ols_with_factors(data):
    pdf, df = data
    part = pdf.dropna()
    x, names = design(part, FACTORS, NUMERIC)
    beta, se, _, r2 = direct_fit(x, part.delay_arr_sec.to_numpy())
    fit = {r.term: r for r in rg.ols(df, "delay_arr_sec", NUMERIC, FACTORS, also_known=["hour"]).collect()}
    assert set(fit) == set(names) and "C(is_weekend)[T.True]" in fit and "C(verkehrsmittel_text)[T.AG]" not in fit
    for i, name in enumerate(names):
        assert fit[name].coefficient == pytest.approx(beta[i], rel=1e-8)
        assert fit[name].std_error == pytest.approx(se[i], rel=1e-8)
        assert fit[name].ci95_low < fit[name].coefficient < fit[name].ci95_high
    row = fit["Intercept"]
    k, n = len(names) - 1, len(part)
    assert (row.n, row.df_model, row.df_resid) == (n, k, n - k - 1)
    assert row.r_squared == pytest.approx(r2) and row.f == pytest.approx(r2 / k / ((1 - r2) / (n - k - 1)))
    assert row.adj_r_squared == pytest.approx(1 - (1 - r2) * (n - 1) / (n - k - 1))


def test_ols_is_stable_far_from_zero(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(0, 1, 2000)
    pdf = pd.DataFrame({"a": a + 1e8, "y": 2.5 * a + rng.normal(0, 0.1, 2000) + 1e8})
    fit = {r.term: r for r in rg.ols(spark.createDataFrame(pdf), "y", ["a"]).collect()}
    beta, se, _, _ = direct_fit(np.column_stack([np.ones(2000), pdf.a - 1e8]), pdf.y.to_numpy() - 1e8)
    assert fit["a"].coefficient == pytest.approx(beta[1], rel=1e-6) and fit["a"].std_error == pytest.approx(se[1], rel=1e-6)


def test_ols_with_as_many_terms_as_rows_or_a_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0)], "a double, y double, c double")
    fit = {r.term: r for r in rg.ols(df, "y", ["a"]).collect()}
    assert fit["a"].coefficient == pytest.approx(2) and fit["a"].p is None and fit["a"].df_resid == 0
    more = df.unionAll(df).unionAll(spark.createDataFrame([(3.0, 7.0, 5.0)], df.schema))
    fit = {r.term: r for r in rg.ols(more, "y", ["a", "c"]).collect()}
    assert fit["a"].df_model == 1 and fit["a"].coefficient > 2


def test_three_factors_of_many_levels(spark):
    rng = np.random.default_rng(8)
    n = 20_000
    pdf = pd.DataFrame({f: rng.integers(0, 80, n) for f in "abc"}).map(lambda v: f"l{v:02d}")
    pdf.loc[rng.random(n) < 0.3, "a"] = "l07"
    pdf["x"] = rng.normal(5, 2, n) + pdf.b.str[1:].astype(int) / 40
    effect = {f: rng.normal(0, 3, 80) for f in "abc"}
    pdf["y"] = 4 + 1.5 * pdf.x + sum(effect[f][pdf[f].str[1:].astype(int)] for f in "abc") + rng.normal(0, 1, n)
    df = spark.createDataFrame(pdf)
    # One row in all, one per level, one per pair: not one per combination of three.
    assert rg._sums(df, "y", ["x"], list("abc")).count() <= 1 + 3 * 80 + 3 * 80 * 80 < 30_000
    x, names = design(pdf, list("abc"), ["x"])
    beta, se, resid, r2 = direct_fit(x, pdf.y.to_numpy())
    fit = {r.term: r for r in rg.ols(df, "y", ["x"], list("abc")).collect()}
    assert list(fit) == names
    for i, name in enumerate(names):
        assert fit[name].coefficient == pytest.approx(beta[i], rel=1e-7, abs=1e-9)
        assert fit[name].std_error == pytest.approx(se[i], rel=1e-7)
    assert fit["x"].r_squared == pytest.approx(r2, rel=1e-10) and fit["x"].df_resid == n - len(names)
    left = rg.residuals(df, "y", ["x"], list("abc")).toPandas()
    assert left.resid.pow(2).sum() == pytest.approx(resid @ resid)


def test_factors_that_depend_on_each_other(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": rng.integers(0, 12, 900)})
    pdf["b"], pdf["y"] = "g" + (pdf.a // 4).astype(str), pdf.a * 2.0 + rng.normal(0, 1, 900)
    pdf["a"] = pdf.a.map(lambda v: f"s{v:02d}")
    fit = rg.ols(spark.createDataFrame(pdf), "y", [], ["a", "b"]).toPandas().set_index("term")
    x, _ = design(pdf, ["a"], [])
    _, _, resid, r2 = direct_fit(x, pdf.y.to_numpy())
    assert fit.r_squared.iloc[0] == pytest.approx(r2) and fit.df_model.iloc[0] == 11
    left = rg.residuals(spark.createDataFrame(pdf), "y", [], ["a", "b"]).toPandas()
    assert left.resid.pow(2).sum() == pytest.approx(resid @ resid)


def test_one_flag_is_the_pooled_t_test(data):
    pdf, df = data
    a, b = (pdf.delay_arr_sec[pdf.is_weekend == w] for w in (False, True))
    pooled = ((len(a) - 1) * a.var() + (len(b) - 1) * b.var()) / (len(pdf) - 2)
    fit = {r.term: r for r in rg.ols(df, "delay_arr_sec", [], ["is_weekend"]).collect()}
    assert fit["C(is_weekend)[T.True]"].t == pytest.approx(
        (b.mean() - a.mean()) / math.sqrt(pooled * (1 / len(a) + 1 / len(b))))


def test_breusch_pagan_and_residuals(data):
    pdf, df = data
    part = pdf.dropna()
    x, _ = design(part, FACTORS, NUMERIC)
    beta, _, resid, _ = direct_fit(x, part.delay_arr_sec.to_numpy())
    _, _, _, aux = direct_fit(x, resid ** 2)
    row = rg.breusch_pagan(df, "delay_arr_sec", NUMERIC, FACTORS).first()
    assert row.lm == pytest.approx(len(part) * aux, rel=1e-6) and row.df == x.shape[1] - 1
    assert row.p == pytest.approx(math.exp(dist.log_chi2_upper(len(part) * aux, x.shape[1] - 1)))
    got = rg.residuals(df, "delay_arr_sec", NUMERIC, FACTORS).agg(
        F.sum("resid").alias("s"), F.sum(F.col("resid") * F.col("resid")).alias("ss")).first()
    assert got.s == pytest.approx(0, abs=1e-4) and got.ss == pytest.approx(resid @ resid)


def test_vif_has_no_intercept(data):
    pdf, df = data
    columns = ["niederschlag_mm", "temperatur_c", "hour"]
    x = pdf.dropna()[columns].to_numpy(float)
    got = {r.term: r.vif for r in rg.vif(df, columns).collect()}
    for i, c in enumerate(columns):
        others = np.delete(x, i, axis=1)
        beta, *_ = np.linalg.lstsq(others, x[:, i], rcond=None)
        left = x[:, i] - others @ beta
        assert got[c] == pytest.approx((x[:, i] @ x[:, i]) / (left @ left))


def test_trend_line(data):
    pdf, df = data
    slope, intercept = np.polyfit(pdf.niederschlag_mm, pdf.delay_arr_sec, 1)
    row = rg.trend_line(df, "niederschlag_mm", "delay_arr_sec").first()
    assert row.slope == pytest.approx(slope) and row.intercept == pytest.approx(intercept)


def test_tests_on_empty_and_constant_input(spark, data):
    _, df = data
    none = df.where("false")
    assert h.welch_stats(none, F.col("is_weekend")).first().t is None
    assert h.mann_whitney(none, F.col("is_weekend")).first().z is None
    assert h.anova(none, "verkehrsmittel_text").first().f is None
    flat = df.withColumn("delay_arr_sec", F.lit(1.0))
    assert h.welch_stats(flat, F.col("is_weekend")).first().t is None
    assert h.pearson(flat, ["niederschlag_mm"]).first().r is None
    assert h.spearman(flat, ["niederschlag_mm"]).first().rho is None
    assert h.mann_whitney_test(flat, F.col("is_weekend")).first().z is None
    assert rg.trend_line(flat.withColumn("x", F.lit(2.0)), "x", "delay_arr_sec").first().slope is None
    assert rg.trend_line(flat, "niederschlag_mm", "delay_arr_sec").first().slope == 0


def test_result_rows_hold_all_sections(data):
    _, df = data
    rows = result_rows(df.withColumns({"is_late_3min": F.col("delay_arr_sec") > 180}), min_station=10).collect()
    assert {r.section for r in rows} == {
        "settings", "events", "delay", "test_welch_ttest", "test_anova", "anova_group", "test_pearson",
        "test_spearman", "test_ols", "top_station", "type_count", "data_range"}
    assert all(r.body.startswith("{") for r in rows)


def test_result_document_is_one_nested_json(data):
    pdf, df = data
    df = df.withColumns({"is_late_3min": F.col("delay_arr_sec") > 180})
    document = result_document(df, min_station=10)
    body = json.loads(document_json(document).first().document)
    assert list(body) == [
        "alpha_bonferroni", "n_test_families", "n_total_events", "n_valid_arrival", "mean_delay_sec", "median_delay_sec",
        "p95_delay_sec", "pct_classically_delayed", "pct_early_or_punctual", "test_welch_ttest", "test_anova_linientyp",
        "weather_columns_found", "test_correlation", "test_ols", "top_10_stations_highest_mean_delay",
        "verkehrsmittel_text_distribution", "data_range"]
    x = pdf.delay_arr_sec
    assert (body["n_total_events"], body["n_valid_arrival"]) == (len(pdf), x.notna().sum())
    assert body["mean_delay_sec"] == pytest.approx(x.mean()) and body["p95_delay_sec"] == pytest.approx(x.quantile(0.95))
    welch, direct = body["test_welch_ttest"], h.welch_test(df, F.col("is_weekend")).first()
    assert welch["t_statistic"] == pytest.approx(direct.t, rel=1e-9) and welch["cohens_d"] == pytest.approx(direct.cohens_d, rel=1e-9)
    anova, direct = body["test_anova_linientyp"], h.anova(df, "verkehrsmittel_text").first()
    assert anova["f_statistic"] == pytest.approx(direct.f, rel=1e-9) and anova["n_groups"] == len(anova["groups"])
    assert anova["means_per_group"] == pytest.approx(pdf.groupby("verkehrsmittel_text").delay_arr_sec.mean().to_dict())
    assert set(body["test_correlation"]) <= set(body["weather_columns_found"])
    assert set(body["test_ols"]["coefficients"]) == {r.term for r in rg.ols(df, "delay_arr_sec", NUMERIC, FACTORS, also_known=["hour"]).collect()}
    means = [s["mean_sec"] for s in body["top_10_stations_highest_mean_delay"]]
    assert means == sorted(means, reverse=True)
    counts = list(body["verkehrsmittel_text_distribution"].values())
    assert counts == sorted(counts, reverse=True) and sum(counts) == len(pdf)
    leaves = document_leaves(document).collect()
    assert len({r.path for r in leaves}) == len(leaves) > 60


def test_vif_of_dependent_columns_is_infinite(spark):
    rows = [(float(i), 2.0 * i, float(i * i % 7), 0.0) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, c double, z double")
    got = {r.term: r.vif for r in rg.vif(df, ["a", "b", "c", "z"]).collect()}
    assert got["a"] == got["b"] == got["z"] == float("inf") and 1 <= got["c"] < 100
