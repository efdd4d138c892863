"""Tests, correlations, regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from taktspur.functions.effect import stars
from taktspur.operators import hypothesis as h, regression as rg
from taktspur.plans import statistics as st

from .registry import query, r, rounded
from .sqlmath import RANGE_TAIL, chi2_p, f_p, least_squares, normal_p, t_95, t_p, term_rows
from .tables import feature_events, prepared_events, shipments, sql, sql_more, stored_prepared, table

_WELCH = r(
    "mean1", "mean2", "var1", "var2", "mean1 - mean2 AS diff", "sqrt(var1 / n1 + var2 / n2) AS se",
    "(mean1 - mean2) / sqrt(var1 / n1 + var2 / n2) AS t",
    "pow(var1 / n1 + var2 / n2, 2) / (pow(var1 / n1, 2) / (n1 - 1) + pow(var2 / n2, 2) / (n2 - 1)) AS df",
    "(mean1 - mean2) / sqrt((var1 + var2) / 2) AS cohens_d")


def _welch_sums(source, value, flag):
    return f"""s AS (SELECT count({value}) FILTER (NOT {flag}) AS n1, count({value}) FILTER ({flag}) AS n2,
        avg({value}) FILTER (NOT {flag}) AS mean1, avg({value}) FILTER ({flag}) AS mean2,
        var_samp({value}) FILTER (NOT {flag}) AS var1, var_samp({value}) FILTER ({flag}) AS var2 FROM {source})"""


@query("welch_stats", sql_more("feat", _welch_sums("feat", "delay_arr_sec", "is_weekend"),
                               f"SELECT n1, n2, {_WELCH} FROM s"))
def welch_stats(spark, sf_dir):
    return rounded(h.welch_stats(feature_events(spark, sf_dir), F.col("is_weekend")))


@query("welch_large", sql_more("ship", _welch_sums("ship", "delay_arr_sec", "(isodow(betriebstag) >= 6)"),
                               f"SELECT n1, n2, {_WELCH} FROM s"))
def welch_large(spark, sf_dir):
    return rounded(h.welch_stats(shipments(spark, sf_dir), F.weekday("betriebstag") >= 5))


def _tested(ctes, digits):
    """The figures of a Welch test with p, interval and flags."""
    return ctes + f""",
    w AS (SELECT *, mean1 - mean2 AS diff, sqrt(var1 / n1 + var2 / n2) AS se,
                 pow(var1 / n1 + var2 / n2, 2) / (pow(var1 / n1, 2) / (n1 - 1) + pow(var2 / n2, 2) / (n2 - 1)) AS df
          FROM s),
    p AS (SELECT *, diff / se AS t, {t_p("diff / se", "df")} AS p, {t_95("df")} AS t95 FROM w)""", f"""
    SELECT n1, n2, {r("t", "p", "diff - t95 * se AS ci95_low", "diff + t95 * se AS ci95_high", digits=digits)},
           p < 0.05 AS significant_at_005, p < 0.0125 AS significant_at_bonferroni FROM p"""


_TESTED = ["n1", "n2", "t", "p", "ci95_low", "ci95_high", "significant_at_005", "significant_at_bonferroni"]


@query("welch_test", sql_more("feat", *_tested(_welch_sums("feat", "delay_arr_sec", "is_weekend"), 6)))
def welch_test(spark, sf_dir):
    return rounded(h.welch_test(feature_events(spark, sf_dir), F.col("is_weekend")).select(*_TESTED))


@query("welch_test_large", sql_more("ship", *_tested(
    _welch_sums("ship", "delay_arr_sec", "(isodow(betriebstag) >= 6)"), 6)))
def welch_test_large(spark, sf_dir):
    return rounded(h.welch_test(shipments(spark, sf_dir), F.weekday("betriebstag") >= 5).select(*_TESTED))


_DAYS = """d AS (SELECT betriebstag, is_weekend, avg(delay_arr_sec) AS m FROM feat GROUP BY 1, 2),
    """


@query("welch_daily", sql_more("feat", _DAYS + _welch_sums("d", "m", "is_weekend"),
                               f"SELECT n1, n2, {_WELCH} FROM s"))
def welch_daily(spark, sf_dir):
    return rounded(h.welch_daily(feature_events(spark, sf_dir), F.col("is_weekend")))


@query("welch_daily_test", sql_more("feat", *_tested(_DAYS + _welch_sums("d", "m", "is_weekend"), 2)))
def welch_daily_test(spark, sf_dir):
    """Rounded to two places, as the SQL side only approximates the limit for few days."""
    out = h.welch_daily_test(feature_events(spark, sf_dir), F.col("is_weekend"))
    return rounded(out.select(*_TESTED), 2)


def _mann_whitney(source, value, flag):
    return f"""v AS (SELECT {value} AS v, count(*) AS c, count(*) FILTER (NOT {flag}) AS c1 FROM {source} GROUP BY 1),
    k AS (SELECT *, sum(c) OVER (ORDER BY v) - (c - 1) / 2.0 AS rk FROM v),
    s AS (SELECT cast(sum(c1) AS double) AS n1, cast(sum(c - c1) AS double) AS n2,
                 cast(sum(c1 * rk) AS double) AS r1,
                 sum(cast(c AS double) * c * c - c) AS ties FROM k),
    u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM s)"""


_MW = f"""SELECT cast(n1 AS bigint) AS n1, cast(n2 AS bigint) AS n2, {r('u', digits=1)},
    {r("(greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) AS z")}
    FROM u"""


@query("mann_whitney", sql_more("feat", _mann_whitney("feat", "delay_arr_sec", "is_weekend"), _MW))
def mann_whitney(spark, sf_dir):
    out = h.mann_whitney(feature_events(spark, sf_dir), F.col("is_weekend"))
    return rounded(out.withColumn("u", F.round("u", 1)))


@query("mann_whitney_large", sql_more("ship", _mann_whitney("ship", "delay_arr_sec", "(verkehrsmittel_text = 'R')"),
                                      _MW))
def mann_whitney_large(spark, sf_dir):
    """Fifty distinct values only: heavy ties."""
    out = h.mann_whitney(shipments(spark, sf_dir), F.col("verkehrsmittel_text") == "R")
    return rounded(out.withColumn("u", F.round("u", 1)))


_MWP = f""",
    z AS (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5)
                    / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM u)"""


@query("mann_whitney_test", sql_more(
    "feat", _mann_whitney("feat", "delay_arr_sec", "is_weekend") + _MWP,
    f"SELECT cast(n1 AS bigint) AS n1, cast(n2 AS bigint) AS n2, {r('z', normal_p('z') + ' AS p')} FROM z"))
def mann_whitney_test(spark, sf_dir):
    out = h.mann_whitney_test(feature_events(spark, sf_dir), F.col("is_weekend"))
    return rounded(out.select("n1", "n2", "z", "p"))


def _anova(source, where):
    return f"""g AS (SELECT verkehrsmittel_text, count(*) AS n, avg(delay_arr_sec) AS m,
                 coalesce(var_samp(delay_arr_sec), 0) AS v FROM {source} GROUP BY 1),
    p AS (SELECT * FROM g {where}),
    a AS (SELECT sum(n * m) / sum(n) AS gm FROM p),
    s AS (SELECT count(*) AS k, cast(sum(n) AS bigint) AS n, sum(n * (m - gm) * (m - gm)) AS ssb,
                 sum((n - 1) * v) AS ssw FROM p, a)"""


_F = f"""SELECT k AS n_groups, n, {r("(ssb / (k - 1)) / (ssw / (n - k)) AS f")}, k - 1 AS df_between,
    n - k AS df_within, {r("ssb / (ssb + ssw) AS eta_squared", digits=9)} FROM s"""


@query("anova", sql_more("feat", _anova("feat", "WHERE n > 100"), _F))
def anova(spark, sf_dir):
    out = h.anova(feature_events(spark, sf_dir), "verkehrsmittel_text")
    return rounded(out, 9).withColumn("f", F.round("f", 6))


@query("anova_top5", sql_more("feat", _anova("feat", "ORDER BY n DESC, verkehrsmittel_text LIMIT 5"), _F))
def anova_top5(spark, sf_dir):
    out = h.anova_top(feature_events(spark, sf_dir), "verkehrsmittel_text")
    return rounded(out, 9).withColumn("f", F.round("f", 6))


@query("anova_large", sql_more("ship", _anova("ship", "WHERE n > 100"), _F))
def anova_large(spark, sf_dir):
    out = h.anova(shipments(spark, sf_dir), "verkehrsmittel_text")
    return rounded(out, 9).withColumn("f", F.round("f", 6))


_FP = """,
    f AS (SELECT *, (ssb / (k - 1)) / (ssw / (n - k)) AS f FROM s)"""


@query("anova_test", sql_more("feat", _anova("feat", "WHERE n > 100") + _FP + f""",
    t AS (SELECT *, {f_p("f", "k - 1", "n - k")} AS p FROM f)""", f"""
    SELECT k AS n_groups, n, {r('f', 'p')}, p < 0.05 AS significant_at_005,
           p < 0.0125 AS significant_at_bonferroni FROM t"""))
def anova_test(spark, sf_dir):
    out = h.with_f_test(h.anova(feature_events(spark, sf_dir), "verkehrsmittel_text"))
    return rounded(out.select("n_groups", "n", "f", "p", "significant_at_005", "significant_at_bonferroni"))


_PAIRS = """
    SELECT x.verkehrsmittel_text AS group1, y.verkehrsmittel_text AS group2, y.m - x.m AS mean_diff,
           sqrt(ssw / (s.n - k) / 2 * (1.0 / x.n + 1.0 / y.n)) AS se,
           abs(y.m - x.m) / sqrt(ssw / (s.n - k) / 2 * (1.0 / x.n + 1.0 / y.n)) AS q, k, s.n - k AS df
    FROM p x JOIN p y ON x.verkehrsmittel_text < y.verkehrsmittel_text, s"""
_TOP5 = _anova("feat", "ORDER BY n DESC, verkehrsmittel_text LIMIT 5")


@query("tukey_pairs", sql_more("feat", _TOP5, f"""
    SELECT group1, group2, {r("mean_diff", "se", "q")}, k, df FROM ({_PAIRS})"""))
def tukey_pairs(spark, sf_dir):
    return rounded(h.tukey_pairs(feature_events(spark, sf_dir), "verkehrsmittel_text"))


# The limit of the 95 % interval: tails at places around it, and a polynomial through the six nearest.
_LIMIT = f"""(WITH pairs AS (SELECT q AS group1, 0 AS group2, q, k, df FROM
              (SELECT 3.2 + i * 0.1 AS q FROM range(20) t(i)), (SELECT any_value(k) AS k, any_value(df) AS df FROM compared)),
    {RANGE_TAIL},
    near AS (SELECT group1 AS q, ln(p) AS l FROM tails ORDER BY abs(ln(p) - ln(0.05)) LIMIT 6)
    SELECT sum(part) FROM (SELECT i.q * product((ln(0.05) - j.l) / (i.l - j.l)) AS part
                           FROM near i JOIN near j ON i.q <> j.q GROUP BY i.q))"""


@query("tukey_test", sql_more("feat", _TOP5 + f""",
    compared AS ({_PAIRS}), found AS (WITH pairs AS (SELECT * FROM compared), {RANGE_TAIL} SELECT * FROM tails)""", f"""
    SELECT group1, group2, {r("mean_diff", "se", "q")}, {r("p AS p_adjusted", digits=4)},
           {r("mean_diff - l * se AS ci95_low", "mean_diff + l * se AS ci95_high", digits=2)}, p < 0.05 AS reject
    FROM compared JOIN found USING (group1, group2), (SELECT {_LIMIT} AS l)"""))
def tukey_test(spark, sf_dir):
    out = rounded(h.tukey_test(feature_events(spark, sf_dir), "verkehrsmittel_text"))
    return out.select("group1", "group2", "mean_diff", "se", "q", F.round("p_adjusted", 4).alias("p_adjusted"),
                      *[(F.round(c, 2) + F.lit(0.0)).alias(c) for c in ("ci95_low", "ci95_high")], "reject")


_WEATHER = ["temperatur_c", "niederschlag_mm", "wind_ms", "feuchte_pct", "sonne_min"]


def _pearson(c):
    return f"""SELECT '{c}' AS variable, n, {r('r', digits=9)}, {r("r * sqrt((n - 2) / (1 - r * r)) AS t",
        "tanh(atanh(r) - 1.96 / sqrt(n - 3)) AS ci95_low", "tanh(atanh(r) + 1.96 / sqrt(n - 3)) AS ci95_high")}
        FROM (SELECT count(*) AS n, corr({c}, delay_arr_sec) AS r FROM prep WHERE {c} IS NOT NULL) WHERE n >= 1000"""


@query("pearson", sql("prep", " UNION ALL ".join(_pearson(c) for c in _WEATHER)))
def pearson(spark, sf_dir):
    out = rounded(h.pearson(prepared_events(spark, sf_dir), _WEATHER), 9)
    return out.withColumns({c: F.round(c, 6) for c in ("t", "ci95_low", "ci95_high")})


def _with_p(parts):
    return f"""SELECT variable, n, {r('t', t_p('t', 'n - 2') + ' AS p')} FROM ({' UNION ALL '.join(parts)})"""


def _r_and_t(c):
    return f"""SELECT '{c}' AS variable, n, r * sqrt((n - 2) / (1 - r * r)) AS t
        FROM (SELECT count(*) AS n, corr({c}, delay_arr_sec) AS r FROM prep WHERE {c} IS NOT NULL) WHERE n >= 1000"""


@query("pearson_test", sql("prep", _with_p(_r_and_t(c) for c in _WEATHER)))
def pearson_test(spark, sf_dir):
    tested = h.with_t_test(h.pearson(prepared_events(spark, sf_dir), _WEATHER))
    return rounded(tested.select("variable", "n", "t", "p"))


def _ranks(source, c, value):
    return f"""SELECT rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS rx,
            rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0 AS ry
        FROM {source} WHERE {c} IS NOT NULL"""


def _rho(source, c, value):
    return f"""SELECT '{c}' AS variable, n, rho, rho * sqrt((n - 2) / (1 - rho * rho)) AS t
        FROM (SELECT count(*) AS n, corr(rx, ry) AS rho FROM ({_ranks(source, c, value)})) WHERE n >= 1000"""


def _spearman(source, c, value):
    return f"SELECT variable, n, {r('rho', digits=9)}, {r('t')} FROM ({_rho(source, c, value)})"


@query("spearman", sql("prep", " UNION ALL ".join(_spearman("prep", c, "delay_arr_sec") for c in _WEATHER)))
def spearman(spark, sf_dir):
    out = rounded(h.spearman(prepared_events(spark, sf_dir), _WEATHER), 9)
    return out.withColumn("t", F.round("t", 6))


@query("spearman_large", _spearman("lineitem", "l_quantity", "l_extendedprice"))
def spearman_large(spark, sf_dir):
    out = rounded(h.spearman(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice"), 9)
    return out.withColumn("t", F.round("t", 6))


@query("spearman_test", sql("prep", _with_p(_rho("prep", c, "delay_arr_sec") for c in _WEATHER)))
def spearman_test(spark, sf_dir):
    tested = h.with_t_test(h.spearman(prepared_events(spark, sf_dir), _WEATHER))
    return rounded(tested.select("variable", "n", "t", "p"))


_WITH_WEATHER = """rows AS (SELECT * FROM prep WHERE temperatur_c IS NOT NULL)"""


@query("correlations_with_temperature", sql_more("prep", _WITH_WEATHER, f"""
    SELECT variable, n, {r("r AS pearson_r", "rho AS spearman_rho", digits=9)} FROM ("""
    + " UNION ALL ".join(f"""SELECT '{c}' AS variable, n, r, rho FROM
        (SELECT count(*) AS n, corr({c}, delay_arr_sec) AS r FROM rows WHERE {c} IS NOT NULL),
        (SELECT rho FROM ({_rho("rows", c, "delay_arr_sec")}))""" for c in _WEATHER[:3]) + ") WHERE n >= 1000"))
def correlations_with_temperature(spark, sf_dir):
    """Rain, temperature and wind over the rows that have a temperature at all."""
    events = prepared_events(spark, sf_dir)
    pear = h.pearson(events, _WEATHER[:3], only_with="temperatur_c").select("variable", "n", F.col("r").alias("pearson_r"))
    spear = h.spearman(events, _WEATHER[:3], only_with="temperatur_c").select("variable", F.col("rho").alias("spearman_rho"))
    return rounded(pear.join(spear, "variable"), 9)


_NUMERIC = ["niederschlag_mm", "temperatur_c", "wind_ms", "hour", "is_rush_hour_int", "is_weekend_int"]


def _regression_rows(spark, sf_dir):
    return prepared_events(spark, sf_dir).withColumns({
        "is_rush_hour_int": F.col("is_rush_hour").cast("int"),
        "is_weekend_int": F.col("is_weekend").cast("int")})


def _terms_sql(names, digits=4):
    """Coefficient table: error, t, p and interval of every term."""
    p = t_p("b@i / sqrt(s2 * v@i)", "n - k")
    rows = term_rows(names, "SELECT '@name' AS term, b@i AS coefficient, sqrt(s2 * v@i) AS std_error, "
                            f"b@i / sqrt(s2 * v@i) AS t, {p} AS p, {t_95('(n - k)')} AS t95, n, r2 FROM fit")
    columns = r("coefficient", "std_error", "t", "p", "coefficient - t95 * std_error AS ci95_low",
                "coefficient + t95 * std_error AS ci95_high", digits=digits)
    return f"term, {columns}", f"({rows})"


_KINDS = [f"{kind}{rare}" for kind in ("click", "purchase", "signup", "view") for rare in ("", "_N")]
_CATEGORICAL = {
    "C(is_rush_hour)[T.True]": "cast(is_rush_hour AS int)",
    "C(is_weekend)[T.True]": "cast(is_weekend AS int)",
    **{f"C(verkehrsmittel_text)[T.{kind}]": f"cast(verkehrsmittel_text = '{kind}' AS int)" for kind in _KINDS[1:]},
    "niederschlag_mm": "niederschlag_mm", "temperatur_c": "temperatur_c",
}


def _categorical_sql():
    ctes, names = least_squares("prep", "delay_arr_sec", _CATEGORICAL)
    columns, rows = _terms_sql(names)
    return sql_more("prep", ctes, f"SELECT {columns}, n, {r('r2 AS r_squared', digits=4)} FROM {rows}")


@query("ols_categorical", _categorical_sql())
def ols_categorical(spark, sf_dir):
    fit = rg.ols(prepared_events(spark, sf_dir), "delay_arr_sec", ["niederschlag_mm", "temperatur_c"],
                 ["is_rush_hour", "is_weekend", "verkehrsmittel_text"], also_known=["hour"])
    return rounded(fit.select("term", "coefficient", "std_error", "t", "p", "ci95_low", "ci95_high", "n",
                              "r_squared"), 4)


_NUMERIC_SQL = {"niederschlag_mm": "niederschlag_mm", "temperatur_c": "temperatur_c", "wind_ms": "wind_ms",
                "hour": "hour", "is_rush_hour_int": "cast(is_rush_hour AS int)",
                "is_weekend_int": "cast(is_weekend AS int)"}
_FIT, _TERMS = least_squares("prep", "delay_arr_sec", _NUMERIC_SQL, key="fahrt_bezeichner")
_COLUMNS, _ROWS = _terms_sql(_TERMS)


@query("ols_numeric", sql_more("prep", _FIT, f"""
    SELECT {_COLUMNS}, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*'
                            ELSE 'n.s.' END AS marks FROM {_ROWS}"""))
def ols_numeric(spark, sf_dir):
    fit = rg.coefficient_table(rg.ols(_regression_rows(spark, sf_dir), "delay_arr_sec", _NUMERIC))
    return rounded(fit.withColumn("marks", stars("p")), 4)


# The levels of the supplier are taken out by centring within each, then the rest is fitted on what is left.
_WAYS = {"l_returnflag": ["N", "R"], "l_linestatus": ["O"], "l_linenumber": ["2", "3", "4", "5", "6", "7"]}
_MANY = {**{f"C({c})[T.{v}]": (f"cast(cast({c} AS varchar) = '{v}' AS int)", f"d{c[2:]}{i}")
            for c, values in _WAYS.items() for i, v in enumerate(values)},
         "l_quantity": ("l_quantity", "dq"), "l_discount": ("l_discount", "dd")}


def _many_sql():
    centred = ", ".join(f"cast({e} AS double) - avg(cast({e} AS double)) OVER s AS {n}"
                        for e, n in [*_MANY.values(), ("l_extendedprice", "dy")])
    ctes, names = least_squares("within_supplier", "dy", {t: n for t, (_, n) in _MANY.items()}, intercept=False)
    apart = "(SELECT count(DISTINCT l_suppkey) FROM lineitem)"
    price = "(SELECT var_pop(l_extendedprice) * count(*) FROM lineitem)"
    rows = term_rows(names, f"SELECT '@name' AS term, b@i AS coefficient, sqrt(ssr / (n - k - {apart}) * v@i) AS std_error, "
                            f"n, 1 - ssr / {price} AS r2, n - k - {apart} AS df_resid FROM fit")
    return (f"WITH within_supplier AS (SELECT {centred} FROM lineitem WINDOW s AS (PARTITION BY l_suppkey)), {ctes} "
            f"SELECT term, {r('coefficient', 'std_error', digits=4)}, n, {r('r2 AS r_squared', digits=9)}, "
            f"df_resid FROM ({rows})")


@query("ols_many_levels", _many_sql())
def ols_many_levels(spark, sf_dir):
    """Four factors, one with a level per supplier; its own terms are left out of the result."""
    fit = rg.ols(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"],
                 ["l_suppkey", *_WAYS])
    shown = fit.where(~F.col("term").startswith("C(l_suppkey)") & (F.col("term") != "Intercept"))
    return rounded(shown.select("term", "coefficient", "std_error", "n", "r_squared", "df_resid"), 9).withColumns(
        {c: F.round(c, 4) for c in ("coefficient", "std_error")})


_TWO = """WITH x AS (SELECT l_extendedprice AS y, l_quantity AS a, l_discount AS b FROM lineitem),
    m AS (SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) AS aa, covar_pop(b, b) AS bb,
                 covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb, var_pop(y) AS yy FROM x),
    c AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS ca, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM m),
    z AS (SELECT *, (ca * ay + cb * yb) / yy AS r2, n * (yy - ca * ay - cb * yb) / (n - 3) AS s2 FROM c)"""


@query("ols_two", _TWO + " UNION ALL ".join(
    f" SELECT '{name}' AS term, {r(f'{coef} AS coefficient', f'{se} AS std_error', digits=4)}, n, "
    f"{r('r2 AS r_squared', digits=9)} FROM z"
    for name, coef, se in [
        ("Intercept", "my - ca * ma - cb * mb",
         "sqrt(s2 / n * (1 + (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / (aa * bb - ab * ab)))"),
        ("l_quantity", "ca", "sqrt(s2 / n * bb / (aa * bb - ab * ab))"),
        ("l_discount", "cb", "sqrt(s2 / n * aa / (aa * bb - ab * ab))")]))
def ols_two(spark, sf_dir):
    """Two regressors, for which the fit has a closed form."""
    fit = rg.ols(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return rounded(fit.select("term", "coefficient", "std_error", "n", "r_squared"), 9).withColumns(
        {c: F.round(c, 4) for c in ("coefficient", "std_error")})


@query("ols_one_factor", sql("ship", f"""
    SELECT CASE WHEN verkehrsmittel_text = 'A' THEN 'Intercept'
                ELSE concat('C(verkehrsmittel_text)[T.', verkehrsmittel_text, ']') END AS term,
           {r("avg(delay_arr_sec) - CASE WHEN verkehrsmittel_text = 'A' THEN 0 ELSE (SELECT avg(delay_arr_sec) FROM ship WHERE verkehrsmittel_text = 'A') END AS coefficient")}
    FROM ship GROUP BY verkehrsmittel_text"""))
def ols_one_factor(spark, sf_dir):
    """One factor: coefficients are differences of group means."""
    fit = rg.ols(shipments(spark, sf_dir), "delay_arr_sec", [], ["verkehrsmittel_text"])
    return rounded(fit.select("term", "coefficient"))


_F_OF_FIT = "(r2 / (k - 1)) / ((1 - r2) / (n - k))"


@query("ols_summary", sql_more("prep", _FIT, f"""
    SELECT n, {r("r2 AS r_squared", "1 - (1 - r2) * (n - 1) / (n - k) AS adj_r_squared", f"{_F_OF_FIT} AS f")},
           cast(k - 1 AS bigint) AS df_model, n - k AS df_resid, {r(f_p(_F_OF_FIT, "k - 1", "n - k") + " AS f_p")}
    FROM fit"""))
def ols_summary(spark, sf_dir):
    return rounded(rg.model_summary(rg.ols(_regression_rows(spark, sf_dir), "delay_arr_sec", _NUMERIC)))


@query("trend_line", sql("prep", f"""
    SELECT count(niederschlag_mm) AS n, {r("regr_slope(delay_arr_sec, niederschlag_mm) AS slope",
           "regr_intercept(delay_arr_sec, niederschlag_mm) AS intercept",
           "regr_r2(delay_arr_sec, niederschlag_mm) AS r_squared", digits=9)} FROM prep"""))
def trend_line(spark, sf_dir):
    return rounded(rg.trend_line(prepared_events(spark, sf_dir), "niederschlag_mm", "delay_arr_sec"), 9)


_EXPLAINED = " + ".join(f"pow(sum(a{i} * y * y), 2) / sum(a{i} * a{i})" for i in range(1, len(_TERMS)))


@query("breusch_pagan", sql_more("prep", _FIT + f""",
    aux AS (SELECT count(*) AS n, count(*) * ({_EXPLAINED}) / (count(*) * var_pop(y * y)) AS lm FROM rest)""", f"""
    SELECT n, {r("lm", digits=4)}, cast({len(_TERMS) - 1} AS bigint) AS df,
           {r(chi2_p("lm", len(_TERMS) - 1) + " AS p", digits=4)} FROM aux"""))
def breusch_pagan(spark, sf_dir):
    out = rg.breusch_pagan(_regression_rows(spark, sf_dir), "delay_arr_sec", _NUMERIC)
    return rounded(out.select("n", "lm", "df", "p"), 4)


@query("breusch_pagan_one", f"""
    WITH x AS (SELECT l_extendedprice AS y, l_quantity AS a FROM lineitem),
    c AS (SELECT regr_slope(y, a) AS s, regr_intercept(y, a) AS i FROM x),
    e AS (SELECT a, pow(y - i - s * a, 2) AS sq FROM x, c)
    SELECT count(*) AS n, {r("count(*) * pow(corr(a, sq), 2) AS lm", digits=4)} FROM e""")
def breusch_pagan_one(spark, sf_dir):
    """One regressor: LM is n times the squared correlation with the squared residuals."""
    out = rg.breusch_pagan(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])
    return rounded(out.select("n", "lm"), 4)


def _vif_sql():
    ctes, names = least_squares("prep", "delay_arr_sec", _NUMERIC_SQL, intercept=False)
    squares = ", ".join(f"sum(a{i} * a{i}) AS q{i}" for i in range(len(names)))
    return sql_more("prep", ctes, f"""SELECT * FROM ({term_rows(names, f"SELECT '@name' AS term, "
                    f"{r('q@i * v@i AS vif')} FROM fit, (SELECT {squares} FROM rows0)")})""")


@query("vif", _vif_sql())
def vif(spark, sf_dir):
    return rounded(rg.vif(_regression_rows(spark, sf_dir), _NUMERIC, also_known=["delay_arr_sec"]))


_UNCENTRED = "1 / (1 - pow(sum(l_quantity * l_extendedprice), 2) / (sum(l_quantity * l_quantity) * sum(l_extendedprice * l_extendedprice)))"


@query("vif_two", " UNION ALL ".join(
    f"SELECT '{c}' AS term, {r(f'{_UNCENTRED} AS vif')} FROM lineitem" for c in ("l_quantity", "l_extendedprice")))
def vif_two(spark, sf_dir):
    return rounded(rg.vif(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query("residuals", sql_more("prep", _FIT, f"""
    SELECT key AS fahrt_bezeichner, {r("target - y AS fitted", "y AS resid", digits=4)} FROM rest"""))
def residuals(spark, sf_dir):
    """Fitted values and residuals of all complete rows."""
    out = rg.residuals(_regression_rows(spark, sf_dir), "delay_arr_sec", _NUMERIC)
    return rounded(out.select("fahrt_bezeichner", "fitted", "resid"), 4)


@query("residuals_one", f"""
    WITH c AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i
               FROM lineitem)
    SELECT l_orderkey, l_linenumber, {r("i + s * l_quantity AS fitted", "l_extendedprice - i - s * l_quantity AS resid", digits=4)}
    FROM lineitem, c""")
def residuals_one(spark, sf_dir):
    out = rg.residuals(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])
    return rounded(out.select("l_orderkey", "l_linenumber", "fitted", "resid"), 4)


@query("results_json")
def results_json(spark, sf_dir):
    return st.result_rows(stored_prepared(spark, sf_dir), min_station=40)


def _leaves(prefix, source, *fields):
    """SQL: one row per field ('name' or 'expression AS name') of a one-row source."""
    rows = []
    for f in fields:
        expr, _, name = f.rpartition(" AS ")
        rows.append(f"SELECT '{prefix}{name}' AS path, cast({expr or name} AS double) AS number, cast(NULL AS varchar) AS text FROM {source}")
    return rows


def _texts(prefix, source, *fields):
    rows = []
    for f in fields:
        expr, _, name = f.rpartition(" AS ")
        rows.append(f"SELECT '{prefix}{name}' AS path, cast(NULL AS double) AS number, cast({expr} AS varchar) AS text FROM {source}")
    return rows


def _document_sql():
    made = {}

    def once(name, body):
        made[name] = body
        return name

    flags = ["p < 0.05 AS significant_at_005", "p < 0.0125 AS significant_at_bonferroni"]
    rows = _leaves("", "(SELECT 1)", "0.0125 AS alpha_bonferroni", "4 AS n_test_families")
    rows += _leaves("", "rows", "count(*) AS n_total_events", "count(delay_arr_sec) AS n_valid_arrival",
                    "avg(delay_arr_sec) AS mean_delay_sec", "quantile_cont(delay_arr_sec, 0.5) AS median_delay_sec",
                    "quantile_cont(delay_arr_sec, 0.95) AS p95_delay_sec",
                    "100.0 * count(*) FILTER (delay_arr_sec > 180) / count(delay_arr_sec) AS pct_classically_delayed",
                    "100.0 * count(*) FILTER (delay_arr_sec <= 0) / count(delay_arr_sec) AS pct_early_or_punctual")
    ctes, _ = _tested(_welch_sums("rows", "delay_arr_sec", "is_weekend"), 6)
    welch = once("welch_row", f"(WITH {ctes} SELECT * FROM p)")
    at = "test_welch_ttest."
    rows += _texts(at, welch, "'" + st.TEST_NAMES["welch"].replace("'", "''") + "' AS name")
    rows += _leaves(at, welch, "t AS t_statistic", "p AS p_value", "mean1 AS mean_werktag_sec", "mean2 AS mean_wochenende_sec",
                    "n1 AS n_werktag", "n2 AS n_wochenende", "diff AS diff_sec", "diff / sqrt((var1 + var2) / 2) AS cohens_d",
                    "diff - t95 * se AS diff_ci95_low", "diff + t95 * se AS diff_ci95_high", *flags)
    anova = once("anova_row", f"(WITH {_anova('rows', 'WHERE n > 100')}{_FP} SELECT *, {f_p('f', 'k - 1', 'n - k')} AS p FROM f)")
    groups = f"(WITH {_anova('rows', 'WHERE n > 100')} SELECT * FROM p)"
    kinds = f"(WITH {_anova('rows', 'WHERE n > 100')} SELECT * FROM g WHERE verkehrsmittel_text IS NOT NULL)"
    at = "test_anova_linientyp."
    rows += _texts(at, anova, f"'{st.TEST_NAMES['anova']}' AS name")
    rows += _leaves(at, anova, "f AS f_statistic", "p AS p_value", "k - 1 AS df_between", "n - k AS df_within",
                    "ssb / (ssb + ssw) AS eta_squared", "k AS n_groups", *flags)
    rows += [f"SELECT concat('{at}groups.', row_number() OVER (ORDER BY verkehrsmittel_text) - 1), NULL, verkehrsmittel_text FROM {groups}",
             f"SELECT concat('{at}means_per_group.', verkehrsmittel_text), m, NULL FROM {kinds}",
             f"SELECT concat('{at}n_per_group.', verkehrsmittel_text), n, NULL FROM {kinds}",
             f"SELECT concat('verkehrsmittel_text_distribution.', verkehrsmittel_text), n, NULL FROM {kinds}"]
    for i, c in enumerate(_WEATHER):
        rows += _texts("weather_columns_found.", "(SELECT 1)", f"'{c}' AS {i}")
        at = f"test_correlation.{c}."
        pear = (f"(SELECT *, {t_p('t', 'n - 2')} AS p FROM (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM (SELECT count(*) AS n, "
                f"corr({c}, delay_arr_sec) AS r FROM rows WHERE {c} IS NOT NULL) WHERE n >= 1000))")
        spear = once(f"spear{i}", f"(SELECT *, {t_p('t', 'n - 2')} AS p FROM ({_rho('rows', c, 'delay_arr_sec')}))")
        rows += _leaves(at, pear, "n", "r AS pearson_r", "p AS pearson_p", "tanh(atanh(r) - 1.96 / sqrt(n - 3)) AS pearson_ci95_low",
                        "tanh(atanh(r) + 1.96 / sqrt(n - 3)) AS pearson_ci95_high", flags[1])
        rows += _leaves(at, spear, "rho AS spearman_rho", "p AS spearman_p")
    ctes, names = least_squares("rows", "delay_arr_sec", _CATEGORICAL)
    fit = once("fit_row", f"(WITH {ctes} SELECT *, {_F_OF_FIT} AS f, {f_p(_F_OF_FIT, 'k - 1', 'n - k')} AS f_p FROM fit)")
    at = "test_ols."
    rows += _texts(at, "(SELECT 1)", f"'{st.TEST_NAMES['ols']}' AS name",
                   "'delay_arr_sec ~ C(is_rush_hour) + C(is_weekend) + C(verkehrsmittel_text) + niederschlag_mm + temperatur_c' AS formula")
    rows += _leaves(at, fit, "n AS n_observations", "r2 AS r_squared", "1 - (1 - r2) * (n - 1) / (n - k) AS adj_r_squared",
                    "f AS f_statistic", "f_p AS f_p_value")
    p = t_p("b@i / sqrt(s2 * v@i)", "n - k")
    terms = term_rows(names, f"SELECT '@name' AS term, b@i AS b, sqrt(s2 * v@i) AS se, {p} AS p, {t_95('(n - k)')} AS t95 FROM fit")
    table = once("fit_terms", f"(WITH {ctes} {terms})")
    for expr, name in (("b", "value"), ("p", "p"), ("b - t95 * se", "ci95_low"), ("b + t95 * se", "ci95_high")):
        rows.append(f"SELECT concat('test_ols.coefficients.', term, '.{name}'), {expr}, NULL FROM {table}")
    top = ("(SELECT *, row_number() OVER (ORDER BY m DESC, haltestellen_name) - 1 AS i FROM (SELECT haltestellen_name, count(*) AS n, "
           "avg(delay_arr_sec) AS m FROM rows GROUP BY 1 HAVING count(*) >= 40) ORDER BY m DESC, haltestellen_name LIMIT 10)")
    at = "top_10_stations_highest_mean_delay."
    rows += [f"SELECT concat('{at}', i, '.station'), NULL, haltestellen_name FROM {top}",
             f"SELECT concat('{at}', i, '.n'), n, NULL FROM {top}", f"SELECT concat('{at}', i, '.mean_sec'), m, NULL FROM {top}"]
    rows += _texts("data_range.", "rows", 'min(betriebstag) AS start', 'max(betriebstag) AS end')
    rows += _leaves("data_range.", "rows", "count(DISTINCT betriebstag) AS n_days",
                    "date_diff('day', min(betriebstag), max(betriebstag)) + 1 AS n_calendar_span")
    return sql_more("prep", "rows AS MATERIALIZED (SELECT * FROM prep), " + ", ".join(
        f"{name} AS MATERIALIZED {body}" for name, body in made.items()) + ", leaves AS (" + "\nUNION ALL ".join(rows) + ")",
                    f"SELECT path, {r('number', digits=4)}, text FROM leaves")


@query("result_document", _document_sql())
def result_document(spark, sf_dir):
    """Every value of the nested result document, by its path."""
    document = st.result_document(stored_prepared(spark, sf_dir), min_station=40)
    return rounded(st.document_leaves(document), 4)
