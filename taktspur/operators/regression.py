"""Least squares with numeric and categorical regressors, and its diagnostics.

One pass reduces the events to counts and means per level of each factor, counts per pair of levels
of two factors, and the overall covariances (grouping sets, numerically stable aggregates). These
sums alone meet numpy, in one task: their number depends on levels and pairs of levels, never on
combinations of more factors nor on the events.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dist import chi2_p, log_f_upper, log_t_two_sided, t_critical
from ..functions.delay import known
from ..session import materialized
from .filters import has_value
from .joins import lookup

#: Share of a column's squared length that must be left for it to count as independent of the others.
SINGULAR = 1e-11

_FIT_SCHEMA = (
    "term string, coefficient double, std_error double, t double, p double, ci95_low double, "
    "ci95_high double, n bigint, r_squared double, adj_r_squared double, f double, "
    "df_model bigint, df_resid bigint, f_p double"
)


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without null or NaN in the listed columns."""
    kinds = dict(df.dtypes)
    for c in columns:
        df = df.where(has_value(c) if kinds[c] in ("double", "float") else F.col(c).isNotNull())
    return df


def _sums(df: DataFrame, response: str, numeric: list[str], factors: list[str]) -> DataFrame:
    """n, means (m0, m1, ...) and covariances (c0_0, ...) of response and numerics: over all rows, per
    level of a factor, and per pair of levels of two factors. ``f0``, ... are null outside their set."""
    kept = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate([response, *numeric])],
                     *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(factors)])
    width = 1 + len(numeric)
    aggs = [F.count("*").alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(width)]]
    aggs += [F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i in range(width) for j in range(i, width)]
    if not factors:
        return kept.agg(*aggs).where("n > 0")
    keys = [f"f{i}" for i in range(len(factors))]
    sets = [[], *[[k] for k in keys], *map(list, combinations(keys, 2))]
    # The set of all rows has a row even where there are none.
    return kept.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(*aggs).where("n > 0")


class _Sums:
    """The sums by set, with the factor of most levels set apart.

    Its dummies are orthogonal to each other, so that its block of the normal equations is a diagonal
    and is eliminated exactly; only the other columns are solved for as a full matrix. Without
    factors all rows are one level.
    """

    def __init__(self, rows: pd.DataFrame, numeric: list[str], factors: list[str]):
        keys = [f"f{i}" for i in range(len(factors))]
        width = 1 + len(numeric)
        used = rows[keys].notna().sum(axis=1) if keys else pd.Series(0, index=rows.index)
        every = rows[used == 0].iloc[0]
        self.n = int(every["n"])
        self.centre = np.array([every[f"m{i}"] for i in range(width)])
        self.cross = self.n * np.array([[every[f"c{min(i, j)}_{max(i, j)}"] for j in range(width)] for i in range(width)])
        means = [f"m{i}" for i in range(width)]

        single = {k: rows[(used == 1) & rows[k].notna()].sort_values(k) for k in keys}
        self.levels = [single[k][k].tolist() for k in keys]
        # The levels that have a column of their own in the full matrix: all but each first one.
        self.apart = max(range(len(keys)), key=lambda i: len(self.levels[i])) if keys else None
        self.others = [i for i in range(len(keys)) if i != self.apart]
        start, at = 0, {}
        for i in self.others:
            at[i] = {level: start + j for j, level in enumerate(self.levels[i][1:])}
            start += len(at[i])
        self.dummies = start
        size = start + len(numeric)

        self.products, self.target = np.zeros((size, size)), np.zeros(size)
        for i in self.others:
            part = single[keys[i]].iloc[1:]
            place = np.fromiter(at[i].values(), int, len(at[i]))
            n = part["n"].to_numpy(float)
            gap = part[means].to_numpy(float) - self.centre
            self.products[place, place] = n
            self.products[place, start:] = n[:, None] * gap[:, 1:]
            self.products[start:, place] = (n[:, None] * gap[:, 1:]).T
            self.target[place] = n * gap[:, 0]
        self.products[start:, start:] = self.cross[1:, 1:]
        self.target[start:] = self.cross[1:, 0]

        # Each level that is set apart: its rows, mean gap of the response, and mean of the other columns.
        if keys:
            own = single[keys[self.apart]]
            row = {level: j for j, level in enumerate(self.levels[self.apart])}
            self.rows_in = own["n"].to_numpy(float)
            gap = own[means].to_numpy(float) - self.centre
        else:
            row, self.rows_in, gap = {}, np.array([float(self.n)]), np.zeros((1, width))
        self.gap, self.numeric_gap = gap[:, 0], gap[:, 1:]
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, j in combinations(range(len(keys)), 2):
            part = rows[(used == 2) & rows[keys[i]].notna() & rows[keys[j]].notna()]
            n = part["n"].to_numpy(float)
            if self.apart in (i, j):
                mine, other = (i, j) if i == self.apart else (j, i)
                column = part[keys[other]].map(at[other]).to_numpy(float)
                kept = ~np.isnan(column)
                self.pairs.append((part[keys[mine]].map(row).to_numpy(int)[kept], column[kept].astype(int), n[kept]))
            else:
                a, b = part[keys[i]].map(at[i]).to_numpy(float), part[keys[j]].map(at[j]).to_numpy(float)
                kept = ~(np.isnan(a) | np.isnan(b))
                a, b = a[kept].astype(int), b[kept].astype(int)
                self.products[a, b] = self.products[b, a] = n[kept]

    def means_of(self, low: int, high: int) -> np.ndarray:
        """Means of the other columns in the levels set apart with numbers from low to high - 1."""
        out = np.zeros((high - low, len(self.target)))
        for row, column, n in self.pairs:
            kept = (row >= low) & (row < high)
            out[row[kept] - low, column[kept]] = n[kept]
        out[:, :self.dummies] /= self.rows_in[low:high, None]
        out[:, self.dummies:] = self.numeric_gap[low:high]
        return out

    def chunks(self):
        """Consecutive stretches of the levels set apart, with those means: about 32 MB at a time."""
        step = max(1, (1 << 22) // max(1, len(self.target)))
        for low in range(0, len(self.rows_in), step):
            high = min(low + step, len(self.rows_in))
            yield slice(low, high), self.means_of(low, high)


def _term(name: str, level: str) -> str:
    return f"C({name})[T.{ {'true': 'True', 'false': 'False'}.get(level, level) }]"


def _fit(rows: pd.DataFrame, numeric: list[str], factors: list[str]) -> pd.DataFrame:
    sums = _Sums(rows, numeric, factors)
    n, centre = sums.n, sums.centre
    # What the other columns have left once the levels set apart are taken out.
    left, target = sums.products.copy(), sums.target.copy()
    for s, u in sums.chunks():
        weighted = sums.rows_in[s, None] * u
        left -= weighted.T @ u
        target -= weighted.T @ sums.gap[s]
    scale = np.sqrt(np.where(np.diag(sums.products) > 0, np.diag(sums.products), 1.0))
    values, vectors = np.linalg.eigh(left / np.outer(scale, scale))
    solid = values > SINGULAR
    basis = vectors[:, solid] / scale[:, None]
    inverse = (basis / values[solid]) @ basis.T
    beta = inverse @ target
    rank = len(sums.rows_in) + int(solid.sum())

    total = float(sums.cross[0, 0])
    within = total - float((sums.rows_in * sums.gap * sums.gap).sum())
    ss_resid = max(within - float(beta @ target), 0.0)
    df_model, df_resid = rank - 1, n - rank
    r2 = 1.0 - ss_resid / total if total > 0 else math.nan
    spare = df_resid > 0
    noise = ss_resid / df_resid if spare else math.nan

    # Each level's height, and how far its means are from those of the first level.
    first = sums.means_of(0, 1)[0]
    height, lever = np.empty(len(sums.rows_in)), np.empty(len(sums.rows_in))
    for s, u in sums.chunks():
        height[s] = sums.gap[s] - u @ beta
        away = u - first
        lever[s] = ((away @ inverse) * away).sum(axis=1)
    at_zero = first.copy()
    at_zero[sums.dummies:] += centre[1:]
    back = np.concatenate([np.zeros(sums.dummies), centre[1:]])
    terms, coef, var = ["Intercept"], [height[0] + centre[0] - back @ beta], [1 / sums.rows_in[0] + at_zero @ inverse @ at_zero]
    other = iter(range(sums.dummies))
    for i, name in enumerate(factors):
        for j, level in enumerate(sums.levels[i][1:], 1):
            terms.append(_term(name, level))
            if i == sums.apart:
                coef.append(height[j] - height[0])
                var.append(1 / sums.rows_in[j] + 1 / sums.rows_in[0] + lever[j])
            else:
                column = next(other)
                coef.append(beta[column])
                var.append(inverse[column, column])
    terms += numeric
    coef = np.array([*coef, *beta[sums.dummies:]])
    se = np.sqrt(np.clip(noise * np.array([*var, *np.diag(inverse)[sums.dummies:]]), 0.0, None))
    t = np.divide(coef, se, out=np.full_like(coef, np.inf if spare else np.nan), where=se > 0)
    limit = t_critical(0.95, df_resid) if spare else math.nan
    f = (r2 / df_model) / ((1 - r2) / df_resid) if spare and df_model and r2 < 1 else math.nan
    return pd.DataFrame({
        "term": terms, "coefficient": coef, "std_error": se, "t": t,
        "p": [math.nan if math.isnan(v) else math.exp(log_t_two_sided(abs(v), df_resid)) for v in t],
        "ci95_low": coef - limit * se, "ci95_high": coef + limit * se,
        "n": n, "r_squared": r2, "adj_r_squared": 1 - (1 - r2) * (n - 1) / df_resid if spare else math.nan,
        "f": f, "df_model": df_model, "df_resid": df_resid,
        "f_p": math.nan if math.isnan(f) else math.exp(log_f_upper(f, df_model, df_resid)),
    })


def ols(df: DataFrame, response: str, numeric: list[str], factors: list[str] | None = None,
        also_known: list[str] | None = None) -> DataFrame:
    """Least squares fit, one row per term; the model statistics repeat on each row.

    Factors are coded against their alphabetically first level. Rows null in a used column, or in
    one of ``also_known``, are left out. The sums that reach the solver are one row per level and per
    pair of levels of two factors that occurs. Where columns depend on each other, the dependent
    direction is left at zero, fitted values and the model statistics stay exact.
    """
    factors = factors or []
    used = complete_rows(df, [response, *numeric, *factors, *(also_known or [])])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        return _fit(pdf, numeric, factors)

    return _sums(used, response, numeric, factors).groupBy(F.lit(0).alias("_model")).applyInPandas(fit, _FIT_SCHEMA)


def coefficient_table(fit: DataFrame) -> DataFrame:
    return fit.select("term", "coefficient", "std_error", "t", "p", "ci95_low", "ci95_high")


def model_summary(fit: DataFrame) -> DataFrame:
    return fit.where(F.col("term") == "Intercept").select(
        F.col("n"), "r_squared", "adj_r_squared", "f", "df_model", "df_resid", "f_p")


def _with_fitted(used: DataFrame, fit: DataFrame, numeric: list[str], factors: list[str]) -> DataFrame:
    """Adds ``fitted``: the plain terms travel as one value, the levels of each factor are looked up."""
    plain = fit.where(F.col("term").isin("Intercept", *numeric)).agg(
        F.map_from_entries(F.collect_list(F.struct("term", "coefficient")))).scalar()
    out, value = used.withColumn("_coef", plain), F.col("_coef")["Intercept"]
    for c in numeric:
        value = value + F.col("_coef")[c] * F.col(c).cast("double")
    for i, c in enumerate(factors):
        level = F.col(c).cast("string")
        level = F.when(level == "true", "True").when(level == "false", "False").otherwise(level)
        out = out.withColumn(f"_term{i}", F.concat(F.lit(f"C({c})[T."), level, F.lit("]")))
        out = lookup(out, fit.select(F.col("term").alias(f"_term{i}"), F.col("coefficient").alias(f"_add{i}")), [f"_term{i}"])
        value = value + F.coalesce(f"_add{i}", F.lit(0.0))
    return out.withColumn("fitted", value).select(*used.columns, "fitted")


def residuals(df: DataFrame, response: str, numeric: list[str], factors: list[str] | None = None,
              also_known: list[str] | None = None) -> DataFrame:
    """The complete rows with ``fitted`` and ``resid``."""
    factors = factors or []
    fit = ols(df, response, numeric, factors, also_known)
    used = complete_rows(df, [response, *numeric, *factors, *(also_known or [])])
    out = _with_fitted(used, materialized(fit) if factors else fit, numeric, factors)
    return out.withColumn("resid", F.col(response).cast("double") - F.col("fitted"))


def breusch_pagan(df: DataFrame, response: str, numeric: list[str],
                  factors: list[str] | None = None) -> DataFrame:
    """LM = n R² of the squared residuals on the regressors, with p by chi-squared."""
    squared = residuals(df, response, numeric, factors).withColumn(
        "_squared", F.col("resid") * F.col("resid"))
    aux = model_summary(ols(squared, "_squared", numeric, factors))
    return aux.select(
        "n", (F.col("n") * F.col("r_squared")).alias("lm"), F.col("df_model").alias("df"),
        F.col("f"), F.col("f_p"),
    ).withColumn("p", chi2_p("lm", F.col("df")))


def vif(df: DataFrame, columns: list[str], also_known: list[str] | None = None) -> DataFrame:
    """Variance inflation per regressor on the matrix without intercept (uncentred R²).

    A regressor that the others determine, or that is always 0, has an infinite factor.
    """
    used = complete_rows(df, [*columns, *(also_known or [])])
    sums = _sums(used, columns[0], columns[1:], [])

    def inflate(pdf: pd.DataFrame) -> pd.DataFrame:
        row, k = pdf.iloc[0], len(columns)
        m = np.array([row[f"m{i}"] for i in range(k)])
        products = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        products = products + np.outer(m, m)
        size = np.sqrt(np.diag(products))
        scaled = products / np.outer(np.where(size > 0, size, 1), np.where(size > 0, size, 1))
        factor = []
        for i in range(k):
            rest = [j for j in range(k) if j != i and size[j] > 0]
            # Part of the regressor's length that the others leave over.
            part = scaled[np.ix_(rest, rest)]
            fit = np.linalg.lstsq(part, scaled[rest, i], rcond=1e-10)[0] if rest else np.zeros(0)
            over = 1.0 - float(scaled[i, rest] @ fit) if size[i] > 0 else 0.0
            factor.append(1.0 / over if over > 1e-10 else math.inf)
        return pd.DataFrame({"term": columns, "vif": factor})

    return sums.groupBy(F.lit(0).alias("_all")).applyInPandas(inflate, "term string, vif double")


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Straight line of y on x."""
    a, b = known(x), known(y)
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return df.agg(F.count(a).alias("n"), F.regr_slope(b, a).alias("slope"),
                  F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r_squared"))
