"""Tests on means, ranks and correlations.

Every test is one or two aggregations over the events; the formulas then run on the
few result rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dist
from ..functions.delay import known
from ..functions.effect import ALPHA, bonferroni_flags
from ..session import materialized
from .filters import has_value
from .joins import lookup
from .ranks import average_rank, running_totals


def welch_stats(df: DataFrame, flag: Column, value: str = "delay_arr_sec") -> DataFrame:
    """Welch's t of the rows without the flag (1) against those with it (2), without p."""
    x = known(value)
    one, two = F.when(~flag, x), F.when(flag, x)
    sums = df.agg(
        F.count(one).alias("n1"), F.count(two).alias("n2"),
        F.avg(one).alias("mean1"), F.avg(two).alias("mean2"),
        F.var_samp(one).alias("var1"), F.var_samp(two).alias("var2"),
    )
    return welch_of(sums)


def welch_of(sums: DataFrame) -> DataFrame:
    """Welch's t from n1, mean1, var1 and n2, mean2, var2, without p."""
    e1, e2 = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    diff = F.col("mean1") - F.col("mean2")
    return sums.select(
        "n1", "n2", "mean1", "mean2", "var1", "var2",
        diff.alias("diff"),
        F.sqrt(e1 + e2).alias("se"),
        F.try_divide(diff, F.sqrt(e1 + e2)).alias("t"),
        F.try_divide((e1 + e2) * (e1 + e2),
                     e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1)).alias("df"),
        # Unweighted mean of the two variances, not the pooled one.
        F.try_divide(diff, F.sqrt((F.col("var1") + F.col("var2")) / 2)).alias("cohens_d"),
    )


def with_welch_p(stats: DataFrame) -> DataFrame:
    """p, 95 % interval of the difference and significance flags of a Welch's t."""
    tested = stats.withColumns({
        "p": dist.t_p("t", F.col("df")),
        "log10_p": dist.t_log10_p("t", F.col("df")),
        "t_critical": dist.t_95(F.col("df")),
    })
    return tested.withColumns({
        "ci95_low": F.col("diff") - F.col("t_critical") * F.col("se"),
        "ci95_high": F.col("diff") + F.col("t_critical") * F.col("se"),
        **bonferroni_flags("p"),
    }).drop("t_critical")


def welch_test(df: DataFrame, flag: Column, value: str = "delay_arr_sec") -> DataFrame:
    """Welch's t with p, 95 % interval of the difference and significance flags."""
    return with_welch_p(welch_stats(df, flag, value))


def daily_means(df: DataFrame, flag: Column, day: str = "betriebstag",
                value: str = "delay_arr_sec") -> DataFrame:
    """Mean per day and flag; a day with both kinds of rows gives two."""
    return (df.where(F.col(day).isNotNull()).groupBy(day, flag.alias("flag"))
            .agg(F.avg(known(value)).alias("daily_mean")))


def welch_daily(df: DataFrame, flag: Column, day: str = "betriebstag",
                value: str = "delay_arr_sec") -> DataFrame:
    """Welch's t on daily means instead of single events, without p."""
    return welch_stats(daily_means(df, flag, day, value), F.col("flag"), "daily_mean")


def welch_daily_test(df: DataFrame, flag: Column, day: str = "betriebstag",
                     value: str = "delay_arr_sec") -> DataFrame:
    return welch_test(daily_means(df, flag, day, value), F.col("flag"), "daily_mean")


def mann_whitney(df: DataFrame, flag: Column, value: str = "delay_arr_sec") -> DataFrame:
    """U of the rows without the flag, tie- and continuity-corrected z; without p."""
    kept = df.where(has_value(value)).select(F.col(value).cast("double").alias("value"), flag.alias("flag")).where(
        F.col("flag").isNotNull())
    hist = kept.groupBy("value").agg(
        F.count("*").alias("n"), F.count_if(~F.col("flag")).alias("n_one"))
    ranked = running_totals(hist)
    ties = F.col("n").cast("double")
    sums = ranked.agg(
        F.sum("n_one").cast("double").alias("n1"),
        F.sum(F.col("n") - F.col("n_one")).cast("double").alias("n2"),
        F.sum(F.col("n_one") * average_rank()).alias("r1"),
        F.sum(ties * ties * ties - ties).alias("ties"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    n = n1 + n2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    return sums.select(
        n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), u1.alias("u"),
        F.try_divide(F.greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5, sigma).alias("z"))


def mann_whitney_test(df: DataFrame, flag: Column, value: str = "delay_arr_sec") -> DataFrame:
    out = mann_whitney(df, flag, value)
    # A z below zero only comes from the continuity correction: no difference at all.
    return out.withColumn("p", dist.normal_p(F.greatest(F.col("z"), F.lit(0.0))))


def group_moments(df: DataFrame, group: str, value: str = "delay_arr_sec",
                  k: int | None = None) -> DataFrame:
    """n, mean and variance of the known values per group; only the k most frequent groups
    if k is given."""
    x = known(value)
    stats = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count("*").alias("_rows"), F.count(x).alias("n"), F.avg(x).alias("mean"),
        F.coalesce(F.var_samp(x), F.lit(0.0)).alias("var"))
    if k is not None:
        stats = stats.orderBy(F.desc("_rows"), group).limit(k)
    return stats.where(F.col("n") > 0).drop("_rows")


def anova_of(stats: DataFrame) -> DataFrame:
    """Analysis of variance from n, mean and var (sample variance) per group, without p."""
    grand = stats.agg(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n"))).scalar()
    gap = F.col("mean") - F.col("_grand")
    sums = stats.withColumn("_grand", grand).agg(
        F.count("*").alias("n_groups"), F.sum("n").alias("n"),
        F.sum(F.col("n") * gap * gap).alias("ss_between"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("ss_within"))
    df_b, df_w = F.col("n_groups") - 1, F.col("n") - F.col("n_groups")
    f = F.try_divide(F.try_divide(F.col("ss_between"), df_b), F.try_divide(F.col("ss_within"), df_w))
    return sums.select(
        "n_groups", "n", f.alias("f"), df_b.alias("df_between"), df_w.alias("df_within"),
        F.try_divide(f * df_b, f * df_b + df_w).alias("eta_squared"))


def anova(df: DataFrame, group: str, value: str = "delay_arr_sec", more_than: int = 100) -> DataFrame:
    """One-way analysis of variance over the groups with more than that many rows, without p."""
    return anova_of(group_moments(df, group, value).where(F.col("n") > more_than))


def anova_top(df: DataFrame, group: str, value: str = "delay_arr_sec", k: int = 5) -> DataFrame:
    """The same over the k most frequent groups."""
    return anova_of(group_moments(df, group, value, k))


def with_f_test(anova_row: DataFrame) -> DataFrame:
    tested = anova_row.withColumn("p", dist.f_p("f", F.col("df_between"), F.col("df_within")))
    return tested.withColumns(bonferroni_flags("p"))


def tukey_pairs(df: DataFrame, group: str, value: str = "delay_arr_sec", k: int = 5) -> DataFrame:
    """All pairs of the k most frequent groups: difference of means and studentised range q.

    Needs only n, mean and variance per group, so all events count and none is sampled.
    """
    stats = group_moments(df, group, value, k)
    # One row with at most k entries, sorted by group name.
    row = stats.agg(
        F.array_sort(F.collect_list(F.struct(group, "n", "mean"))).alias("g"),
        F.try_divide(F.sum((F.col("n") - 1) * F.col("var")), F.sum("n") - F.count("*")).alias("mse"),
        F.count("*").alias("k"), (F.sum("n") - F.count("*")).alias("df"))
    first = row.select("*", F.posexplode("g").alias("i", "a"))
    later = F.slice("g", F.col("i") + 2, F.greatest(F.size("g") - F.col("i") - 1, F.lit(0)))
    pairs = first.select("mse", "k", "df", "a", F.explode(later).alias("b"))
    se = F.sqrt(F.col("mse") / 2 * (1 / F.col("a.n") + 1 / F.col("b.n")))
    diff = F.col("b.mean") - F.col("a.mean")
    return pairs.select(
        F.col(f"a.{group}").alias("group1"), F.col(f"b.{group}").alias("group2"),
        diff.alias("mean_diff"), se.alias("se"), F.try_divide(F.abs(diff), se).alias("q"), "k", "df")


def tukey_test(df: DataFrame, group: str, value: str = "delay_arr_sec", k: int = 5) -> DataFrame:
    """Tukey's pairwise test with adjusted p, family-wise 95 % interval and decision."""
    pairs = tukey_pairs(df, group, value, k)
    tested = pairs.withColumns({
        "p_adjusted": dist.range_p("q", F.col("k"), F.col("df")),
        "_limit": dist.range_95(F.col("k"), F.col("df")),
    })
    return tested.withColumns({
        "ci95_low": F.col("mean_diff") - F.col("_limit") * F.col("se"),
        "ci95_high": F.col("mean_diff") + F.col("_limit") * F.col("se"),
        "reject": F.col("p_adjusted") < ALPHA,
    }).drop("_limit")


def _t_of_r(r: Column, n: Column) -> Column:
    return r * F.sqrt(F.try_divide(n - 2, 1 - r * r))


def pearson(df: DataFrame, columns: list[str], value: str = "delay_arr_sec",
            min_pairs: int = 1000, only_with: str | None = None) -> DataFrame:
    """r per column over its complete pairs, t and the Fisher interval; without p.

    All columns are worked out in one pass; columns with fewer pairs are left out. With ``only_with``,
    such as the temperature, rows that lack that column do not count for any.
    """
    df = df.where(has_value(only_with)) if only_with else df
    y = known(value)

    def correlation(c: str) -> Column:
        a, b = F.when(y.isNotNull(), known(c)), F.when(known(c).isNotNull(), y)
        # Spark's own corr fails on a constant column.
        r = F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)))
        return F.struct(F.lit(c).alias("variable"), F.count(a).alias("n"), r.alias("r"))

    per_column = df.agg(F.array(*[correlation(c) for c in columns]).alias("all"))
    rows = per_column.select(F.explode("all").alias("c")).select("c.*")
    z, half = F.atanh("r"), F.try_divide(F.lit(1.96), F.sqrt(F.col("n") - 3))
    return rows.where(F.col("n") >= min_pairs).withColumns({
        "t": _t_of_r(F.col("r"), F.col("n")),
        "ci95_low": F.tanh(z - half), "ci95_high": F.tanh(z + half)})


def spearman(df: DataFrame, columns: list[str], value: str = "delay_arr_sec",
             min_pairs: int = 1000, only_with: str | None = None) -> DataFrame:
    """Rank correlation of each column with the value over complete pairs, average ranks for
    ties; without p. All columns go through one plan, and columns with fewer pairs are left out.
    The events look up the ranks of both sides; pairs of values are neither grouped nor stored.
    ``only_with`` as for ``pearson``.
    """
    df = df.where(has_value(only_with)) if only_with else df
    measures = F.array(*[F.struct(F.lit(c).alias("variable"), known(c).alias("x")) for c in columns])
    pairs = (df.where(has_value(value))
             .select(F.col(value).cast("double").alias("y"), F.explode(measures).alias("m"))
             .where(F.col("m.x").isNotNull()).select("m.variable", "m.x", "y"))

    # Both sides are counted in one pass; only distinct values are stored and ranked.
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("value")) for s in ("x", "y")])
    hist = (pairs.select("variable", F.explode(sides).alias("s")).select("variable", "s.side", "s.value")
            .groupBy("variable", "side", "value").agg(F.count("*").alias("n")))
    # Centred at the mean rank, which is known beforehand.
    ranks = materialized(running_totals(hist, ["variable", "side"]).select(
        "variable", "side", "value", (average_rank() - (F.col("total") + 1) / 2.0).alias("rank")))

    def ranked(rows: DataFrame, side: str) -> DataFrame:
        table = ranks.where(F.col("side") == side).select(
            "variable", F.col("value").alias(side), F.col("rank").alias(f"rank_{side}"))
        return lookup(rows, table, ["variable", side], spread="y" if side == "x" else "x")

    dx, dy = F.col("rank_x"), F.col("rank_y")
    out = ranked(ranked(pairs, "x"), "y").groupBy("variable").agg(
        F.count("*").alias("n"),
        F.try_divide(F.sum(dx * dy), F.sqrt(F.sum(dx * dx) * F.sum(dy * dy))).alias("rho"))
    return out.where(F.col("n") >= min_pairs).withColumn("t", _t_of_r(F.col("rho"), F.col("n")))


def with_t_test(correlations: DataFrame) -> DataFrame:
    """p of a correlation by Student's t, and the significance flags."""
    tested = correlations.withColumn("p", dist.t_p("t", F.col("n") - 2))
    return tested.withColumns(bonferroni_flags("p"))
