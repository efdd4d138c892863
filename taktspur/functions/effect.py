"""Words and marks for test results."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Error level, number of test families, limits of the marks.
ALPHA = 0.05
TEST_FAMILIES = 4
ALPHA_BONFERRONI = ALPHA / TEST_FAMILIES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stars(p: Column | str) -> Column:
    p = _col(p)
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s."))


def cohen_label(d: Column | str) -> Column:
    size = F.abs(_col(d))
    return (F.when(size < 0.2, "vernachlaessigbar").when(size < 0.5, "klein")
            .when(size < 0.8, "mittel").otherwise("gross"))


def eta_label(eta_squared: Column | str) -> Column:
    eta = _col(eta_squared)
    return F.when(eta < 0.06, "klein").when(eta < 0.14, "mittel").otherwise("gross")


def bonferroni_flags(p: Column | str) -> dict[str, Column]:
    p = _col(p)
    return {"significant_at_005": p < ALPHA, "significant_at_bonferroni": p < ALPHA_BONFERRONI}
