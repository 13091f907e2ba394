"""Tail probabilities for small results: Student's t, and with it the tests of a rank correlation and of a slope."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0.0 or x >= 1.0:
        return min(1.0, max(0.0, x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    total = 1.0
    for k in range(400):
        m = k // 2
        if k == 0:
            term = 1.0
        elif k % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + term * d or tiny)
        c = 1.0 + term / c or tiny
        total *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return front * (total - 1.0)


def two_sided_p(t: float | None, df: int | None) -> float | None:
    """The probability of a t this far from 0, either way; null without degrees of freedom."""
    if t is None or df is None or df < 1 or math.isnan(t):
        return None
    return 0.0 if math.isinf(t) else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def correlation_p(rho: Column, n: Column) -> Column:
    """The two-sided p-value of a correlation of ``n`` pairs, by Student's t; for results of few rows."""
    t = rho * F.sqrt((n - 2) / F.nullif(1 - rho * rho, F.lit(0.0)))
    t = F.when(F.abs(rho) >= 1, F.lit(float("inf"))).otherwise(t)

    @F.pandas_udf("double")
    def p(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else two_sided_p(float(a), int(b)) for a, b in zip(ts, dfs)], dtype="float64")

    return p(t.cast("double"), (n - 2).cast("int"))


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, rho and slope of y over x, each with its two-sided p-value."""
    from driftloom.operators.fidelity import correlation, spearman

    ranks = spearman(df, x, y)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    linear = rows.agg((F.covar_pop(y, x) / F.nullif(F.var_pop(x), F.lit(0.0))).alias("slope"), correlation(x, y).alias("_r"))
    both = ranks.crossJoin(linear)  # one row each
    return both.select("n", "rho", correlation_p(F.col("rho"), F.col("n")).alias("rho_p"), "slope", correlation_p(F.col("_r"), F.col("n")).alias("slope_p"))
