"""Sensitivity: what drift, or what change of dispersion, a number of bouts would show.

Draws are made once for each number of bouts; the statistic under a displacement follows from the
draw's own statistic in closed form, so a whole grid of effects costs no further draws.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.operators import draws as G
from driftloom.operators import resampling as R

# The default grids of standardised squared displacements and of fold changes.
EFFECTS = (0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0)
FOLDS = (1.05, 1.1, 1.15, 1.2, 1.3, 1.4, 1.5, 1.75, 2.0, 2.5, 3.0, 4.0)


def directed_draws(means: DataFrame, by: Sequence[str], n_bouts: int, n_draws: int, seed: int = 0) -> DataFrame:
    """by, draw, drift, along: the statistic without displacement, and the gap along a random unit vector."""
    if n_bouts < 2:
        raise ValueError(f"need 2 bouts per side or more, not {n_bouts}")
    return G.by_size(
        means, by, ["m"],
        lambda bouts: G.directed(bouts, by, n_draws, seed, n_bouts),
        lambda rows: _directed_draws(rows, by, n_bouts, n_draws, seed),
    )


def _directed_draws(means: DataFrame, by: Sequence[str], n_bouts: int, n_draws: int, seed: int) -> DataFrame:
    """The same by joins."""
    rows = R.subsets(R.units_of(means, by), by, n_bouts, n_draws, seed).join(means.select(*by, "bout", "dim", "m"), [*by, "bout"])
    left, right = (F.when(F.col("is_left") == side, F.col("m")) for side in (True, False))
    per_dim = rows.groupBy(*by, "draw", "dim").agg(
        F.count(left).alias("nl"), F.avg(left).alias("ml"), F.var_samp(left).alias("vl"),
        F.count(right).alias("nr"), F.avg(right).alias("mr"), F.var_samp(right).alias("vr"),
    )
    gap = F.col("ml") - F.col("mr")
    h1, h2 = R._hashes(seed, *by, F.lit("direction"), "dim")
    u1, u2 = (h1.cast("double") + 1) / 4294967296.0, h2.cast("double") / 4294967296.0
    normal = F.sqrt(-2 * F.ln(u1)) * F.cos(2 * math.pi * u2)
    per_dim = per_dim.withColumn("gap", gap).withColumn("u", normal)
    term = F.col("gap") * F.col("gap") - F.col("vl") / F.col("nl") - F.col("vr") / F.col("nr")
    length = F.sqrt(F.sum(F.col("u") * F.col("u")))
    return per_dim.groupBy(*by, "draw").agg(F.sum(term).alias("drift"), (F.sum(F.col("gap") * F.col("u")) / length).alias("along"))


def critical_value(draws: DataFrame, by: Sequence[str], value: str = "drift", alpha: float = 0.05, absolute: bool = False) -> DataFrame:
    x = F.abs(value) if absolute else F.col(value)
    return draws.groupBy(*by).agg(F.percentile(x, F.lit(1 - alpha)).alias("critical"))


def _joined(draws: DataFrame, critical: DataFrame, by: Sequence[str]) -> DataFrame:
    return draws.join(critical, list(by)) if by else draws.crossJoin(F.broadcast(critical))  # one row


def centroid_power(means: DataFrame, by: Sequence[str], n_bouts: int, scale: float, effects: Sequence[float] = EFFECTS, alpha: float = 0.05, n_draws: int = 500, seed: int = 0) -> DataFrame:
    """by, effect, power: how often a squared displacement of effect * scale lies over the threshold."""
    critical = critical_value(directed_draws(means, by, n_bouts, n_draws, seed + R.NULL_SEED), by, "drift", alpha)
    draws = _joined(directed_draws(means, by, n_bouts, n_draws, seed), critical, by)
    grid = draws.withColumn("effect", F.explode(F.array(*[F.lit(float(e)) for e in effects])))
    square = F.greatest(F.col("effect"), F.lit(0.0)) * F.lit(float(scale))
    moved = F.col("drift") - 2 * F.sqrt(square) * F.col("along") + square
    return grid.groupBy(*by, "effect").agg(F.avg((moved > F.col("critical")).cast("double")).alias("power"))


def dispersion_power(moments: DataFrame, by: Sequence[str], n_bouts: int, folds: Sequence[float] = FOLDS, alpha: float = 0.05, n_draws: int = 500, seed: int = 0) -> DataFrame:
    """by, fold, power: how often a fold change of the variance, either way, lies over the threshold."""

    def draws(s: int) -> DataFrame:
        return R.dispersion_of_subsets(moments, by, n_bouts, n_draws, s)

    critical = critical_value(draws(seed + R.NULL_SEED), by, "log_ratio", alpha, absolute=True)
    grid = _joined(draws(seed), critical, by).withColumn("fold", F.explode(F.array(*[F.lit(float(f)) for f in folds])))
    moved = F.abs(F.col("log_ratio") + F.ln("fold"))
    return grid.groupBy(*by, "fold").agg(F.avg((moved > F.col("critical")).cast("double")).alias("power"))


def least_detectable(curve: DataFrame, by: Sequence[str], value: str, power: float = 0.8) -> DataFrame:
    """by, least: the smallest value on the curve with the power asked for; null if none reaches it."""
    return curve.groupBy(*by).agg(F.min(F.when(F.col("power") >= power, F.col(value))).alias("least"))
