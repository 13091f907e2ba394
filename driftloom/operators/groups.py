"""Group tests with one value per individual: permutation p-values, comparison, sample sizes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.functions.scalars import portable_hash, portable_index

ALTERNATIVES = ("two-sided", "greater", "less")
#: Differences this close to the observed one count as equal to it.
EQUAL = 1e-12


def _sides(values: DataFrame, group: str, value: str, treated: str, control: str) -> DataFrame:
    """One row: n_treated, n_control, mean_treated, mean_control, observed."""
    is_t, is_c = F.col(group) == treated, F.col(group) == control
    return values.agg(
        F.count(F.when(is_t, F.col(value))).alias("n_treated"), F.count(F.when(is_c, F.col(value))).alias("n_control"),
        F.avg(F.when(is_t, F.col(value))).alias("mean_treated"), F.avg(F.when(is_c, F.col(value))).alias("mean_control"),
    ).withColumn("observed", F.col("mean_treated") - F.col("mean_control"))


def _extreme(difference: Column, observed: Column, alternative: str) -> Column:
    if alternative == "greater":
        return difference >= observed - EQUAL
    if alternative == "less":
        return difference <= observed + EQUAL
    return F.abs(difference) >= F.abs(observed) - EQUAL


def labelings(spark: SparkSession, n: int, k: int) -> DataFrame:
    """mask: every choice of ``k`` of ``n`` places as bits; at most as many rows as there are permutations to be made."""
    if n <= 16:
        return spark.range(1 << n).where(F.bit_count("id") == k).select(F.col("id").alias("mask"))
    masks = [(sum(1 << i for i in chosen),) for chosen in combinations(range(n), k)]
    return spark.createDataFrame(masks, "mask long")


def permutation_p(values: DataFrame, key: str, group: str, value: str, treated: str = "treated", control: str = "control", alternative: str = "two-sided", n_permutations: int = 10_000, seed: int = 0) -> DataFrame:
    """One row: observed, n_labelings, n_extreme, p_value = (n_extreme + 1) / (n_labelings + 1).

    ``values`` has one row per individual. All labelings are enumerated if they are at most
    ``n_permutations``, else so many are drawn by hash.
    """
    if alternative not in ALTERNATIVES:
        raise ValueError(f"alternative must be one of {ALTERNATIVES}, not {alternative!r}")
    spark = values.sparkSession
    rows = values.where(F.col(group).isin(treated, control)).select(key, group, F.col(value).cast("double").alias("_x"))
    sides = _sides(rows, group, "_x", treated, control)
    n_t, n_c = sides.select("n_treated", "n_control").first()
    if n_t < 2 or n_c < 2:
        raise ValueError(f"need 2 individuals per group or more, not {n_t} and {n_c}")
    n = n_t + n_c
    if comb(n, n_t) <= max(n_permutations, 1):
        placed = rows.withColumn("_i", F.row_number().over(W.orderBy(key)) - 1).select("_i", "_x")  # individuals only
        drawn = labelings(spark, n, n_t).crossJoin(F.broadcast(placed))
        chosen = F.getbit("mask", F.col("_i")) == 1
        by = "mask"
    else:
        drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_permutations))))
        order = W.partitionBy("draw").orderBy(portable_hash(F.lit(seed), "draw", key), key)
        drawn = drawn.withColumn("_r", F.row_number().over(order))
        chosen, by = F.col("_r") <= n_t, "draw"
    means = drawn.groupBy(by).agg((F.avg(F.when(chosen, F.col("_x"))) - F.avg(F.when(~chosen, F.col("_x")))).alias("d"))
    counted = means.crossJoin(F.broadcast(sides.select("observed"))).groupBy("observed").agg(
        F.count(F.lit(1)).alias("n_labelings"), F.count_if(_extreme(F.col("d"), F.col("observed"), alternative)).alias("n_extreme")
    )
    return counted.withColumn("p_value", (F.col("n_extreme") + 1) / (F.col("n_labelings") + 1))


def difference_draws(values: DataFrame, key: str, group: str, value: str, treated: str, control: str, n_boot: int, seed: int) -> DataFrame:
    """draw, d: the difference of means of groups resampled with replacement."""
    whole = W.partitionBy(group)
    placed = values.select(group, key, F.col(value).cast("double").alias("_x"))
    placed = placed.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_i", F.row_number().over(whole.orderBy(key)) - 1)
    slots = placed.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    pick = portable_index(portable_hash(F.lit(seed), "draw", group, "_i"), F.col("_n"))
    picks = slots.select(group, "draw", pick.alias("_i")).join(F.broadcast(placed.select(group, "_i", "_x")), [group, "_i"])
    mean = {g: F.avg(F.when(F.col(group) == g, F.col("_x"))) for g in (treated, control)}
    return picks.groupBy("draw").agg((mean[treated] - mean[control]).alias("d"))


def compare_groups(values: DataFrame, key: str, group: str, value: str, treated: str = "treated", control: str = "control", alternative: str = "two-sided", n_permutations: int = 10_000, within_sd: float | None = None, n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """One row: the permutation test, a bootstrap interval, the spread between individuals and what limits the test."""
    rows = values.where(F.col(group).isin(treated, control))
    p = permutation_p(rows, key, group, value, treated, control, alternative, n_permutations, seed)
    ends = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    ci = difference_draws(rows, key, group, value, treated, control, n_boot, seed + 1).agg(ends.alias("_p"))
    ci = ci.select(F.col("_p")[0].alias("ci_low"), F.col("_p")[1].alias("ci_high"))
    centred = F.col(value) - F.avg(value).over(W.partitionBy(group))
    spread = rows.select(centred.alias("_c")).agg(F.stddev_samp("_c").alias("between_sd"))
    sides = _sides(rows, group, value, treated, control).select("n_treated", "n_control")
    out = p.crossJoin(ci).crossJoin(spread).crossJoin(sides)  # one row each
    limit = F.lit(None).cast("string") if within_sd is None else F.when(F.lit(float(within_sd)) > F.col("between_sd"), "within-bird").otherwise("between-bird")
    return out.select(
        F.col("observed").alias("observed_difference"), "p_value", "ci_low", "ci_high", "n_treated", "n_control",
        F.lit(alternative).alias("alternative"), "between_sd",
        F.lit(None if within_sd is None else float(within_sd)).cast("double").alias("within_sd"), limit.alias("limiting_factor"),
    )


def _p_values(values: np.ndarray, k: int, alternative: str, n_permutations: int, rng: np.random.Generator) -> np.ndarray:
    """The permutation p-value of each row of ``values``, whose first ``k`` are treated."""
    n = values.shape[1]
    if comb(n, k) <= max(n_permutations, 1):
        chosen = np.array(list(combinations(range(n), k)))
    else:
        chosen = np.argsort(rng.random((n_permutations, n)), axis=1)[:, :k]
    weights = np.full((len(chosen), n), -1 / (n - k))
    weights[np.arange(len(chosen))[:, None], chosen] = 1 / k
    observed = values[:, :k].mean(axis=1) - values[:, k:].mean(axis=1)
    d = values @ weights.T
    if alternative == "greater":
        extreme = d >= observed[:, None] - EQUAL
    elif alternative == "less":
        extreme = d <= observed[:, None] + EQUAL
    else:
        extreme = np.abs(d) >= np.abs(observed)[:, None] - EQUAL
    return (extreme.sum(axis=1) + 1) / (len(chosen) + 1)


def power_by_size(spark: SparkSession, effect: float, between_sd: float, alpha: float = 0.05, alternative: str = "greater", max_n: int = 40, n_simulations: int = 400, n_permutations: int = 2000, seed: int = 0) -> DataFrame:
    """n, power: for each number of individuals per group from 3, how often the permutation test finds ``effect``.

    All sizes are simulated side by side, in blocks of 50 simulations with a generator each.
    """
    if alternative not in ALTERNATIVES:
        raise ValueError(f"alternative must be one of {ALTERNATIVES}, not {alternative!r}")
    step = 50

    def simulate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for n, block, rows in zip(frame["n"], frame["block"], frame["rows"]):
                rng = np.random.default_rng([seed, int(n), int(block)])
                values = rng.normal(0.0, between_sd, (int(rows), 2 * int(n)))
                values[:, : int(n)] += effect
                p = _p_values(values, int(n), alternative, n_permutations, rng)
                out.append((int(n), int(rows), int((p < alpha).sum())))
            yield pd.DataFrame(out, columns=["n", "rows", "hits"])

    starts = range(0, n_simulations, step)
    work = spark.createDataFrame([(n, b, min(step, n_simulations - s)) for n in range(3, max_n + 1) for b, s in enumerate(starts)], "n int, block int, rows int")
    done = work.repartition(spark.sparkContext.defaultParallelism).mapInPandas(simulate, "n int, rows int, hits int")
    return done.groupBy("n").agg((F.sum("hits") / F.sum("rows")).alias("power"))


def birds_needed(curve: DataFrame, power: float = 0.8) -> DataFrame:
    """One row, n_needed: the smallest size with the power asked for; null if none reaches it."""
    return curve.agg(F.min(F.when(F.col("power") >= power, F.col("n"))).cast("double").alias("n_needed"))
