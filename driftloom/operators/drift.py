"""Drift between two days: centroids, dispersion and the order of labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.operators import moments as M


def supported_sides(points: DataFrame, by: Sequence[str], rows: int = 20, bouts: int = 4) -> DataFrame:
    """Points of the groups with enough renditions and bouts."""
    enough = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("bout").alias("b"))
    enough = enough.where((F.col("n") >= rows) & (F.col("b") >= bouts)).select(*by)
    return points.join(enough, list(by), "left_semi")


def paired(left: DataFrame, right: DataFrame, on: Sequence[str], side: str, how: Column | None = None) -> DataFrame:
    """Rows of ``left`` and ``right`` with equal ``on``; their other columns end in _a and _b.

    ``how`` restricts the pairs by the columns ``side``_a and ``side``_b; by default a < b.
    """
    a = left.select(*on, *[F.col(c).alias(f"{c}_a") for c in left.columns if c not in on])
    b = right.select(*on, *[F.col(c).alias(f"{c}_b") for c in right.columns if c not in on])
    rule = F.col(f"{side}_a") < F.col(f"{side}_b") if how is None else how
    return a.join(b, list(on)).where(rule) if on else a.join(b, rule)  # without keys: a few sides only


def centroid_drift(units: DataFrame, type_keys: Sequence[str], side: str, how: Column | None = None, other: DataFrame | None = None) -> DataFrame:
    """Naive and unbiased squared distance of the centroids of each pair of sides.

    ``units`` are unit moments by type_keys, side and dim. The unbiased distance takes off what the
    spread of the bouts adds by chance; it may be negative and is never clipped. Both sides need two
    units or more.
    """
    pairs = paired(units, units if other is None else other, [*type_keys, "dim"], side, how)
    pairs = pairs.where("units_a >= 2 and units_b >= 2")
    gap = (F.col("mu_a") - F.col("mu_b")) * (F.col("mu_a") - F.col("mu_b"))
    noise = F.col("v_a") / F.col("units_a") + F.col("v_b") / F.col("units_b")
    return pairs.groupBy(*type_keys, f"{side}_a", f"{side}_b").agg(
        F.sum(gap).alias("naive"), F.sum(gap - noise).alias("drift")
    )


def dispersion_drift(variances: DataFrame, type_keys: Sequence[str], side: str, how: Column | None = None) -> DataFrame:
    """log_ratio: the log of the later side's total variance over the earlier one's; both must be positive."""
    known = variances.where("tv > 0").select(*type_keys, side, "tv")
    pairs = paired(known, known, type_keys, side, how)
    return pairs.select(*type_keys, f"{side}_a", f"{side}_b", F.ln(F.col("tv_b") / F.col("tv_a")).alias("log_ratio"))


def transition_shares(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, first, second, p: the share of each adjacent pair among its group's; ``pairs`` may carry n."""
    weight = F.sum("n") if "n" in pairs.columns else F.count(F.lit(1))
    counts = pairs.groupBy(*by, "first", "second").agg(weight.alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
    return counts.join(totals, list(by)).where("_all > 0").select(*by, "first", "second", (F.col("n") / F.col("_all")).alias("p"))


def divergence(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, jsd: the Jensen-Shannon divergence in bits of two distributions per group, at least 0.

    A pair that one side lacks has probability 0 there. Groups must be on both sides.
    """
    both = left.select(*by).distinct().join(right.select(*by).distinct(), list(by), "left_semi")
    sides = left.withColumn("q", F.lit(0.0)).unionByName(right.select(*by, "first", "second", F.lit(0.0).alias("p"), F.col("p").alias("q")))
    cells = sides.groupBy(*by, "first", "second").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).join(both, list(by), "left_semi")
    mid = (F.col("p") + F.col("q")) / 2

    def part(x: str) -> Column:
        return F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / mid)).otherwise(0.0)

    return cells.groupBy(*by).agg(F.greatest((F.sum(part("p")) + F.sum(part("q"))) / 2, F.lit(0.0)).alias("jsd"))


def syntax_drift(shares: DataFrame, side: str, on: Sequence[str] = ()) -> DataFrame:
    """jsd of every pair of sides, the earlier one first; distributions are paired through the sides they belong to."""
    days = shares.select(*on, side).distinct()
    pairs = paired(days, days, on, side) if on else days.select(F.col(side).alias(f"{side}_a")).join(
        days.select(F.col(side).alias(f"{side}_b")), F.col(f"{side}_a") < F.col(f"{side}_b")
    )  # distinct days only
    keys = [*on, f"{side}_a", f"{side}_b"]
    left = pairs.join(shares.withColumnRenamed(side, f"{side}_a"), [*on, f"{side}_a"]).select(*keys, "first", "second", "p")
    right = pairs.join(shares.withColumnRenamed(side, f"{side}_b"), [*on, f"{side}_b"]).select(*keys, "first", "second", "p")
    return divergence(left, right, keys)


def within_type_scale(variances: DataFrame, by: Sequence[str], side: str) -> DataFrame:
    """by, scale: the mean over types of the total variance on the first side (day); 1 if there is none."""
    first = variances.groupBy(*by).agg(F.min(side).alias("_first"))
    joined = variances.join(first, list(by)) if by else variances.crossJoin(F.broadcast(first))  # one row
    reference = F.when((F.col(side) == F.col("_first")) & (F.col("n_rows") > 1), F.col("tv"))
    return joined.groupBy(*by).agg(F.coalesce(F.avg(reference), F.lit(1.0)).alias("scale"))


def drift_of_points(points: DataFrame, type_keys: Sequence[str], side: str, how: Column | None = None) -> DataFrame:
    units = M.unit_moments(M.bout_means(M.bout_moments(points, [*type_keys, side])), [*type_keys, side])
    return centroid_drift(units, type_keys, side, how)


def variance_of_points(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, n_rows, tv straight from the renditions."""
    rows = points.select(*by, F.posexplode("z").alias("dim", "x"))
    per_dim = rows.groupBy(*by, "dim").agg(F.var_samp("x").alias("v"), F.count(F.lit(1)).alias("n"))
    return per_dim.groupBy(*by).agg(F.max("n").alias("n_rows"), F.sum("v").alias("tv"))
