"""Resampling as a relation: a dimension of draws, whose choices come from hashes of their keys.

Every draw chooses bouts (sampling units), never renditions, and looks only at the bouts' moments. A
choice is the order, or the remainder, of a hash of two digests, one of the unit and its keys and one
of seed:draw, so runs agree with each other and with other engines. Groups are drawn from as matrices (:mod:`draws`); those too large for one task
take the relational way, draws joined with bouts, which gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.functions.lineage import cut
from driftloom.functions.scalars import lane, mixed, portable_hash
from driftloom.operators import draws as G
from driftloom.operators import percentiles

FEWEST_BOUTS = 4
#: Added to the seed of the draws that a threshold comes from, so that it is not tuned to the others.
NULL_SEED = 10_007


def with_draws(df: DataFrame, n_draws: int) -> DataFrame:
    """Each row once per draw. The rows are few before and many after, so they are dealt out to all tasks first."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartition(n, F.xxhash64(*df.columns))
    return df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n_draws))))


def _hashes(seed: int, *unit: str | Column) -> list[Column]:
    """The two hashes of a unit and a draw."""
    own, draw = portable_hash(*unit), portable_hash(F.lit(seed), "draw")
    return [mixed(lane(own, k), lane(draw, k)) for k in (0, 1)]


def _order(by: Sequence[str], seed: int) -> list[Column]:
    return [*_hashes(seed, *by, "bout"), F.col("bout")]


def split_halves(units: DataFrame, by: Sequence[str], n_draws: int, seed: int = 0) -> DataFrame:
    """by, draw, bout, is_left: in each draw the bouts fall into two disjoint halves; groups need four bouts.

    ``units`` has one row for each bout of a group.
    """
    counted = units.select(*by, "bout").withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*by)))
    drawn = with_draws(counted.where(F.col("_n") >= FEWEST_BOUTS), n_draws)
    rank = F.row_number().over(W.partitionBy(*by, "draw").orderBy(*_order(by, seed)))
    return drawn.select(*by, "draw", "bout", (rank <= F.floor(F.col("_n") / 2)).alias("is_left"))


def subsets(units: DataFrame, by: Sequence[str], n_bouts: int, n_draws: int, seed: int = 0) -> DataFrame:
    """by, draw, bout, is_left: in each draw two disjoint sets of ``n_bouts``; groups with fewer bouts have no row."""
    if n_bouts < 2:
        raise ValueError(f"need 2 bouts per side or more, not {n_bouts}")
    counted = units.select(*by, "bout").withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*by)))
    drawn = with_draws(counted.where(F.col("_n") >= 2 * n_bouts), n_draws)
    rank = F.row_number().over(W.partitionBy(*by, "draw").orderBy(*_order(by, seed)))
    return drawn.withColumn("_rank", rank).where(F.col("_rank") <= 2 * n_bouts).select(
        *by, "draw", "bout", (F.col("_rank") <= n_bouts).alias("is_left")
    )


def common_subsets(units: DataFrame, n_bouts: int, n_draws: int, seed: int = 0) -> DataFrame:
    """draw, left, right: the sides of ``subsets`` of all ``units`` (bout) as arrays."""
    if n_bouts < 2:
        raise ValueError(f"need 2 bouts per side or more, not {n_bouts}")
    if units.count() <= G.NUMBERS:
        return G.common_sides(units.select("bout"), n_bouts, n_draws, seed)
    found = subsets(units, [], n_bouts, n_draws, seed).groupBy("draw")
    return found.agg(*[F.collect_list(F.when(c, F.col("bout"))).alias(k) for k, c in (("left", F.col("is_left")), ("right", ~F.col("is_left")))])


def resamples(units: DataFrame, by: Sequence[str], n_draws: int, seed: int = 0) -> DataFrame:
    """by, draw, bout, w: as many bouts as the group has, drawn with replacement; w is how often each was."""
    whole = W.partitionBy(*by)
    placed = units.select(*by, "bout").withColumn("_n", F.count(F.lit(1)).over(whole))
    placed = placed.withColumn("_i", F.row_number().over(whole.orderBy("bout")) - 1)
    slots = with_draws(placed, n_draws)
    pick = _hashes(seed, *by, "_i")[0] % F.col("_n")
    picks = slots.select(*by, "draw", pick.alias("_i")).groupBy(*by, "draw", "_i").agg(F.count(F.lit(1)).alias("w"))
    return picks.join(placed.select(*by, "_i", "bout"), [*by, "_i"]).select(*by, "draw", "bout", "w")


def units_of(moments: DataFrame, by: Sequence[str]) -> DataFrame:
    return moments.where("dim = 0").select(*by, "bout")


def _weighted(value: str, w: Column) -> tuple[Column, Column, Column]:
    """n, mean and sample variance of values that count ``w`` times (null: not at all)."""
    x = F.col(value)
    n, s, ss = F.sum(w), F.sum(x * w), F.sum(x * x * w)
    return n, s / n, (ss - s * s / n) / (n - 1)


def centroid_draws(means: DataFrame, chosen: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, draw, drift, and by dimension gap: the unbiased distance of the two sides of each draw.

    ``means`` has by, bout, dim, m; ``chosen`` by, draw, bout, is_left. Draws with fewer than two
    bouts on a side have no row.
    """
    rows = chosen.join(means.select(*by, "bout", "dim", "m"), [*by, "bout"])
    left, right = (F.when(F.col("is_left") == side, F.col("m")) for side in (True, False))
    per_dim = rows.groupBy(*by, "draw", "dim").agg(
        F.count(left).alias("nl"), F.avg(left).alias("ml"), F.var_samp(left).alias("vl"),
        F.count(right).alias("nr"), F.avg(right).alias("mr"), F.var_samp(right).alias("vr"),
    )
    per_dim = per_dim.where("nl >= 2 and nr >= 2").withColumn("gap", F.col("ml") - F.col("mr"))
    term = F.col("gap") * F.col("gap") - F.col("vl") / F.col("nl") - F.col("vr") / F.col("nr")
    return per_dim.groupBy(*by, "draw").agg(F.sum(term).alias("drift"))


def centroid_null(means: DataFrame, by: Sequence[str], n_draws: int = 200, seed: int = 0) -> DataFrame:
    """by, draw, drift when nothing has changed: a group's bouts split in halves."""
    return G.by_size(
        means, by, ["m"],
        lambda bouts: G.centroid(bouts, by, n_draws, seed, FEWEST_BOUTS),
        lambda rows: centroid_draws(rows, split_halves(units_of(rows, by), by, n_draws, seed), by),
    )


def _side_variances(moments: DataFrame, chosen: DataFrame, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    """by, draw, tvl, tvr: the total variances of the renditions on both sides."""
    rows = chosen.join(moments.select(*by, "bout", "dim", "n", "sx", "sxx"), [*by, "bout"])
    aggs = []
    for side, name in ((True, "l"), (False, "r")):
        on = F.col("is_left") == side
        aggs += [F.sum(F.when(on, F.col(c))).alias(c + name) for c in ("n", "sx", "sxx")]
    per_dim = rows.groupBy(*by, "draw", "dim").agg(*aggs)

    def variance(s: str) -> Column:
        n, sx, sxx = (F.col(c + s) for c in ("n", "sx", "sxx"))
        return F.when(n > 1, F.greatest((sxx - sx * sx / n) / (n - 1), F.lit(0.0)))

    return per_dim.groupBy(*by, "draw").agg(F.sum(variance("l")).alias("tvl"), F.sum(variance("r")).alias("tvr"))


def dispersion_draws(moments: DataFrame, chosen: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, draw, log_ratio: right side over left; draws without a positive variance on both sides have no row."""
    sides = _side_variances(moments, chosen, by).where("tvl > 0 and tvr > 0")
    return sides.select(*by, "draw", F.ln(F.col("tvr") / F.col("tvl")).alias("log_ratio"))


def dispersion_null(moments: DataFrame, by: Sequence[str], n_draws: int = 200, seed: int = 0) -> DataFrame:
    return G.by_size(
        moments.withColumnRenamed("n", "n_rows"), by, ["n_rows", "sx", "sxx"],
        lambda bouts: G.dispersion(bouts, by, n_draws, seed, FEWEST_BOUTS),
        lambda rows: dispersion_draws(rows.withColumnRenamed("n_rows", "n"), split_halves(units_of(rows, by), by, n_draws, seed), by),
    )


def dispersion_of_subsets(moments: DataFrame, by: Sequence[str], n_bouts: int, n_draws: int, seed: int = 0) -> DataFrame:
    """by, draw, log_ratio of two disjoint sets of ``n_bouts``."""
    if n_bouts < 2:
        raise ValueError(f"need 2 bouts per side or more, not {n_bouts}")
    return G.by_size(
        moments.withColumnRenamed("n", "n_rows"), by, ["n_rows", "sx", "sxx"],
        lambda bouts: G.dispersion(bouts, by, n_draws, seed, 2 * n_bouts, n_bouts),
        lambda rows: dispersion_draws(rows.withColumnRenamed("n_rows", "n"), subsets(units_of(rows, by), by, n_bouts, n_draws, seed), by),
    )


def syntax_null(pairs: DataFrame, by: Sequence[str], n_draws: int = 100, seed: int = 0) -> DataFrame:
    """by, draw, jsd: the divergence of two halves of a group's bouts. ``pairs`` has by, bout, first, second."""
    counts = pairs.groupBy(*by, "bout", "first", "second").agg(F.count(F.lit(1)).alias("n"))
    name = F.concat_ws("\x01", F.col("first").cast("string"), F.col("second").cast("string"))
    bouts = counts.groupBy(*by, "bout").agg(F.collect_list(name).alias("pair"), F.collect_list("n").alias("times"))
    return G.by_size(
        counts, by, ["pair"],
        lambda bouts: G.divergences(bouts, by, n_draws, seed, FEWEST_BOUTS),
        lambda rows: _divergence_draws(rows, by, n_draws, seed),
        bouts,
    )


def _divergence_draws(counts: DataFrame, by: Sequence[str], n_draws: int, seed: int) -> DataFrame:
    from driftloom.operators.drift import divergence, transition_shares

    rows = split_halves(counts.select(*by, "bout").distinct(), by, n_draws, seed).join(counts, [*by, "bout"])
    keys = [*by, "draw"]
    left, right = (transition_shares(rows.where(F.col("is_left") == side), keys) for side in (True, False))
    return divergence(left, right, keys)


def bootstrap_centroid(means: DataFrame, by: Sequence[str], side: str, pairs: DataFrame, n_boot: int = 1000, seed: int = 0, collapse: bool = True) -> DataFrame:
    """Draws of the unbiased distance of pairs of sides, the bouts of each resampled by themselves.

    ``pairs`` has by, ``side``_a and ``side``_b. With ``collapse`` a bout drawn twice counts once;
    without, it counts twice. Draws with fewer than two bouts on a side have no row.
    """
    return _one_by_one(_centroid_arrays(means, by, side, pairs, n_boot, seed, collapse), by, side, "drift")


def _means_drawn(means: DataFrame, keys: Sequence[str], n_boot: int, seed: int, collapse: bool) -> DataFrame:
    return G.by_size(
        means, keys, ["m"],
        lambda bouts: G.resampled_means(bouts, keys, n_boot, seed, collapse),
        lambda rows: _resampled_means(rows, keys, n_boot, seed, collapse),
    )


def _centroid_arrays(means: DataFrame, by: Sequence[str], side: str, pairs: DataFrame, n_boot: int, seed: int, collapse: bool) -> DataFrame:
    """by, both sides, draws: an array with the drift of each draw, null where a side has fewer than two bouts."""
    return _centroids_paired(_means_drawn(means, [*by, side], n_boot, seed, collapse), by, side, pairs)


def _centroids_paired(drawn: DataFrame, by: Sequence[str], side: str, pairs: DataFrame) -> DataFrame:

    def drift(d: Column) -> Column:
        gaps = F.zip_with(d["mua"], d["mub"], lambda x, y: (x - y) * (x - y))
        far = F.aggregate(gaps, F.lit(0.0), lambda t, x: t + x) - d["ea"] - d["eb"]
        return F.when((d["na"] >= 2) & (d["nb"] >= 2), far)

    return _paired(pairs, by, side, drawn, {"n": "n", "mu": "mu", "noise": "e"}, drift)


def _resampled_means(means: DataFrame, keys: Sequence[str], n_boot: int, seed: int, collapse: bool) -> DataFrame:
    """``draws.resampled_means`` by joins: each draw is a share of its own."""
    drawn = resamples(units_of(means, keys), keys, n_boot, seed)
    if collapse:
        drawn = drawn.withColumn("w", F.lit(1))
    n, mu, v = _weighted("m", F.col("w"))
    stats = drawn.join(means.select(*keys, "bout", "dim", "m"), [*keys, "bout"]).groupBy(*keys, "draw", "dim").agg(
        n.cast("double").alias("n"), mu.alias("mu"), F.when(n > 1, v).alias("v")
    )
    mus = F.transform(F.sort_array(F.collect_list(F.struct("dim", "mu"))), lambda x: x["mu"])
    each = stats.groupBy(*keys, "draw").agg(F.first("n").alias("n"), mus.alias("mu"), F.sum(F.col("v") / F.col("n")).alias("noise"))
    return each.select(*keys, F.col("draw").alias("first"), *[F.array(c).alias(c) for c in ("n", "mu", "noise")])


def _paired(pairs: DataFrame, by: Sequence[str], side: str, drawn: DataFrame, values: dict[str, str], what: Callable[[Column], Column]) -> DataFrame:
    """by, both sides, draws: ``what`` of each draw's values on either side, named by ``values`` with a or b behind."""
    ends = [*by, f"{side}_a", f"{side}_b"]
    shares = F.sort_array(F.collect_list(F.struct("first", *values)))
    each = drawn.groupBy(*by, side).agg(shares.alias("_s"))  # every draw of a side, in order
    rows = pairs.select(*ends)
    for s in "ab":
        arrays = [F.flatten(F.col("_s")[v]).alias(c + s) for v, c in values.items()]
        rows = rows.join(each.select(*by, F.col(side).alias(f"{side}_{s}"), *arrays), [*by, f"{side}_{s}"])
    both = F.arrays_zip(*[c + s for s in "ab" for c in values.values()])
    return rows.select(*ends, F.transform(both, what).alias("draws"))


def _one_by_one(arrays: DataFrame, by: Sequence[str], side: str, name: str) -> DataFrame:
    ends = [*by, f"{side}_a", f"{side}_b"]
    rows = arrays.select(*ends, F.posexplode("draws").alias("_at", name)).where(F.col(name).isNotNull())
    return rows.select(*ends, (F.col("_at") + 1).alias("draw"), name)


def _ends(arrays: DataFrame, by: Sequence[str], side: str, alpha: float) -> DataFrame:
    """by, both sides, low, high: the exact percentile interval of arrays of draws; pairs without a draw have no row."""
    ends = [*by, f"{side}_a", f"{side}_b"]
    rows = arrays.select(*ends, F.sort_array(F.filter("draws", lambda x: x.isNotNull())).alias("_d")).where("size(_d) > 0")

    def at(p: float) -> Column:
        place = (F.size("_d") - 1) * F.lit(p)
        low, high = (F.get("_d", f(place).cast("int")) for f in (F.floor, F.ceil))
        return low + (high - low) * (place - F.floor(place))

    return rows.select(*ends, at(alpha / 2).alias("low"), at(1 - alpha / 2).alias("high"))


def _by_pairs(drawn: DataFrame, by: Sequence[str], side: str, pairs: DataFrame, value: str, grouped: Callable[[DataFrame, DataFrame], DataFrame], relational: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``grouped`` of the draws and pairs of all groups whose draws are up to NUMBERS numbers, ``relational`` of those of larger ones."""
    drawn = cut(drawn)
    numbers = F.size(value) if dict(drawn.dtypes)[value] == "array<double>" else F.aggregate(value, F.lit(0), lambda n, x: n + F.size(x))
    size = drawn.withColumn("_size", numbers).groupBy(*by).agg(F.sum("_size").alias("_size")).where(F.col("_size") > G.NUMBERS)
    if not size.take(1):
        return grouped(drawn, pairs)
    if not by:
        return relational(drawn, pairs)
    large = cut(size.select(*by))
    halves = [(drawn.join(large, list(by), how), pairs.join(large, list(by), how)) for how in ("left_anti", "left_semi")]
    return grouped(*halves[0]).unionByName(relational(*halves[1]))


def centroid_interval(means: DataFrame, by: Sequence[str], side: str, pairs: DataFrame, n_boot: int = 1000, seed: int = 0, collapse: bool = True, alpha: float = 0.05) -> DataFrame:
    """by, both sides, low, high: ``interval`` of ``bootstrap_centroid`` without a row for each draw."""

    def drift(a: dict, b: dict) -> np.ndarray:
        gap = a["mu"] - b["mu"]
        return np.where((a["n"] >= 2) & (b["n"] >= 2), (gap * gap).sum(axis=1) - a["noise"] - b["noise"], np.nan)

    return _by_pairs(
        _means_drawn(means, [*by, side], n_boot, seed, collapse), by, side, pairs, "mu",
        lambda drawn, pairs: G.ends(drawn, pairs, by, side, ["n", "mu", "noise"], drift, alpha),
        lambda drawn, pairs: _ends(_centroids_paired(drawn, by, side, pairs), by, side, alpha),
    )


def dispersion_interval(moments: DataFrame, by: Sequence[str], side: str, pairs: DataFrame, n_boot: int = 1000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """The same of ``bootstrap_dispersion``."""

    def ratio(a: dict, b: dict) -> np.ndarray:
        good = (a["tv"] > 0) & (b["tv"] > 0)
        return np.log(np.where(good, b["tv"], np.nan) / np.where(good, a["tv"], np.nan))

    return _by_pairs(
        _variances_drawn(moments, [*by, side], n_boot, seed), by, side, pairs, "tv",
        lambda drawn, pairs: G.ends(drawn, pairs, by, side, ["tv"], ratio, alpha),
        lambda drawn, pairs: _ends(_dispersions_paired(drawn, by, side, pairs), by, side, alpha),
    )


def bootstrap_dispersion(moments: DataFrame, by: Sequence[str], side: str, pairs: DataFrame, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """Draws of the log variance ratio of pairs of sides; the renditions of a bout drawn twice count twice."""
    return _one_by_one(_dispersion_arrays(moments, by, side, pairs, n_boot, seed), by, side, "log_ratio")


def _dispersion_arrays(moments: DataFrame, by: Sequence[str], side: str, pairs: DataFrame, n_boot: int, seed: int) -> DataFrame:
    return _dispersions_paired(_variances_drawn(moments, [*by, side], n_boot, seed), by, side, pairs)


def _variances_drawn(moments: DataFrame, keys: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    return G.by_size(
        moments.withColumnRenamed("n", "n_rows"), keys, ["n_rows", "sx", "sxx"],
        lambda bouts: G.resampled_variances(bouts, keys, n_boot, seed),
        lambda rows: _resampled_variances(rows.withColumnRenamed("n_rows", "n"), keys, n_boot, seed),
    )


def _dispersions_paired(drawn: DataFrame, by: Sequence[str], side: str, pairs: DataFrame) -> DataFrame:
    def ratio(d: Column) -> Column:
        good = (d["tva"] > 0) & (d["tvb"] > 0) & ~F.isnan(d["tva"]) & ~F.isnan(d["tvb"])
        return F.when(good, F.ln(d["tvb"] / d["tva"]))

    return _paired(pairs, by, side, drawn, {"tv": "tv"}, ratio)


def _resampled_variances(moments: DataFrame, keys: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    from driftloom.operators.moments import total_variance

    drawn = resamples(units_of(moments, keys), keys, n_boot, seed)
    rows = drawn.join(moments.select(*keys, "bout", "dim", "n", "sx", "sxx"), [*keys, "bout"])
    tv = total_variance(rows, [*keys, "draw"], F.col("w"))
    return tv.select(*keys, F.col("draw").alias("first"), F.array("tv").alias("tv"))


def interval(draws: DataFrame, by: Sequence[str], value: str, alpha: float = 0.05) -> DataFrame:
    """by, low, high: the exact percentile interval of the draws."""
    p = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return draws.groupBy(*by).agg(p.alias("_p")).select(*by, F.col("_p")[0].alias("low"), F.col("_p")[1].alias("high"))


def floor_of(null: DataFrame, by: Sequence[str], value: str, level: float = 0.95, absolute: bool = False) -> DataFrame:
    """by, n_draws, floor: a percentile of the null draws, pooled within ``by``; an individual's draws may be too many for one aggregate."""
    found = percentiles.of_groups(cut(null), by, F.abs(value) if absolute else F.col(value), level)
    return found.withColumnsRenamed({"n": "n_draws", "percentile": "floor"})
