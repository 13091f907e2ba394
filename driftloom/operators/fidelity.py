"""How well an embedding keeps labels apart and keeps the order of distances within them.

All-pairs distances are worked out block against block: vectors are dealt into blocks of bounded
size, and a task holds one block of either side and the distances of a tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.functions.scalars import squared_distance
from driftloom.operators import neighbours as N
from driftloom.operators.clean import stratified_cap
from driftloom.operators.rankcorrelation import rank_correlation
from driftloom.operators.sessions import average_ranks

#: Rows up to which neighbours are looked for among all.
DIRECT = 4 * N.BLOCK


def nearest(queries: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """id, other, other_label, d2, rank: the ``k`` nearest rows of ``train``, other than itself, ties to the smaller id.

    Both have id, label and z. A few blocks are compared with all; larger tables by cells and bounds.
    """
    if train.count() > DIRECT:
        return N.nearest(queries, train, k)
    kinds = dict(train.dtypes)
    schema = f"id {kinds['id']}, other {kinds['id']}, other_label {kinds['label']}, d2 double"
    found = N.against(queries.select("id", "z"), train.select("id", "label", "z"), lambda a, b: N.best_of_tiles(a, b, k), schema)
    rank = F.row_number().over(W.partitionBy("id").orderBy("d2", "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_recovery(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """id, label, predicted: the majority of the ``k`` nearest labels, ties to the smaller label."""
    if k > train.count() or test.isEmpty():
        raise ValueError("k is larger than the training set, or there is nothing to test")
    votes = nearest(test, train, k).groupBy("id", "other_label").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(W.partitionBy("id").orderBy(F.desc("n"), "other_label"))
    won = votes.withColumn("_r", first).where("_r = 1").select("id", F.col("other_label").alias("predicted"))
    return test.select("id", "label").join(won, "id")


def purity(points: DataFrame) -> DataFrame:
    """One row, purity: the share of points whose nearest other point has their label."""
    near = nearest(points, points, 1).select("id", "other_label")
    same = (F.col("label") == F.col("other_label")).cast("double")
    return points.select("id", "label").join(near, "id").agg(F.avg(same).alias("purity"))


def silhouette(points: DataFrame) -> DataFrame:
    """One row, silhouette: the mean over points, by Euclidean distance; points alone in their label count 0."""
    sizes = points.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    if sizes.limit(2).count() < 2:
        raise ValueError("need two labels or more")

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names, which = np.unique(b["label"].to_numpy(), return_inverse=True)
        total = np.zeros((len(a), len(names)))
        for at, to, d in N.tiles(a, b):
            one = np.zeros((d.shape[1], len(names)))
            one[np.arange(len(one)), which[to]] = 1
            total[at] += np.sqrt(d, out=d) @ one
        return pd.DataFrame({"id": np.repeat(a["id"], len(names)), "own": np.repeat(a["label"], len(names)), "label": np.tile(names, len(a)), "total": total.ravel()})

    kinds = dict(points.dtypes)
    rows = points.select("id", "label", "z")
    found = N.against(rows, rows, sums, f"id {kinds['id']}, own {kinds['label']}, label {kinds['label']}, total double")
    means = found.groupBy("id", "own", "label").agg(F.sum("total").alias("total")).join(F.broadcast(sizes), "label")
    own = F.col("own") == F.col("label")
    each = means.groupBy("id").agg(
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
    )
    score = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    return each.agg(F.avg(score).alias("silhouette"))


def within_label_correlation(points: DataFrame, max_pairs: int | None = 20_000, seed: int = 0) -> DataFrame:
    """label, n_pairs, rho: rank correlation of the distances by ``z`` and by ``reference`` among pairs of a label.

    Labels of fewer than three points are left out; constant distances give 0. Pairs are as many as a
    label's points squared, so the statistic is one of a sample: a label's points are taken by hash
    until they have ``max_pairs`` pairs. With None all pairs count.
    """
    enough = points.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("label")
    rows = points.join(enough, "label", "left_semi")
    if max_pairs is not None:
        rows = stratified_cap(rows, ["label"], "id", int((1 + (1 + 8 * max_pairs) ** 0.5) / 2), seed)
    found = rank_correlation(rows)
    return found.select("label", "n_pairs", F.coalesce("rho", F.lit(0.0)).alias("rho"))


def correlation(x: str, y: str) -> Column:
    """Pearson's, null where either side does not vary."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def pair_weighted(rhos: DataFrame) -> DataFrame:
    return rhos.agg((F.sum(F.col("rho") * F.col("n_pairs")) / F.sum("n_pairs")).alias("rho"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row, n and rho, of two columns of a small result."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.lit(0).alias("_g"), x, y)
    ranked = average_ranks(average_ranks(rows, ["_g"], x, "_x"), ["_g"], y, "_y")
    return ranked.agg(F.count(F.lit(1)).alias("n"), correlation("_x", "_y").alias("rho"))
