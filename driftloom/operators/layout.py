"""A neighbour-graph embedding: vectors laid out in few dimensions so that near ones stay near.

The graph's edges are the exact nearest neighbours of the rows to fit on, found by cells and bounds
(:mod:`neighbours`), with a weight that falls from 1 at the nearest to what makes a row's weights
sum to log2 of their number; both directions of an edge are put together by probabilities. The layout
starts from principal components and moves the ends of edges together and other rows apart. It is
fitted on at most ``SAMPLE`` rows, in one place; every other row, however many there are, is then
put at the weighted mean of its nearest fitted rows by joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.lineage import cut
from driftloom.operators import neighbours as N

#: Rows that a layout is fitted on, at most, by a hash of their id.
SAMPLE = 20_000
NEAREST, EPOCHS, NEGATIVE = 15, 200, 5
#: The curve 1 / (1 + a d^2b) that stays near 1 up to a distance of 0.1 and then falls.
A, B = 1.577, 0.895
_ROUNDS = 48


def smooth(d: np.ndarray) -> np.ndarray:
    """Weights by distance (a row's neighbours in a row of ``d``, not a number where there are fewer): 1 at the nearest, log2(k) in all."""
    k = np.sum(~np.isnan(d), axis=1)
    least = np.nanmin(np.where(d > 0, d, np.nan), axis=1, initial=np.inf)
    least = np.where(np.isfinite(least), least, 0.0)[:, None]
    over = np.maximum(d - least, 0.0)
    target = np.log2(np.maximum(k, 2))
    low, high = np.zeros(len(d)), np.full(len(d), np.inf)
    width = np.ones(len(d))
    for _ in range(_ROUNDS):
        total = np.nansum(np.exp(-over / width[:, None]), axis=1)
        low, high = np.where(total < target, width, low), np.where(total < target, high, width)
        width = np.where(np.isinf(high), width * 2, (low + np.minimum(high, 1e300)) / 2)
        width = np.maximum(width, 1e-12)
    return np.exp(-over / width[:, None])


def weighted_neighbours(queries: DataFrame, train: DataFrame, k: int = NEAREST) -> DataFrame:
    """id, other, w: the weights of the ``k`` nearest rows of ``train``."""
    found = N.nearest(queries, train, k)
    kinds = dict(found.dtypes)
    rows = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("d2", "other"))).alias("near"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            d = np.full((len(frame), k), np.nan)
            for i, near in enumerate(frame["near"]):
                d[i, : len(near)] = np.sqrt([x["d2"] for x in near])
            w = smooth(d) if len(d) else d
            out = [(name, x["other"], w[i, j]) for i, (name, near) in enumerate(zip(frame["id"], frame["near"])) for j, x in enumerate(near)]
            yield pd.DataFrame(out, columns=["id", "other", "w"])

    return rows.mapInPandas(run, f"id {kinds['id']}, other {kinds['other']}, w double")


def edges(train: DataFrame, k: int = NEAREST) -> DataFrame:
    """a, b, w: the undirected edges, a < b: the probability that either direction holds."""
    near = weighted_neighbours(train, train, k)
    ends = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "w")
    return ends.groupBy("a", "b").agg((F.sum("w") - F.when(F.count(F.lit(1)) > 1, F.product("w")).otherwise(0.0)).alias("w"))


def laid_out(start: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> np.ndarray:
    """Positions after ``epochs`` rounds; in each an edge is taken as often as its weight says, with NEGATIVE other rows."""
    rng, x, n = np.random.default_rng(seed), start.copy(), len(start)
    share = w / w.max() if len(w) else w
    for epoch in range(epochs if n > 1 else 0):
        rate = 1 - epoch / epochs
        own = rng.random(len(a)) < share
        for p, q in ((a[own], b[own]), (b[own], a[own])):
            gap = x[p] - x[q]
            d2 = (gap * gap).sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                pull = np.where(d2 > 0, -2 * A * B * d2 ** (B - 1) / (1 + A * d2**B), 0.0)
            np.add.at(x, p, rate * np.clip(pull[:, None] * gap, -4, 4))
            for _ in range(NEGATIVE):
                other = rng.integers(0, n, len(p))
                gap = x[p] - x[other]
                d2 = (gap * gap).sum(axis=1)
                push = np.where(other == p, 0.0, 2 * B / ((0.001 + d2) * (1 + A * d2**B)))
                np.add.at(x, p, rate * np.clip(push[:, None] * gap, -4, 4))
    return x


def fitted(train: DataFrame, components: int, k: int = NEAREST, epochs: int = EPOCHS, seed: int = 0, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(the rows that are fitted on: id, label, z; their positions: id, p), of ``train`` with id, label and z."""
    rows = cut(train.select("id", "label", "z").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample))
    held = rows.orderBy("id").collect()  # ``sample`` rows at most
    if not held:
        raise ValueError("no rows to fit on")
    place = {r["id"]: i for i, r in enumerate(held)}
    z = np.array([r["z"] for r in held], np.float64)
    z = z - z.mean(axis=0)
    values, axes = np.linalg.eigh(z.T @ z)
    start = z @ axes[:, np.argsort(-values, kind="stable")[:components]]
    start = np.pad(start, ((0, 0), (0, components - start.shape[1])))
    start = start * (10 / max(np.abs(start).max(), 1e-12)) + np.random.default_rng(seed).normal(0, 1e-4, start.shape)
    links = sorted((place[r["a"]], place[r["b"]], r["w"]) for r in edges(rows, min(k, max(1, len(held) - 1))).collect())  # ``sample`` times k
    a, b, w = (np.array(c) for c in zip(*links)) if links else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    p = laid_out(start, a, b, w, epochs, seed)
    kind = dict(rows.dtypes)["id"]
    return rows, cut(train.sparkSession.createDataFrame([(r["id"], v) for r, v in zip(held, p.tolist())], f"id {kind}, p array<double>"))


def placed(df: DataFrame, rows: DataFrame, positions: DataFrame, k: int = NEAREST) -> DataFrame:
    """``df`` (id, label, z, ...) with z replaced by its position: a fitted row's own, else the weighted mean of its neighbours'."""
    asked = df.join(positions.select("id"), "id", "left_anti")
    near = weighted_neighbours(asked, rows, k).join(F.broadcast(positions.withColumnRenamed("id", "other")), "other")  # SAMPLE rows at most
    parts = near.select("id", "w", F.posexplode("p").alias("dim", "x")).groupBy("id", "dim")
    means = parts.agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x")).groupBy("id")
    means = means.agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("z"))
    both = means.unionByName(positions.withColumnRenamed("p", "z"))
    return df.drop("z").join(both, "id")
