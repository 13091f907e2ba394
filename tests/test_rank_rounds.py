"""Pairs on their way to their ranks: few bytes, labels in rounds, and no files left of a round."""

import random

import numpy as np
import pytest

from driftloom.operators import rankcorrelation as RC

SCHEMA = "id long, label string, z array<double>, reference array<double>"


def rho_of(points):
    x = np.array([p for p in points])
    at = np.triu_indices(len(x), 1)
    ranks = []
    for k in (2, x.shape[1]):
        d = np.round(np.sqrt(((x[:, None, :k] - x[None, :, :k]) ** 2).sum(axis=2)), 9)[at]
        _, which, n = np.unique(d, return_inverse=True, return_counts=True)
        ranks.append((np.cumsum(n) - (n - 1) / 2)[which])
    return np.corrcoef(*ranks)[0, 1]


def shuffled(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def test_a_pair_takes_nine_bytes_at_most():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 512, 64))
    x, y = RC.distances(a[:, :16], b[:, :16]).ravel(), RC.distances(a, b).ravel()
    edges = np.sort(x)[np.arange(1, 100) * len(x) // 100]
    parts = list(RC._parted(x, y, None, edges))
    assert sum(n for _, n, *_ in parts) == len(x)
    assert sum(len(blob) for part in parts for blob in part[4:]) <= 9 * len(x)


def test_equal_pairs_of_a_range_count_together():
    x, y = np.full(50_000, 7), np.arange(50_000) % 3
    ((p, n, *_, w),) = RC._parted(x, y, None, np.array([7]))
    assert (p, n, np.frombuffer(w, np.int64).sum()) == (1, 3, 50_000)


def test_distances_of_any_size_keep_their_order():
    zero = np.zeros((1, 1))
    d = [int(RC.distances(zero, np.array([[v]]))[0, 0]) for v in (0.0, 1e-9, 3.0, 4e6, 5e6, 5e6 + 1, 1e12, 1e150)]
    with np.errstate(all="ignore"):
        none = int(RC.distances(zero, np.array([[np.nan]]))[0, 0])
    assert d[:3] == [0, 1, 3_000_000_000] and sorted(set(d)) == d and none > d[-1]


def test_labels_ranked_in_rounds_leave_no_shuffle_files(spark, monkeypatch):
    rng = random.Random(2)
    points = {label: [[rng.gauss(0, 1) for _ in range(4)] for _ in range(n)] for label, n in (("a", 300), ("b", 250), ("c", 30))}
    points["ties"] = [[float(rng.randint(0, 1)), 1.0, float(rng.randint(0, 1))] for _ in range(300)]
    rows = [(i, label, p[:2], p) for label, some in points.items() for i, p in enumerate(some)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(RC, "AT_ONCE", 50_000)
    large = ["a", "b", "ties"]
    sizes = df.groupBy("label").count().withColumnRenamed("count", "_n")
    rounds = [{r[0] for r in sizes.where(c).select("label").collect()} for c in RC._rounds(sizes, large)]
    assert sorted(map(sorted, rounds)) == [["a"], ["b"], ["c"], ["ties"]]
    before, setting = shuffled(spark), spark.conf.get(RC._CLEANED)
    found = {r["label"]: r["rho"] for r in RC.rank_correlation(df, 64, 5000).collect()}
    assert shuffled(spark) - before < 500_000  # 121,045 pairs
    assert spark.conf.get(RC._CLEANED) == setting
    assert found == {label: pytest.approx(rho_of(some), abs=1e-12) for label, some in points.items()}
