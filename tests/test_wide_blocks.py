"""Blocks of bounded size and tiles: neighbours and silhouettes of vectors whose bounds exclude nothing."""

import numpy as np
import pandas as pd
import pytest

from driftloom.operators import fidelity as FD
from driftloom.operators import neighbours as N


@pytest.mark.parametrize("k", [1, 5, 60])
def test_best_of_tiles_equals_best(monkeypatch, k):
    monkeypatch.setattr(N, "TILE", 16)
    rng = np.random.default_rng(3)
    z = rng.integers(0, 3, (50, 2)).astype(float)  # many ties
    b = pd.DataFrame({"id": rng.permutation(50), "label": np.arange(50) % 3, "z": list(z)})
    a = b.iloc[:30]
    got = N.best_of_tiles(a, b, k).sort_values(["id", "d2", "other"]).reset_index(drop=True)
    want = N.best(a, b, N.squared_distances(N.stacked(a["z"]), N.stacked(b["z"])), k).sort_values(["id", "d2", "other"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_vectors_without_clusters_meet_wide_blocks_not_every_cell(spark, monkeypatch):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(600, 24))
    df = spark.createDataFrame([(i, i % 4, z[i].tolist()) for i in range(600)], "id long, label long, z array<double>")
    visits = []
    monkeypatch.setattr(N, "BLOCK", 200)
    found = N.nearest(df, df, 3, cell=10, counted=visits)
    got = {(r["id"], r["rank"]): r["other"] for r in found.collect()}
    d = ((z[:, None] - z[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = d.argsort(axis=1)[:, :3]
    assert got == {(i, r + 1): near[i, r] for i in range(600) for r in range(3)}
    assert sum(visits) < 0.2 * 600 * 600  # the rest by wide blocks
    silhouette = FD.silhouette(df).first()[0]
    e = np.sqrt(np.where(np.isinf(d), 0, d))
    label = np.arange(600) % 4
    sums = np.stack([e[:, label == c].sum(axis=1) for c in range(4)], axis=1)
    own = sums[np.arange(600), label] / 149
    other = np.min(np.where(label[:, None] == np.arange(4), np.inf, sums / 150), axis=1)
    assert silhouette == pytest.approx(np.mean((other - own) / np.maximum(own, other)), abs=1e-9)  # a row with itself: 0 by differences, some 1e-8 by products
