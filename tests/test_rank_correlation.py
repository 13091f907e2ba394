"""Rank correlation of all pairs, in ranges and blocks, against the plain way."""

import itertools
import random

import numpy as np
import pytest

from driftloom.operators import fidelity as FD
from driftloom.operators.rankcorrelation import rank_correlation


def ranks(x):
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


@pytest.mark.parametrize("block, size", [(2048, 1 << 20), (16, 200), (40, 1)])
def test_rank_correlation_of_all_pairs_in_ranges(spark, block, size):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        z = [rng.randint(0, 3) / 2 for _ in range(3)]  # many ties, and equal points
        rows.append((i, "abc"[i % 3] if i % 50 else "few", z[:2], z))
    rows += [(200 + i, "same", [1.0, 2.0], [1.0, 2.0, 3.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, label string, z array<double>, reference array<double>")
    got = {r["label"]: (r["n_pairs"], r["rho"]) for r in rank_correlation(df, block, size).collect()}
    want = {}
    for label in {r[1] for r in rows}:
        those = [r for r in rows if r[1] == label]
        d = [[np.round(np.linalg.norm(np.subtract(p[k], q[k])), 9) for p, q in itertools.combinations(those, 2)] for k in (2, 3)]
        a, b = ranks(d[0]), ranks(d[1])
        want[label] = len(a), None if np.ptp(a) == 0 or np.ptp(b) == 0 else np.corrcoef(a, b)[0, 1]
    assert got.keys() == want.keys()
    for label, (n, rho) in want.items():
        assert got[label][0] == n
        assert got[label][1] == (None if rho is None else pytest.approx(rho, abs=1e-12))
    whole = {r["label"]: r["rho"] for r in FD.within_label_correlation(df, None).collect()}
    assert whole["same"] == 0.0 and whole["a"] == pytest.approx(want["a"][1], abs=1e-12)
