"""The sweep takes many short files in one call."""

import random

import numpy as np

from driftloom.operators import matching as MT


def test_short_files_share_a_call_and_keep_their_counts(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f, i, round(10 * i + rng.uniform(0, 4), 3), t) for f in range(300) for i in range(rng.randint(0, 4)) for t in (True, False) if rng.random() < 0.9]
    sides = [spark.createDataFrame([(f, g, x, x + 1) for f, i, x, s in rows if s is t for g in "ab"], "file long, part string, onset_s double, offset_s double") for t in (True, False)]
    calls, swept = spark.sparkContext.accumulator(0), MT._swept

    def spy(frame, *more):
        calls.add(1)
        return swept(frame, *more)

    monkeypatch.setattr(MT, "_swept", spy)
    found = MT.boundary_counts(*sides, ["file", "part"], "onset_s", 1.5).collect()
    assert calls.value == 1  # not one for each of the 600
    want = {}
    for f in {r[0] for r in rows}:
        true, pred = (np.array(sorted(x for g, _, x, s in rows if g == f and s is t)).reshape(-1, 1) for t in (True, False))
        want |= {(f, g): (len(true), len(pred), MT._greedy(true, pred, 1.5)) for g in "ab"}
    assert {(r["file"], r["part"]): (r["n_true"], r["n_pred"], r["n_matched"]) for r in found} == want
    assert 0 < sum(m for _, _, m in want.values()) < len(rows)
