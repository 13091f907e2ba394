"""A group's bouts go to the tasks of its draws packed into a few rows, and to no more tasks than all groups together need."""

import numpy as np
import pytest

from driftloom.operators import draws as G


def moments(spark, n=400):
    rng = np.random.default_rng(5)
    rows = [(None if i % 3 == 0 else "ab"[i % 2], i % 2, f"bout{i}", d, 2 + i % 3, *map(float, rng.gamma(2, 1, 2))) for i in range(n) for d in range(2)]
    df = spark.createDataFrame(rows, "label string, day long, bout string, dim int, n_rows long, sx double, sxx double")
    return df.repartition(3).withColumn("sxx", df.sxx + df.sx * df.sx)


def test_pieces_hold_every_bout_of_every_group_once(spark):
    by, values = ["label", "day"], ["n_rows", "sx", "sxx"]
    bouts = G.packed(moments(spark), by, values)
    found = sorted((str(r["label"]), r["day"], b, r["sx"][2 * i : 2 * i + 2]) for r in G.in_pieces(bouts, by, values).collect() for i, b in enumerate(r["bout"]))
    assert found == sorted((str(r["label"]), r["day"], r["bout"], r["sx"]) for r in bouts.collect())


@pytest.mark.parametrize("by", [["label", "day"], []])
def test_draws_do_not_hang_on_how_bouts_are_packed_and_shared_out(spark, monkeypatch, by):
    values = ["n_rows", "sx", "sxx"]
    bouts = G.packed(moments(spark), by, values).localCheckpoint()

    def drawn():
        rows = G.resampled_variances(bouts, by, 60, 1).collect()
        out = {}
        for r in sorted(rows, key=lambda r: r["first"]):
            out.setdefault(tuple(r[c] for c in by), []).extend(r["tv"])
        return out, len(rows)

    whole, shares = drawn()
    assert shares == len(whole) and all(len(v) == 60 for v in whole.values())
    monkeypatch.setattr(G, "SHARE", 50)
    monkeypatch.setattr(G, "PACKED", 1)
    monkeypatch.setattr(G, "TASKS", 12)
    again, shares = drawn()
    assert len(whole) < shares <= 12 + len(whole)  # not one for every 50 choices
    assert again.keys() == whole.keys() and all(np.allclose(again[k], whole[k], rtol=1e-12) for k in whole)
