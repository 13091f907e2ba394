import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm import topk


def brute(vectors, k=10, scale=1024):
    """Each row one query, and one candidate of all others."""
    kept = [(i, np.floor(scale * np.array(v)).astype(np.int64)) for i, v in vectors]
    out = []
    for at, (q, x) in enumerate(kept):
        if q % 100 == 0:
            best = sorted((-int(x @ y), c) for i, (c, y) in enumerate(kept) if i != at)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [4096, 8])
def test_rows_that_repeat_stand_for_themselves(spark, shard_rows):
    rng = np.random.default_rng(2)
    vectors = [(20 * i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 6)).round(2))]
    for i in (3, 7, 10, 15, 20):
        vectors += [(20 * i, [4.0 * x for x in vectors[5 * i % 120][1]])] * 15  # copies near a query, of queries too
    vectors += vectors[:40]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    found = sorted(tuple(r) for r in topk.top_k(df, F.expr("vec_id % 100 = 0"), shard_rows=shard_rows, query_rows=32).collect())
    assert found == brute(vectors)
    embeddings = df.toArrow()
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    assert found == sorted(con.execute(topk.ORACLE).fetchall())


def test_bounds_leave_cells_out(spark):
    """Vectors in far clusters: a query goes to few of the cells, and the result is exact."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(16, 8)) * 50
    x = np.concatenate([c + rng.normal(size=(50, 8)) * 0.1 for c in centres]).round(3)
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    rows = topk.whole_numbers(df, 1024).withColumn("_dim", F.size("v")).withColumn("_row", F.col("vec_id"))
    trees = topk._top_trees(rows, 50)
    held = topk._dealt(rows, trees)
    radii = {(8, r[0]): r[1] for r in held.groupBy("_cell").agg(F.max("_away")).collect()}
    assert len(radii) == 16
    kth = {q: sorted((np.floor(1024 * x) @ np.floor(1024 * x[q])).tolist())[-10] for q in range(0, 800, 100)}
    asking = spark.createDataFrame([(int(q), [int(y) for y in np.floor(1024 * x[q])], 8, int(q), int(s)) for q, s in kth.items()], "vec_id long, v array<long>, _dim int, _row long, floor long")
    assert topk._sent(asking, trees, radii, 0, 16).count() < 16 * len(kth) / 3
    assert sorted(tuple(r) for r in topk.top_k(df, F.expr("vec_id % 100 = 0"), shard_rows=50).collect()) == brute(vectors)
