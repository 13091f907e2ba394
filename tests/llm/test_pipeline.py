import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftloom.llm import registry

from . import data
from .test_operators import check_packing

SF = "/root/testdata/sf0.001"


def test_every_stage_follows_from_its_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append(docs)
    assert all(d.columns == seen[0].columns for d in seen[:-1])
    n = [d.count() for d in seen]
    assert n[0] > n[1] >= n[2] == n[1] > n[3]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = labels.where("quality = 1").join(seen[0], "doc_id", "left_semi")
    assert good.join(seen[1], "doc_id", "left_semi").count() > 0.97 * good.count()
    assert seen[2].where(F.char_length("text") != F.col("n_chars")).count() == 0
    check_packing([tuple(r) for r in seen[4].select("doc_id", "text").collect()], seen[5].collect())


def test_stages_stand_odd_rows(spark):
    odd = data.clashing(data.docs(spark))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, odd, SF)
        assert found.columns == odd.columns
        assert found.where("_row = 'x_row'").count() == found.count() <= 2 * odd.count()
        nothing = stage(spark, data.empty(spark), SF)
        assert nothing.columns == data.empty(spark).columns
        assert nothing.count() == 0
    packed = corpus_pipeline.STAGES[-1][1]
    check_packing(data.rows(), packed(spark, odd, SF).collect())
    assert packed(spark, data.empty(spark), SF).count() == 0


def test_run_equals_its_stages(spark):
    first = corpus_pipeline.run(spark, SF)
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = registry.QUERIES[name](spark, SF)
    result = con.execute(registry.ORACLES[name])
    at = [[c[0] for c in result.description].index(c) for c in found.columns]
    assert sorted(repr(tuple(r)) for r in found.collect()) == sorted(repr(tuple(w[i] for i in at)) for w in result.fetchall())
