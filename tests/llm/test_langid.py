import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm import langid

from . import data

COLUMNS = ("doc_id", "held_out", "lang_pred", "score")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def network(documents):
    return langid.fitted(documents, 600)


def plain(network, text):
    """The mean probabilities of a text, filter by filter and byte by byte."""
    codes = list(text.encode())
    total, n = np.zeros(len(network.languages)), 0
    for at in range(0, max(1, len(codes)), langid.WINDOW):
        own = codes[at : at + langid.WINDOW]
        padded = own + [langid.PAD] * (langid.WINDOW + 8 - len(own))
        top = []
        for k, f in enumerate(network.filters):
            for j in range(langid.FILTERS):
                values = [
                    sum(network.embedding[padded[t + i]] @ f[i, :, j] for i in range(len(f))) for t in range(langid.WINDOW)
                ]
                top.append(max(0, max(values) + network.bias[k * langid.FILTERS + j]))
        z = np.exp(np.array(top) @ network.dense + network.offset)
        total += len(own) * z / z.sum()
        n += len(own)
    return total / n


def test_lookups_equal_convolutions_over_whole_texts(spark, network):
    texts = ["Der Hund und die Katze.", "x", "la maison " * 40 + "the end of it all", "é" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in langid.identified(docs, network).collect()}
    for i, text in enumerate(texts):
        want = plain(network, text)
        assert found[i]["lang_pred"] == network.languages[int(want.argmax())]
        assert abs(found[i]["score"] - want.max()) < 1e-4


def test_held_out_texts_are_predicted(documents, network):
    rows = langid.identified(documents, network).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == documents.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    own = [r for r in rows if r["held_out"]]
    assert len(own) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in own) / len(own) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_rows_and_other_columns_do_not_reach_the_network(documents):
    changed = documents.withColumn("source", F.lit("x")).withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang")))
    changed = changed.withColumn("text", F.when(langid.held_out(), "nothing").otherwise(F.col("text")))
    a, b = langid.fitted(documents, 40), langid.fitted(changed, 40)
    assert a.languages == b.languages
    assert np.array_equal(a.dense, b.dense) and np.array_equal(a.embedding, b.embedding)


def test_odd_rows(spark, network):
    docs = data.clashing(data.docs(spark)).withColumns({c: F.lit("x") for c in ("letters", "held_out", "w", "_share")})
    extra = spark.createDataFrame([(400, "12 ½ ... !?", "en", "s", 3), (401, "日本語", None, "s", 3)], data.DOCS)
    docs = docs.unionByName(data.clashing(extra).withColumns({c: F.lit("x") for c in ("letters", "held_out", "w", "_share")}))
    found = langid.identify(docs, 30).collect()
    assert len(found) == docs.count()
    by_id = {r["doc_id"]: r for r in found}
    for i in (100, 101, 103, 400):
        assert (by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0)
    assert {r["lang_pred"] for r in found} <= {"en", "de", "und"}
    assert by_id[401]["lang_pred"] != "und"
    assert not any(r["held_out"] for r in found if r["doc_id"] is None)
    assert len({(r["lang_pred"], r["score"]) for r in found if r["doc_id"] == 106}) == 1
    assert langid.identify(data.empty(spark)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}
    one = docs.withColumn("lang", F.lit("en"))
    assert {r["lang_pred"] for r in langid.identify(one).collect()} == {"en", "und"}


def test_copies_of_one_text_do_not_fill_the_sample(spark):
    copies = spark.range(3000).selectExpr("1L as doc_id", "'copy of a text' as text", "'en' as lang")
    others = spark.range(2, 300).selectExpr("id as doc_id", "concat('ein anderer ', id) as text", "'de' as lang")
    assert langid.fitted(copies.unionByName(others), 100).languages == ("de", "en")
