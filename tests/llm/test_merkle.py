import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from driftloom.llm import merkle

from . import data

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def code(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(doc_id, text, lang, source, n_chars):
    return digest(*map(code, (doc_id, source, lang, n_chars, text)))


def climbed(nodes, fanout):
    """The root, and the siblings of every node by level as (before, after)."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(where):
            run = at // fanout * fanout
            own = nodes[run : run + fanout]
            paths[k].append(("".join(own[: at - run]), "".join(own[at - run + 1 :])))
        nodes = [digest(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        where = [at // fanout for at in where]
    return nodes[0], paths


def plain(rows, fanout=3):
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append(r)
    trees = []
    for s in sorted(sources, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees.append((own, *climbed([leaf_of(*r) for r in own], fanout)))
    root, above = climbed([t[1] for t in trees], fanout)
    for (own, subroot, paths), high in zip(trees, above):
        for r, path in zip(own, paths):
            path = path + high
            doc_id, text, *rest = r
            if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            h = leaf_of(doc_id, text, *rest)
            for before, after in path:
                h = digest(before, h, after)
            yield doc_id, leaf_of(*r), subroot, root, digest(*[b + a for b, a in path]), h, h == root


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest_equals_a_plain_tree_on_odd_rows(spark, fanout):
    rows = [*data.rows(50), *data.rows(50)[:1] * 4, (300, "é\n\nü", None, "ünï", None), (301, "a", "en", "z", 1)]
    docs = data.clashing(spark.createDataFrame(rows, data.DOCS)).withColumns({c: F.lit("x") for c in ("leaf", "other", "_g", "_n", "_path")})
    found = merkle.manifest(docs, fanout=fanout)
    want = sorted(plain(rows, fanout), key=repr)
    assert data.as_rows(found, *COLUMNS) == want
    assert {w[-1] for w in want} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_sizes_around_whole_runs(spark, n):
    rows = [(i, f"line\n{i}", "en", "only", i) for i in range(n)]
    assert data.as_rows(merkle.manifest(spark.createDataFrame(rows, data.DOCS)), *COLUMNS) == sorted(plain(rows), key=repr)


def test_an_empty_table_and_many_sources(spark):
    assert merkle.manifest(data.empty(spark)).count() == 0
    rows = [(i, "t", "en", f"host{i % 40}" if i % 3 else None, i) for i in range(200)]
    assert data.as_rows(merkle.manifest(spark.createDataFrame(rows, data.DOCS)), *COLUMNS) == sorted(plain(rows), key=repr)


def test_a_hot_source_and_repeated_rows_are_dealt_to_all_tasks(spark):
    rows = spark.range(12000).selectExpr("if(id % 2 = 0, 'hot', concat('s', id % 50)) as source", "if(id % 3 = 0, 7, id) as doc_id")
    found = merkle.ranked(rows.repartition(4), "source", "doc_id")
    assert sorted(r[0] for r in found.select("_at").collect()) == list(range(12000))
    ordered = [tuple(r) for r in found.orderBy("_at").select("source", "doc_id").collect()]
    assert ordered == sorted(ordered)
    held = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(held) < 5000


def test_sql_agrees(spark):
    folder = "/root/testdata/sf0.001"
    want = duckdb.sql(merkle.ORACLE.replace("from documents", f"from '{folder}/documents.parquet'")).select(*COLUMNS).fetchall()
    assert data.as_rows(merkle.op12_merkle_manifest(spark, folder), *COLUMNS) == sorted(want, key=repr)
