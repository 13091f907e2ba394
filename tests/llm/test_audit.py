import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
from pyspark.sql import functions as F

from driftloom.llm import audit

from . import data

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failing(rows):
    """The letters that each (doc_id, text, part) fails."""
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    for doc_id, text, part in rows:
        text = text or ""
        words = WORD.findall(text)
        upper = sum("A" <= c <= "Z" for c in text)
        yield doc_id, part or "", "".join(
            letter
            for letter, fails in (
                ("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)), ("C", 100 * upper > 10 * len(text)),
                ("D", bool(set("#$%&*|") & set(text))), ("E", doc_id is not None and doc_id > first[text]),
            ) if fails
        )


def plain(rows, labels):
    """Every order of the filters, applied one document after the other."""
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    out = {}
    parts = defaultdict(list)
    for doc_id, part, fails in failing(rows):
        parts[part].append((doc_id, fails))
    for part, own in parts.items():
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left, gone = list(own), []
            for step, letter in enumerate(order, 1):
                lost = [x for x in left if letter in x[1]]
                redundant = sum(letter in x[1] for x in gone)
                left = [x for x in left if letter not in x[1]]
                gone += lost
                removed_by[letter] += len(lost)
                out[part, "".join(order), step] = [
                    len(left), len(lost), redundant, sum(x[1] == letter for x in own),
                    sum(x[0] in good for x in lost), sum(x[0] in toxic for x in lost),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def test_steps_equal_every_order_run_on_odd_rows(spark):
    rng_rows = data.rows(40)
    extra = [(200, "A B C " * 60, None, "s", 1), (201, "A B C " * 60, "de", "s", 1), (202, "word" + " other#" * 120, "en", "s", 1)]
    rows = [*rng_rows, *extra, *extra[:1] * 3]
    docs = data.clashing(spark.createDataFrame(rows, data.DOCS)).withColumns({c: F.lit("x") for c in ("part", "fails", "bit", "step", "good")})
    labels = [(200, 1, 0), (201, 1, 1), (201, 0, None), (None, 1, 1), (20, 1, 0), (22, None, 1), (106, 0, 1), (9999, 1, 1)]
    found = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = plain([(r[0], r[1], r[2]) for r in rows], [x for x in labels if x[0] is not None])
    assert data.as_rows(found, *COLUMNS) == sorted(want, key=repr)


def test_fewer_filters_and_an_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(data.empty(spark), labels).count() == 0
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (3, "yy")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    found = audit.audit(docs, labels, {"S": F.char_length("_text") < 2}, repeated="R").orderBy("filter_order", "step").collect()
    assert [(r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in found] == [
        ("RS", 1, 2, 1, 0, 0, 1), ("RS", 2, 1, 1, 1, 1, 3), ("SR", 1, 1, 2, 0, 1, 3), ("SR", 2, 1, 0, 1, 0, 1),
    ]


def test_a_text_of_a_third_of_all_rows_is_in_no_task_alone(spark):
    docs = spark.range(9000).selectExpr("id as doc_id", "if(id % 3 = 0, 'copy', concat('text ', id)) as text", "'en' as lang")
    failed = audit.failures(docs, audit.text_filters())
    assert failed.where("fails >= 16").count() == 2999
    whole = failed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert whole < 9000


def test_sql_agrees(spark):
    folder = "/root/testdata/sf0.001"
    want = duckdb.sql(
        audit.ORACLE.replace("from documents", f"from '{folder}/documents.parquet'").replace("from labels", f"from '{folder}/labels.parquet'")
    )
    found = data.as_rows(audit.op11_filter_interaction(spark, folder), *COLUMNS)
    assert found == sorted(want.select(*COLUMNS).fetchall(), key=repr)
    assert len(found) == 600 * len({r[0] for r in found})
