"""Line dedup by a log-template tree.

Every line that is not blank goes down a tree of fixed depth: the number of its tokens, then its
first three tokens, where a token with a digit, an @ or :// counts as a variable field. If at least
60 % of a line's tokens are left, fields apart it is its template; else only its exact tokens are, so
that rows of numbers are alike only if their numbers are. In a leaf, a token that fewer than a fifth
of the different lines have at its place is a variable field as well, again if at least 60 % of the
line's tokens are left. A template that recurs across documents is dropped from all of them but the
first, the one of the smallest doc_id.

Lines are parsed and hashed where they are read; counts are taken per line and document, then per
line. Words are needed only in leaves of more than five different lines, so texts are parsed a second
time through a sieve of these leaves. Joins spread what many lines have over several tasks. Texts are
shuffled once, to take the dropped lines out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import boxed, checkpoint, document_key, spread_join, table

FIELD = b"<*>"
#: What makes a token a variable field.
VARIABLE = "[0-9@]|://"
LEADING = 3
#: A template of this many tokens or more is dropped if so many documents have it; a shorter one, or one with fields found in a leaf, needs more.
WORDS, DOCS, SHORT_DOCS, FIELD_DOCS = 5, 2, 10, 10
#: The share of a line's tokens that a template keeps at least; one in so many of a leaf's lines have a token that is kept.
SAME, ONE_IN = 0.6, 5
#: Bits of the sieve of leaves, as a power of two.
SIEVE = 24
LAST = 2**63 - 1
N_LINES, N_DROPPED = "_line_dedup_lines", "_line_dedup_dropped"


def split_lines(text: str | Column = "text") -> Column:
    return F.split(text, "\n", -1)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _template(line: bytes, variable: re.Pattern) -> tuple[list[bytes], bool]:
    """The tokens by which a line is compared, and whether fields may be taken from it."""
    words = line.split()
    if not variable.search(line):
        return words, True
    masked = [FIELD if variable.search(w) else w for w in words]
    general = len(words) - masked.count(FIELD) >= SAME * len(words)
    return (masked if general else words), general


def _leaf(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b"%d " % len(words) + b" ".join(words[:LEADING]))


def parsed(docs: DataFrame) -> DataFrame:
    """One row per line that is not blank: _k1, _k2, _id, place, tokens, leaf, line, general."""
    names = ["_k1", "_k2", "_id", "place", "tokens", "leaf", "line", "general"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        variable, digest = re.compile(VARIABLE.encode()), xxhash.xxh64_intdigest
        for batch in batches:
            row, place, size, leaf, line, plain = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                for k, x in enumerate((text.as_py() or "").encode().split(b"\n")):
                    words, general = _template(x, variable)
                    if not words:
                        continue
                    row.append(i)
                    place.append(k)
                    size.append(len(words))
                    leaf.append(_leaf(words))
                    line.append(digest(b" ".join(words)))
                    plain.append(general)
            keys = [batch.column(c).take(pa.array(row, pa.int64())) for c in names[:3]]
            counts = [pa.array(x, pa.int32()) for x in (place, size)]
            columns = [*keys, *counts, _signed(leaf), _signed(line), pa.array(plain, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(*document_key(), F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("_id"), "text")
    return rows.mapInArrow(run, "_k1 long, _k2 int, _id long, place int, tokens int, leaf long, line long, general boolean")


def _sieve(leaves: DataFrame) -> np.ndarray:
    """A bit for each value of the first bits of the leaves: 2 MB, whatever their number."""
    first = leaves.select(F.shiftrightunsigned("leaf", 64 - SIEVE).alias("f"))
    words = first.groupBy(F.shiftright("f", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(f % 64 as int)))").alias("b"))
    out = np.zeros(1 << (SIEVE - 6), np.int64)
    for w, b in words.collect():  # 2**18 rows at most
        out[w] = b
    return out.view(np.uint64)


def _worded(docs: DataFrame, sieve: np.ndarray) -> DataFrame:
    """leaf, line, words and times of the different lines that fields may be taken from, of the leaves in the sieve (and some others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        variable, digest = re.compile(VARIABLE.encode()), xxhash.xxh64_intdigest
        for batch in batches:
            found, times = {}, Counter()
            for text in batch.column("text"):
                for x in (text.as_py() or "").encode().split(b"\n"):
                    words, general = _template(x, variable)
                    if not words or not general:
                        continue
                    leaf = _leaf(words)
                    at = leaf >> (64 - SIEVE)
                    if int(sieve[at >> 6]) >> (at & 63) & 1:
                        joined = b" ".join(words)
                        line = digest(joined)
                        found[line] = leaf, joined.decode()
                        times[line] += 1
            leaves, texts = zip(*found.values()) if found else ((), ())
            columns = [_signed(leaves), _signed(list(found)), pa.array(texts, pa.string()), pa.array([times[x] for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["leaf", "line", "words", "times"])

    rows = docs.select("text").mapInArrow(run, "leaf long, line long, words string, times long")
    return rows.groupBy("leaf", "line").agg(F.first("words").alias("words"), F.sum("times").alias("times"))


def _recurring(rows: DataFrame, by: list[str], least: Column) -> DataFrame:
    """``by``, first (the smallest id) and docs of what at least ``least`` documents have."""
    each = rows.groupBy(*by, "_k1", "_k2").agg(F.min("_id").alias("_id"), F.min("tokens").alias("tokens"))
    found = each.groupBy(*by).agg(F.count(F.lit(1)).alias("docs"), F.min("_id").alias("first"), F.min("tokens").alias("tokens"))
    return found.where(F.col("docs") >= least).select(*by, "first", "docs")


def templates(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """leaf, line, times, template of the lines that have variable fields beyond the masked ones."""
    different = lines.where("general").select("leaf", "line").distinct()
    leaves = different.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ONE_IN)
    leaves = checkpoint(leaves)
    worded = spread_join(_worded(docs, _sieve(leaves)), leaves, ["leaf"], "n")
    worded = checkpoint(worded.select("leaf", "line", "times", "n", F.split("words", " ").alias("words")))
    tokens = worded.select("leaf", "n", F.posexplode("words").alias("at", "token"))
    counts = tokens.groupBy("leaf", "at", "token").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
    often = (F.col("k") * ONE_IN >= F.col("n")) & (F.col("token") != FIELD.decode())
    kept = counts.groupBy("leaf", "at").agg(F.collect_list(F.when(often, F.col("token"))).alias("kept"), F.first("n").alias("n"))
    kept = kept.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("at", "kept"))).alias("kept"), F.first("n").alias("n"))
    found = spread_join(worded.drop("n"), kept, ["leaf"], "n")
    fixed = F.transform("words", lambda w, i: F.when(F.array_contains(F.get(F.col("kept"), i)["kept"], w), w))
    found = found.withColumn("fixed", fixed).withColumn("constants", F.size(F.filter("fixed", lambda w: w.isNotNull())))
    found = found.where((F.col("constants") < F.size("words")) & (F.col("constants") >= SAME * F.size("words")))
    return found.select("leaf", "line", "times", F.xxhash64("leaf", F.transform("fixed", lambda w: F.coalesce(w, F.lit(FIELD.decode())))).alias("template"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """_k1, _k2, drop: the places of the lines that go, for each document that loses any."""
    lines = checkpoint(parsed(docs))
    least = F.when(F.col("tokens") >= WORDS, DOCS).otherwise(SHORT_DOCS)
    same = _recurring(lines, ["leaf", "line"], least)
    general = checkpoint(templates(docs, lines))
    like = lines.where("general").select("leaf", "line", "_k1", "_k2", "_id", "tokens")
    often = _recurring(spread_join(like, general, ["leaf", "line"], "times"), ["template"], F.lit(FIELD_DOCS))
    like = spread_join(general, often, ["template"], "docs").select("leaf", "line", "first", F.col("times").alias("docs"))
    first = same.unionByName(like).groupBy("leaf", "line").agg(F.min("first").alias("first"), F.max("docs").alias("docs"))
    gone = spread_join(lines, first, ["leaf", "line"], "docs").where(F.col("_id") > F.col("first"))
    return gone.groupBy("_k1", "_k2").agg(F.collect_set("place").alias("drop"))


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, and the counts N_LINES and N_DROPPED.

    A null text stays null, with no lines; blank lines stay; a document may be left empty; a text or
    line of any length is read whole. Lines that repeat within one document only stay. Rows equal in
    doc_id and text are one document and get one result; rows that share the smallest doc_id of a
    template all keep it, and so do those without an id among themselves. An empty table gives an
    empty result; other columns pass through.
    """
    drops = dropped_lines(docs)
    text = F.col("_row.text")
    lines = split_lines(text)
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
    rest = F.array_join(F.transform(keep, lambda i: F.element_at(lines, i + 1)), "\n")
    rows = boxed(docs, *document_key()).join(drops, ["_k1", "_k2"], "left")
    rest = F.when(F.col("drop").isNull(), text).otherwise(rest)
    return rows.select(
        *[rest.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns],
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias(N_LINES),
        F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias(N_DROPPED),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table without recurring lines: counts and digest of what is left."""
    found = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col(N_LINES).alias("n_lines"),
        F.col(N_DROPPED).alias("n_dropped"),
        F.char_length("text").cast("long").alias("kept_chars"),
        F.md5("text").alias("kept_md5"),
    )


ORACLE = rf"""
with l0 as (select doc_id, md5(concat(coalesce(doc_id::varchar, 'null'), ':', text)) as k, coalesce(doc_id, {LAST}) as id,
    unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as place from documents where text is not null),
l1 as (select *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as exact from l0),
l2 as (select *, list_transform(exact, lambda w: case when regexp_matches(w, '{VARIABLE}') then '{FIELD.decode()}' else w end) as cut from l1 where len(exact) > 0),
l3 as (select *, len(list_filter(cut, lambda w: w <> '{FIELD.decode()}')) >= {SAME} * len(cut) or cut = exact as general from l2),
l4 as (select *, case when general then cut else exact end as words from l3),
l as (select *, len(words) as tokens, array_to_string(words, ' ') as masked, array_to_string(words[1:{LEADING}], ' ') as lead from l4),
same as (select masked, min(id) as first from l group by masked
    having count(distinct k) >= case when any_value(tokens) >= {WORDS} then {DOCS} else {SHORT_DOCS} end),
different as (select distinct tokens, lead, masked, words from l where general),
leaves as (select tokens, lead, count(*) as n from different group by all having n > {ONE_IN}),
w as (select tokens, lead, masked, n, unnest(words) as token, unnest(range(len(words))) as spot from different join leaves using (tokens, lead)),
c as (select tokens, lead, spot, token from w where token <> '{FIELD.decode()}' group by all having count(*) * {ONE_IN} >= any_value(n)),
t as (select tokens, lead, masked, list((spot, token) order by spot) as template, count(*) as kept from w semi join c using (tokens, lead, spot, token)
    group by all having kept < tokens and kept >= {SAME} * tokens),
often as (select t.tokens, t.lead, t.template, min(id) as first from l join t using (masked) where general group by all having count(distinct k) >= {FIELD_DOCS}),
firsts as (select masked, min(first) as first from
    (select * from same union all select t.masked, o.first from t join often o using (tokens, lead, template)) group by masked),
gone as (select distinct k, place from l join firsts using (masked) where id > first),
d as (select doc_id, text, md5(concat(coalesce(doc_id::varchar, 'null'), ':', text)) as k from documents),
kept as (select l0.k, string_agg(line, chr(10) order by place) as rest from
    (select distinct k, line, place from l0) l0 anti join gone using (k, place) group by l0.k),
n as (select k, count(*) as n from gone group by k)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::bigint as n_lines, coalesce(n.n, 0)::bigint as n_dropped,
    case when d.text is not null then length(coalesce(kept.rest, ''))::bigint end as kept_chars,
    case when d.text is not null then md5(coalesce(kept.rest, '')) end as kept_md5
from d left join kept using (k) left join n using (k)
"""
