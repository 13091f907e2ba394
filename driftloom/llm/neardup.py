"""Near-duplicates by the exact Jaccard similarity of distinct five-word shingles.

Candidates come from the anchor-point covering of :mod:`simhash`, over 256-bit SimHashes of the
distinct shingles. Sets of similarity 0.8 have a cosine of 0.89, so each bit differs with a
probability of 0.15, and two fingerprints in 39 bits, 5.7 being the standard deviation; near are
those that differ in 60 bits or fewer. A table looks at ``width`` bits and forgives one; there are
as many tables as a pair at 0.8 needs to meet in one of them with a probability of 0.995, and width
grows with the number of rows, so that an anchor holds few rows that only chance has led there.

Candidates are checked by their whole sets, and only pairs of similarity 0.8 or more are links. The
documents of a component of links are near copies of each other. Sets that are equal are one node.

A dense group would have as many candidates as pairs. So candidates come in two passes: first each
node with the first of its near nodes in each third of the tables (by a hash that is the same
everywhere, so a group gathers round few nodes). Then, of the nodes that had any, those that are near
to a node which the checked links do not connect them with yet: these are joined by the rarest
shingles of their sets (a prefix filter, which loses no pair at 0.8), so that sets that only share
what is frequent, as pages of one template do, are never brought together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import FEW_KEYS, checkpoint, components, looked_up, partitions
from driftloom.llm.simhash import (
    SEED,
    SMALL,
    SQUARE,
    Scheme,
    Table,
    block_pairs,
    by_anchor,
    forest,
    groups,
    majority,
    near,
    one_of_each,
    shingle_hashes,
    signed,
    small_pairs,
    whole_anchors,
    with_components,
)

SHINGLE = 5
#: Least similarity, as a fraction.
OVER, UNDER = 4, 5
#: Nodes of a block; columns of shingles that are multiplied at once; rows gathered before groups are compared.
BLOCK, COLUMNS, ROWS = 256, 4096, 2000
WORDS, LIMIT, RECALL = 4, 60, 0.995
#: Bits of a table at least: those of the code.
LEAST_WIDTH = 15
#: Candidates of one node that a group of the check holds, about.
SPOKES = 512
#: Cells of the table of shingles' frequencies; sets of a token that are compared as pairs, at most.
CELLS, FEW = 1 << 18, 8
#: Centres of a large anchor at least; candidates of a node that it checks, at most.
CENTRES, FIRST = 64, 3


def scheme_for(rows: int) -> Scheme:
    """The tables for so many distinct sets."""
    width = max(LEAST_WIDTH, math.ceil(math.log2(max(rows, 2))) - 4)
    similarity = OVER / UNDER
    differs = math.acos(2 * similarity / (1 + similarity)) / math.pi
    meets = (1 - differs) ** width + width * differs * (1 - differs) ** (width - 1)
    count = math.ceil(math.log(1 - RECALL) / math.log(1 - meets))
    per = 64 * WORDS // width
    tables = []
    for i in range(count):  # side by side as far as the bits go, then again over the bits in another order
        bits = np.random.default_rng(i // per).permutation(64 * WORDS) if i >= per else np.arange(64 * WORDS)
        tables.append(Table(tuple((int(b), 1) for b in bits[i % per * width :][:width]), 1))
    return Scheme(WORDS, LIMIT, tuple(tables))


def shingles(text: str | None) -> np.ndarray:
    """The distinct five-word shingles of a text, hashed and sorted; a shorter text is one shingle; none without words."""
    return np.unique(shingle_hashes(text, SHINGLE))


def name(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def _fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), fp (the node), any (whether it has words), f0, ... (the SimHash) of every row."""
    words = [f"f{i}" for i in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column("text")]
            simhashes = np.array([majority(s, WORDS) for s in sets], np.uint64).reshape(-1, WORDS)
            columns = [pa.array([name(s) for s in sets], pa.int64()), pa.array([len(s) > 0 for s in sets]), *map(signed, simhashes.T)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *columns], ["doc_id", "h", "fp", "any", *words])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", "h long", "fp long", "any boolean", *(f"{w} long" for w in words)])
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, schema)


def _sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """node, shingles (their bytes) of the texts whose hashes are ``needed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([name(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "shingles"])

    few = needed.count() <= FEW_KEYS  # else as a join whose hot keys Spark splits
    texts = docs.select(F.xxhash64("text").alias("h"), "text").join(F.broadcast(needed) if few else needed, "h", "left_semi")
    return texts.groupBy("h").agg(F.first("text").alias("text")).mapInArrow(run, "node long, shingles binary")


def _rank(node: np.ndarray) -> np.ndarray:
    """An order of nodes that is the same at every anchor."""
    return node * np.uint64(0x9E3779B97F4A7C15)


def centred(at: np.ndarray, fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, node, anchor): at each anchor, each node with the first of its near nodes in rank order.

    Of an anchor of over SQUARE rows nodes become centres in rank order, each taking what is near to it
    and not taken yet, until few are left; these and the centres are then compared with all, so every
    node that has near nodes is there.
    """
    begin, size, own = groups(at)
    p, q = [], []
    for a, b in small_pairs(at, fp, LIMIT):
        p += [a, b]
        q += [b, a]
    big = (size > SMALL) & (own > 0)
    for k, n, m in zip(begin[big], size[big], own[big]):
        x = fp[k : k + n]
        if n <= SQUARE:
            for a, b in block_pairs(x[:m], x, LIMIT):
                p += [a + k, b + k]
                q += [b + k, a + k]
            continue
        rest, centres = np.argsort(_rank(node[k : k + n]), kind="stable"), []
        while len(rest) and (len(centres) < CENTRES or len(rest) > SQUARE):
            centre, rest = rest[0], rest[1:]
            centres.append(centre)
            hit = near(x[rest], x[centre], LIMIT)
            p.append(np.full(int(hit.sum()), centre + k))
            q.append(rest[hit] + k)
            rest = rest[~hit]
        alone = np.r_[np.array(centres, np.int64), rest]
        for a, b in block_pairs(x[alone], x, LIMIT):
            a = alone[a]
            a, b = a[a != b], b[a != b]
            order = np.lexsort((_rank(node[b + k]), a))
            order = order[np.r_[True, a[order][1:] != a[order][:-1]]] if len(order) else order
            p.append(b[order] + k)
            q.append(a[order] + k)
    none = np.zeros(0, np.int64)
    p, q = np.concatenate([none, *p]), np.concatenate([none, *q])
    order = np.lexsort((_rank(node[p]), q))
    first = order[np.r_[True, q[order][1:] != q[order][:-1]]] if len(order) else order
    return node[p[first]], node[q[first]], at[q[first]]


def unconnected(at: np.ndarray, fp: np.ndarray, node: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one, other): all near pairs of the anchors whose roots differ; at a large anchor the other is in its largest component, if either is."""
    begin, size, own = groups(at)
    out = []
    for a, b in small_pairs(at, fp, LIMIT):
        keep = root[a] != root[b]
        out.append((a[keep], b[keep]))
    big = (size > SMALL) & (own > 0)
    for k, n, _m in zip(begin[big], size[big], own[big]):
        roots, times = np.unique(root[k : k + n], return_counts=True)
        inside = root[k : k + n] == roots[times.argmax()]
        order = np.r_[np.flatnonzero(~inside), np.flatnonzero(inside)] + k
        rest = int((~inside).sum())
        mine = (at[order] & 1) == 0
        for a, b in block_pairs(fp[order[:rest]], fp[order], LIMIT):
            keep = (a < b) & (mine[a] | mine[b])
            a, b = order[a[keep]], order[b[keep]]
            keep = root[a] != root[b]
            out.append((a[keep], b[keep]))
    none = np.zeros(0, np.int64)
    a, b = (np.concatenate([none, *x]) for x in (zip(*out) if out else ((), ())))
    return node[a], node[b]


def _first_candidates(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs ``a``, ``b``: each node b with the first node in rank order that is near to it, for FIRST parts of the tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, values in whole_anchors(batches, [*scheme.names, "fp"]):
            a, b, anchor = centred(at, values[:, : scheme.words], values[:, scheme.words])
            part = (anchor >> 41) % FIRST
            columns = [signed(_rank(a) ^ np.uint64(1 << 63)), signed(a), signed(b), pa.array(part.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["rank", "a", "b", "part"])

    found = by_anchor(nodes, scheme, ("fp",)).mapInArrow(run, "rank long, a long, b long, part int")
    best = found.groupBy("b", "part").agg(F.min(F.struct("rank", "a")).alias("x"))
    return best.select("x.a", "b").where("a <> b").distinct()


def _candidates(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """Links ``a``, ``b`` that connect the near nodes whose roots differ: a spanning forest of those of some anchors at a time."""
    keep = ("fp", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, values in whole_anchors(batches, [*scheme.names, *keep]):
            a, b = forest(*unconnected(at, values[:, : scheme.words], *values[:, scheme.words :].T))
            yield pa.RecordBatch.from_arrays([signed(a), signed(b)], ["a", "b"])

    return by_anchor(nodes, scheme, keep).mapInArrow(run, "a long, b long")


def similar(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The places of all pairs whose Jaccard similarity is 0.8 or more."""
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), size)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float64)
    for first in range(0, int(shared.sum()), COLUMNS):
        at = slice(*np.searchsorted(column, [first, first + COLUMNS]))
        held = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - first)), np.float32)
        held[row[at], column[at] - first] = 1
        common += held @ held.T
    linked = (OVER + UNDER) * common >= OVER * (size[:, None] + size[None, :])
    return np.nonzero(np.triu(linked, 1))


def _links(members: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that connect the nodes of each bucket as its similar pairs do; ``members`` has bucket, lo, hi, node, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[tuple, int, bytes]] = []

        def passed() -> pa.RecordBatch:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            begin = 0
            for end in range(1, len(held) + 1):
                if end < len(held) and held[end][0] == held[begin][0]:
                    continue
                if end - begin > 1:
                    names = np.array([x[1] for x in held[begin:end]], np.int64)
                    a, b = similar([np.frombuffer(x[2], np.uint64) for x in held[begin:end]])
                    if len(a):
                        out.append(forest(names[a], names[b]))
                begin = end
            a, b = (np.concatenate(x) for x in zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for x in batch.to_pylist():
                key = (x["bucket"], x["lo"], x["hi"])
                if len(held) >= ROWS and held[-1][0] != key:
                    yield passed()
                    held.clear()
                held.append((key, x["node"], x["shingles"]))
        if held:
            yield passed()

    n = partitions(members.sparkSession)
    dealt = members.repartition(n, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return dealt.mapInArrow(run, "a long, b long")


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How often shingles occur in ``sets``, by cell (a shingle modulo CELLS): a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for raw in batch.column("shingles"):
                np.add.at(total, (np.frombuffer(raw.as_buffer(), np.uint64) % CELLS).astype(np.int64), 1)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], ["cell", "n"])

    rows = sets.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # CELLS rows at most
    out = np.zeros(CELLS, np.int64)
    for cell, n in rows:
        out[cell] = n
    return out


def prefix(found: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, so many that sets at 0.8 or more share one of them; without those that no other set has."""
    n = often[(found % CELLS).astype(np.int64)]
    most = len(found) + OVER * len(found) // -UNDER + 1
    first = np.lexsort((found, n))[:most]
    return found[first[n[first] > 1]]


def _postings(members: DataFrame, often: np.ndarray) -> DataFrame:
    """token, node, root: the prefix of every set of ``members`` (node, root, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [prefix(np.frombuffer(raw.as_buffer(), np.uint64), often) for raw in batch.column("shingles")]
            row = pa.array(np.repeat(np.arange(len(parts)), [len(x) for x in parts]))
            token = np.concatenate([np.zeros(0, np.uint64), *parts])
            yield pa.RecordBatch.from_arrays([signed(token), *(batch.column(c).take(row) for c in ("node", "root"))], ["token", "node", "root"])

    return members.mapInArrow(run, "token long, node long, root long")


def _buckets(postings: DataFrame) -> DataFrame:
    """token, n, main of the tokens whose sets are not all connected; of tokens that the same sets have, one.

    ``main`` is the root of most of a token's sets: these are connected, and are not compared with one another.
    """
    roots = postings.groupBy("token", "root").agg(
        F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.shiftright(F.xxhash64("node", F.lit(1)), 24)).alias("y")
    )
    tokens = roots.groupBy("token").agg(
        F.sum("k").alias("n"), F.bit_xor("x").alias("x"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("roots"),
        F.max(F.struct("k", "root"))["root"].alias("main"),
    )
    return tokens.where("roots > 1").groupBy("n", "x", "y").agg(F.min(F.struct("token", "main")).alias("t")).select("t.*", "n")


def _compared(candidates: DataFrame, rooted: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the pairs at 0.8 or more among the nodes that ``candidates`` have: by the prefixes of their sets, which is exact.

    Pages of one template share what is frequent, and their prefixes hold what is rare, so sets of
    which a fifth or more is their own meet nobody. Tokens of few sets give pairs, FEW * FEW / 2 at
    most; the sets of the others are compared block against block, those outside the token's main
    component with all.
    """
    ends = candidates.select(F.col("a").alias("fp")).unionByName(candidates.select(F.col("b").alias("fp"))).distinct()
    members = ends.join(rooted.select("fp", "root"), "fp").withColumnRenamed("fp", "node")
    members = checkpoint(members.join(sets, "node"))
    postings = checkpoint(_postings(members, _frequencies(members)))
    held = checkpoint(looked_up(postings, _buckets(postings), ["token"]).where("n is not null"))

    few = held.where(F.col("n") <= FEW)
    other = few.select("token", F.col("node").alias("b"), F.col("root").alias("_root"))
    pairs = few.join(other, "token").where("node < b and root <> _root").select(F.col("node").alias("a"), "b").distinct()
    found = _checked(checkpoint(pairs), sets)

    many = held.where(F.col("n") > FEW).withColumn("_out", F.col("root") != F.col("main"))
    size = many.groupBy("token").agg(*[F.ceil(F.count_if(c) / BLOCK).cast("int").alias(k) for k, c in (("_outer", F.col("_out")), ("_inner", ~F.col("_out")))])
    many = many.join(size, "token")
    # blocks of the outer sets are numbered first; each meets itself, the later ones and all inner ones
    block = lambda n: F.pmod(F.xxhash64("node", F.lit(2)), F.greatest(F.lit(1), F.col(n))).cast("int")
    many = many.withColumn("_block", F.when(F.col("_out"), block("_outer")).otherwise(F.col("_outer") + block("_inner")))
    last = F.when(F.col("_out"), F.col("_outer") + F.col("_inner") - 1).otherwise(F.col("_outer") - 1)
    many = many.withColumn("_other", F.explode(F.sequence(F.lit(0), last)))
    many = many.select(F.col("token").alias("bucket"), F.least("_block", "_other").alias("lo"), F.greatest("_block", "_other").alias("hi"), "node")
    return found.unionByName(_links(many.join(sets, "node")))


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose similarity is 0.8 or more; those of one ``a`` are dealt out by some SPOKES at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for x, salt, y, raw in zip(*(batch.column(c) for c in ("a", "salt", "b", "shingles"))):
                found = np.frombuffer(raw.as_buffer(), np.uint64)
                if y.as_py() is None:
                    key, centre = (x, salt), found
                    continue
                if key != (x, salt):
                    raise ValueError("a pair without its first set")
                size = len(found) + len(centre)
                if OVER * size > (OVER + UNDER) * min(len(found), len(centre)):
                    continue
                common = len(np.intersect1d(found, centre, assume_unique=True))
                if (OVER + UNDER) * common >= OVER * size:
                    a.append(x.as_py())
                    b.append(y.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SPOKES).cast("int").alias("parts"))
    salt = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    spokes = pairs.join(parts, "a").select("a", salt.alias("salt"), "b")
    spokes = spokes.join(sets.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "shingles")
    centres = parts.join(sets.withColumnRenamed("node", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "shingles"
    )
    n = partitions(pairs.sparkSession)
    dealt = centres.unionByName(spokes).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return dealt.mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, scheme: Scheme | None = None) -> DataFrame:
    """doc_id, h (a hash of the text), fp (the node), root, component_id of every row of ``docs``.

    Null and wordless texts are one node; rows with one set of shingles are one node, so repeated
    rows and ties cost nothing; a text of any length is read whole; a null doc_id is never the
    smallest, and a component without any other has a null component_id; an empty table gives an
    empty result; no column but doc_id and text is read.
    """
    fps = checkpoint(_fingerprints(docs))
    words = [f"f{i}" for i in range(WORDS)]
    firsts = [F.first(c).alias(c) for c in ("any", *words)]
    nodes = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("h").alias("h"), *firsts))
    scheme = scheme or scheme_for(nodes.count())
    pairs = checkpoint(_first_candidates(nodes.where("any"), scheme))
    ends = pairs.select(F.col("b").alias("fp")).unionByName(pairs.select(F.col("a").alias("fp"))).distinct()
    needed = checkpoint(nodes.join(ends, "fp", "left_semi"))
    sets = checkpoint(_sets(docs, needed.select("h")))
    links = checkpoint(_checked(pairs, sets))
    rooted = needed.join(components(links).withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fp"))
    rooted = checkpoint(rooted)
    links = links.unionByName(_compared(checkpoint(_candidates(rooted, scheme)), rooted, sets))
    return with_components(fps, nodes.select("fp", "first"), components(links))


def one_of_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, one of each component of near copies, as ``simhash.one_of_each`` chooses it."""
    return one_of_each(docs, near_copies(docs))
