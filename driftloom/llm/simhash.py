"""SimHash near-duplicates by anchor-point covering.

Fingerprints are compared per table, a choice of their bits. The anchors of a table are a covering
code: a Hamming [15, 11] codeword on 15 bits (every value has one within 1 bit) and any value of its
other bits. Two values that differ in one bit share every anchor within covering radius of either,
so it is enough that each fingerprint stands at its own anchor and visits those within radius plus
threshold, 1 + 1 bits (of the plain bits, within 1); of a pair, the one with the smaller anchor is
the visitor. A table may also ask for equal values: then all values are anchors, radius and
threshold are 0.

``EXACT`` (64 bits, links at 4 or fewer): two fingerprints that differ in at most 4 bits differ, in
the bits 0-23, 24-47 and 48-63, in at most one bit of the first, or at most one of the second, or in
none of the third (2 + 2 + 1 > 4), so no link is missed. A random pair meets with a probability of
2e-5. ``MANY``, for 2**27 fingerprints and more, cuts the 64 bits into seven parts, of which four
bits leave three alone: its tables are the 35 choices of three parts, and a random pair meets in one
of them with a probability of 3e-7.

The fingerprints at one anchor are compared with numpy, and only a spanning forest of the links is
passed on, so a dense group of near copies costs links in proportion to its size, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import boxed, checkpoint, components, partitions, table

SEED = 42
SHINGLE = 4
HAMMING = 15
#: Anchors of at most this many fingerprints are compared together, shifted against one another.
SMALL = 16
#: Anchors up to this size are compared own with all; larger ones by breadth-first search.
SQUARE = 2048
#: Posting rows that are gathered before a spanning forest is passed on.
CHUNK = 200_000
#: From so many distinct fingerprints on, ``MANY`` is taken.
LARGE = 2**27


@dataclass(frozen=True)
class Table:
    """The bits that a table looks at, as (first bit, width) parts, none across a word's end, and the differing bits it forgives."""

    parts: tuple[tuple[int, int], ...]
    threshold: int

    @property
    def width(self) -> int:
        return sum(w for _, w in self.parts)

    def values(self, fp: np.ndarray) -> np.ndarray:
        out = np.zeros(len(fp), np.uint64)
        for first, width in self.parts:
            bits = (fp[:, first // 64] >> np.uint64(first % 64)) & np.uint64((1 << width) - 1)
            out = (out << np.uint64(width)) | bits
        return out.astype(np.int64)


@dataclass(frozen=True)
class Scheme:
    """64-bit words of a fingerprint, differing bits of a link, and the tables that find the links."""

    words: int
    limit: int
    tables: tuple[Table, ...]

    @property
    def names(self) -> list[str]:
        return [f"f{i}" for i in range(self.words)]


_SEVENTHS = ((0, 9), (9, 9), (18, 9), (27, 9), (36, 9), (45, 9), (54, 10))
EXACT = Scheme(1, 4, (Table(((0, 24),), 1), Table(((24, 24),), 1), Table(((48, 16),), 0)))
MANY = Scheme(1, 4, tuple(Table(parts, 0) for parts in combinations(_SEVENTHS, 3)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """The XXH64 of every word shingle of a text, repeats included; a shorter text is one shingle; none without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in tokens))
    starts = [0, *ends[: len(tokens) - size]]
    found = (digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :]))
    return np.fromiter(found, np.uint64, len(starts))


def majority(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """The SimHash of some hashes as 64-bit words, 0 without any: the bits set in over half of them.

    The first word counts the hashes' own bits, the further ones those of hashes made from them.
    """
    counts = np.zeros(64 * words, np.int64)
    for i in range(0, len(hashes), 255):
        h = hashes[i : i + 255]
        wide = [h, *(_mixed(h + np.uint64(w * 0x9E3779B97F4A7C15 % 2**64)) for w in range(1, words))]
        octets = np.stack(wide, axis=1).astype("<u8").view(np.uint8).reshape(len(h), -1)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8").astype(np.uint64)


def fingerprint(text: str | None) -> np.ndarray:
    """The 64-bit SimHash of all four-word shingles of a text, repeats included."""
    return majority(shingle_hashes(text, SHINGLE))


def matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1).view(np.uint64)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), fp (the fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).reshape(-1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), signed(fp)], ["doc_id", "h", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, h long, fp long")


def _nearest(x: np.ndarray) -> np.ndarray:
    """The Hamming syndromes of 15-bit values: 0 at a codeword, else the place of the wrong bit."""
    s = np.zeros(len(x), np.int64)
    for place in range(1, HAMMING + 1):
        s ^= ((x >> (place - 1)) & 1) * place
    return s


def block_anchors(value: np.ndarray, width: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, anchors, visiting): each block value at its own anchor and, with threshold 1, at the larger ones that it visits."""
    rows = np.arange(len(value))
    if not threshold:
        return rows, value, np.zeros(len(value), bool)
    code, plain = value & ((1 << HAMMING) - 1), value >> HAMMING
    s = _nearest(code)
    home = code ^ np.where(s > 0, 1 << np.maximum(s - 1, 0), 0)
    own = (plain << HAMMING) | home
    out_rows, out = [rows], [own]
    for bit in range(width - HAMMING):
        out_rows.append(rows)
        out.append(((plain ^ (1 << bit)) << HAMMING) | home)
    for j in range(1, HAMMING + 1):
        other = s ^ j
        found = (s > 0) & (j < other)
        word = code ^ (1 << (j - 1)) ^ (1 << np.maximum(other - 1, 0))
        out_rows.append(rows[found])
        out.append(((plain << HAMMING) | word)[found])
    row, anchor = np.concatenate(out_rows), np.concatenate(out)
    keep = anchor >= own[row]
    return row[keep], anchor[keep], (anchor > own[row])[keep]


def anchors(nodes: DataFrame, scheme: Scheme, keep: tuple[str, ...] = ()) -> DataFrame:
    """anchor (its lowest bit set for visitors), ``keep`` (long columns) and the words: each row at all its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                part = whole.slice(k, 2000)
                fp = matrix(part, scheme.names)
                rows, at = [], []
                for i, t in enumerate(scheme.tables):
                    row, anchor, visiting = block_anchors(t.values(fp), t.width, t.threshold)
                    rows.append(row)
                    at.append(((anchor | (i << 40)) << 1) | visiting)
                row = np.concatenate(rows)
                kept = [part.column(c).take(pa.array(row)) for c in keep]
                columns = [pa.array(np.concatenate(at)), *kept, *map(signed, fp[row].T)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", *keep, *scheme.names])

    names = [*keep, *scheme.names]
    return nodes.select(*names).mapInArrow(run, ", ".join(f"{n} long" for n in ["anchor", *names]))


def by_anchor(nodes: DataFrame, scheme: Scheme, keep: tuple[str, ...] = ()) -> DataFrame:
    """``anchors``, dealt so that the rows of an anchor follow one another in one partition, its own before its visitors."""
    n = partitions(nodes.sparkSession)
    return anchors(nodes, scheme, keep).repartition(n, F.shiftright("anchor", 1)).sortWithinPartitions("anchor")


def whole_anchors(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The anchor column and the ``names`` columns of sorted rows, in pieces of some CHUNK rows that end where an anchor ends."""
    held, rows = [], 0
    for batch in batches:
        at = batch.column("anchor").to_numpy(zero_copy_only=False)
        held.append((at, matrix(batch, names)))
        rows += len(at)
        if rows >= CHUNK and held[0][0][0] >> 1 != at[-1] >> 1:
            at, values = (np.concatenate(x) for x in zip(*held))
            last = int(np.searchsorted(at >> 1, at[-1] >> 1))
            yield at[:last], values[:last]
            held, rows = [(at[last:], values[last:])], len(at) - last
    if rows:
        yield tuple(np.concatenate(x) for x in zip(*held))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what ``a``, ``b`` connect: each node with the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, new = np.minimum(label[i], label[j]), label.copy()
        for k in (i, j):
            np.minimum.at(new, k, low)
            np.minimum.at(new, label[k], low)
        new = new[new]
        if np.array_equal(new, label):
            linked = label != np.arange(len(nodes))
            return nodes[linked], nodes[label[linked]]
        label = new


def near(x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int16) <= limit


def _large(fp: np.ndarray, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of one anchor, by place, by breadth-first search over what is not reached yet."""
    rest, out = np.arange(len(fp)), []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            now, front = front[:64], front[64:]
            hit = np.zeros(len(rest), bool)
            for x in now:
                new = near(fp[rest], fp[x], limit) & ~hit
                if new.any():
                    hit |= new
                    out.append((rest[new], np.full(int(new.sum()), x)))
            front, rest = np.concatenate([front, rest[hit]]), rest[~hit]
    return out


def groups(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each anchor begins, its size, and how many of its rows are its own."""
    place = at >> 1
    begin = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return begin, np.diff(np.r_[begin, len(at)]), np.add.reduceat((at & 1) == 0, begin, dtype=np.int64)


def small_pairs(at: np.ndarray, fp: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of the near pairs in anchors of at most SMALL rows, all anchors at once."""
    _, size, own = groups(at)
    small = np.flatnonzero(np.repeat((size <= SMALL) & (size > 1) & (own > 0), size))
    a = at[small] >> 1
    for shift in range(1, SMALL):
        same = np.flatnonzero(a[shift:] == a[:-shift])
        if not len(same):
            return
        p, q = small[same], small[same + shift]
        hit = near(fp[p], fp[q], limit)
        yield p[hit], q[hit]


def block_pairs(left: np.ndarray, right: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of the near pairs of two lists of fingerprints, some 128 times 4,096 at a time."""
    for i in range(0, len(left), 128):
        for j in range(0, len(right), 4096):
            p, q = np.nonzero(near(left[i : i + 128, None], right[None, j : j + 4096], limit))
            if len(p):
                yield p + i, q + j


def links(at: np.ndarray, fp: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each anchor; ``at`` is sorted, an anchor's own before its visitors."""
    begin, size, own = groups(at)
    out = list(small_pairs(at, fp, limit))
    big = (size > SMALL) & (own > 0)
    for k, n, m in zip(begin[big], size[big], own[big]):
        x = fp[k : k + n]
        found = _large(x, limit) if n > SQUARE else block_pairs(x[:m], x, limit)
        out += [(p + k, q + k) for p, q in found]
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*out) if out else ((), ())))
    return forest(fp[a, 0], fp[b, 0])


def near_links(fps: DataFrame, scheme: Scheme = EXACT) -> DataFrame:
    """Links ``a``, ``b`` that connect the distinct fingerprints ``f0`` that the scheme links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, fp in whole_anchors(batches, scheme.names):
            yield pa.RecordBatch.from_arrays([*map(signed, links(at, fp, scheme.limit))], ["a", "b"])

    return by_anchor(fps, scheme).mapInArrow(run, "a long, b long")


def near_components(docs: DataFrame, scheme: Scheme | None = None) -> DataFrame:
    """doc_id, h (a hash of the text), fp (the fingerprint), root, component_id of every row of ``docs``.

    Links are those at four bits or fewer, whichever ``scheme`` finds them; the default goes by the
    number of fingerprints. Null and wordless texts have fingerprint 0 and are linked like any other;
    a text of any length is read whole; rows with one fingerprint are one node, so repeated rows and
    ties cost nothing; a null doc_id is never the smallest, and a component without any other has a
    null component_id; an empty table gives an empty result; no column but doc_id and text is read.
    """
    fps = checkpoint(fingerprints(docs))
    distinct = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    if scheme is None:
        scheme = EXACT if distinct.count() < LARGE else MANY
    found = near_links(distinct.select(F.col("fp").alias("f0")), scheme)
    return with_components(fps, distinct, components(found))


def with_components(fps: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, h, fp, root, component_id of the rows of ``fps``; ``distinct`` has fp, first (its smallest doc_id), ``roots`` node, root."""
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    linked = checkpoint(linked)
    named = linked.join(linked.groupBy("root").agg(F.min("first").alias("component_id")), "root")
    return fps.select("doc_id", "h", "fp").join(named.select("fp", "root", "component_id"), "fp")


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs``, one for each component of ``found`` (doc_id, h, root, component_id): that of the smallest doc_id.

    Of rows that share this id the one whose text has the smallest hash stays, and of rows equal in
    both the one whose other columns have the smallest hash; a component without any id keeps a row
    in the same way.
    """
    found = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = found.groupBy("root", "doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    best = kept.groupBy("root", "doc_id").agg(F.min("h").alias("h"), F.min_by("n", "h").alias("n"))
    best = checkpoint(best.select(F.col("doc_id").alias("_id"), F.col("h").alias("_kept"), "n"))
    rows = boxed(docs, F.xxhash64("text").alias("_h"), F.col("doc_id").alias("_own"))

    def chosen(best: DataFrame) -> DataFrame:
        return rows.join(best, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_kept")), "left_semi")

    if not best.where("n > 1").take(1):
        return chosen(best).select("_row.*")
    repeated = chosen(best.where("n > 1")).groupBy("_own", "_h").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return chosen(best.where("n = 1")).select("_row.*").unionByName(repeated.select("_row.*"))


def hexed(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of the whole ``documents`` table."""
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexed().alias("fingerprint"), "component_id")
