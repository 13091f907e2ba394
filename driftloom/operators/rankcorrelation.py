"""Rank correlation over all pairs of a group's points, without a group in one task.

The distances of two blocks of points are worked out in a task and leave it packed, by range of the
first measure. A task per range sorts its pairs and passes them on by range of the second, with their
place in the range. A task per range of the second sorts again and adds up products of places. Places
in the whole follow from the number of pairs in the ranges before, so every pair has its exact rank
(ties share the mean of theirs). Ranges are cut by quantiles among some points; all pairs are ranked.

Pairs travel as whole numbers in no more bytes than they need, some 15 for both shuffles. Labels are
taken in rounds, and a round's shuffles are deleted before the next, so the disk holds the pairs of a
round only: as many as ``AT_ONCE``, or those of the largest label.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.functions.lineage import cut
from driftloom.operators import neighbours as N

#: Points of a block, two of which make a range of pairs at most; pairs of a range, about; points by which ranges are cut.
BLOCK, RANGE, CUT_BY = 1024, 1 << 21, 512
#: Pairs of the labels that are ranked in one round, unless one label has more.
AT_ONCE = 1 << 31
#: Distances from which on whole numbers are not billionths but the bits of the number, which have the same order.
FAR = float(1 << 22)
#: Pairs from which on equal ones count together, if most are equal.
MANY = 4096
#: The kinds of numbers that hold so many bytes, the lowest first.
_KINDS = {1: ("u1",), 2: ("<u2",), 3: ("<u2", "u1"), 4: ("<u4",), 5: ("<u4", "u1"), 6: ("<u4", "<u2"), 7: ("<u4", "<u2", "u1"), 8: ("<u4", "<u4")}
#: Deletes the files of a query's shuffles when it has ended.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, in whole billionths (see ``FAR``); of near points by their differences, as products cancel."""
    d = N.squared_distances(a, b)
    scale = 1e-4 * max(1e-300, float((a * a).sum(axis=1).max(initial=0)) + float((b * b).sum(axis=1).max(initial=0)))
    for i, j in _chunks(*np.nonzero(d < scale)):
        d[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1)
    np.sqrt(d, out=d)
    far = ~(d < FAR)
    if not far.any():
        d *= 1e9
        return np.rint(d, out=d).astype(np.int64)
    bits = np.where(np.isnan(d), np.nan, d).view(np.int64)
    return np.where(far, bits, np.rint(np.where(far, 0, d) * 1e9).astype(np.int64))


def _chunks(i: np.ndarray, j: np.ndarray, size: int = 1 << 16):  # noqa: ANN202
    for begin in range(0, len(i), size):
        yield i[begin : begin + size], j[begin : begin + size]


def _ordered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(``x`` in order, the places they come from); by one sort of numbers that hold both, where there is room."""
    low, bits = int(x.min()), (len(x) - 1).bit_length()
    if int(x.max()) - low >= 1 << (63 - bits):
        order = np.argsort(x, kind="stable")
        return x[order], order
    key = (x - low) << bits
    key |= np.arange(len(x))
    key.sort()
    order = key & ((1 << bits) - 1)
    key >>= bits
    key += low
    return key, order


def _firsts(s: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers begin in ``s``, which are in order."""
    return np.flatnonzero(np.r_[True, s[1:] != s[:-1]])


def _packed(v: np.ndarray, ends: list[tuple[int, int]]) -> list[bytes]:
    """Whole numbers from 0 on, by the parts ``ends``, each number in as many bytes as the largest needs."""
    planes, shift = [], 0
    for kind in _KINDS[max(1, -(-int(v.max()).bit_length() // 8))]:
        planes.append((v >> shift).astype(kind))
        shift += 8 * planes[-1].itemsize
    return [b"".join(p[a:b].tobytes() for p in planes) for a, b in ends]


def _unpacked(blobs: pd.Series, counts: pd.Series, bases: pd.Series | None = None) -> np.ndarray:
    """The numbers of all parts, one after the other; ``bases`` are added to those of each."""
    out, at = np.empty(int(counts.sum()), np.int64), 0
    for k, (blob, n) in enumerate(zip(blobs, counts)):
        part, begin, shift = out[at : at + n], 0, 0
        part[:] = 0 if bases is None else bases.iloc[k]
        for kind in _KINDS[len(blob) // n]:
            plane = np.frombuffer(blob, kind, n, begin).astype(np.int64)
            part += plane << shift if shift else plane
            begin, shift = begin + n * np.dtype(kind).itemsize, shift + 8 * np.dtype(kind).itemsize
        at += n
    return out


def _weights(frame: pd.DataFrame) -> np.ndarray | None:
    """How many pairs each one stands for; None where all are one."""
    if not frame["_w"].map(len).any():
        return None
    return np.concatenate([np.frombuffer(w, np.int64) if w else np.ones(n, np.int64) for w, n in zip(frame["_w"], frame["_n"])])


def _parted(x: np.ndarray, y: np.ndarray, w: np.ndarray | None, edges: np.ndarray) -> Iterator[tuple]:
    """(range, pairs, first x, least y, x, y, w) by range of ``x``, packed; pairs that are equal in both count together where most are."""
    s, order = _ordered(x)
    y, w = y[order], None if w is None else w[order]
    ends = np.r_[0, np.searchsorted(s, edges, side="left"), len(s)]
    found = [(p, a, b) for p, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if b > a]
    tied = [p for p, a, b in found if b - a > MANY and 2 * np.count_nonzero(s[a + 1 : b] == s[a : b - 1]) > b - a]
    if tied:
        many = np.ones(len(s), np.int64) if w is None else w.copy()
        kept = np.ones(len(s), bool)
        for p, a, b in found:
            if p in tied:
                by = np.lexsort((y[a:b], s[a:b]))
                y[a:b], these = y[a:b][by], many[a:b][by]
                first = np.flatnonzero(np.r_[True, (s[a + 1 : b] != s[a : b - 1]) | (y[a + 1 : b] != y[a : b - 1])])
                kept[a:b] = False
                kept[a + first] = True
                many[a + first] = np.add.reduceat(these, first)
        s, y, w = s[kept], y[kept], many[kept]
        before = np.r_[0, np.cumsum(kept)]
        found = [(p, int(before[a]), int(before[b])) for p, a, b in found]
    at = [(a, b) for _, a, b in found]
    first = s[[a for a, _ in at]]
    least = int(y.min())
    xs = _packed(s - np.repeat(first, [b - a for a, b in at]), at)
    ys = _packed(y - least, at)
    ws = [b""] * len(at) if w is None else [w[a:b].tobytes() for a, b in at]
    for (p, a, b), f, *blobs in zip(found, first.tolist(), xs, ys, ws):
        yield p, b - a, f, least, *blobs


def _places(s: np.ndarray, w: np.ndarray | None) -> np.ndarray:
    """Twice each number's rank among ``s``, which are in order and count ``w`` times each; ties share the mean."""
    first = _firsts(s)
    long = np.diff(np.r_[first, len(s)])
    if w is None:
        return np.repeat(2 * first + long + 1, long)
    many = np.add.reduceat(w, first)
    return np.repeat(2 * np.cumsum(many) - many + 1, long)


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """The files of shuffles are deleted as soon as a query has ended."""
    before = spark.conf.get(_CLEANED, None)
    spark.conf.set(_CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANED) if before is None else spark.conf.set(_CLEANED, before)


def rank_correlation(points: DataFrame, block: int = BLOCK, size: int = RANGE) -> DataFrame:
    """label, n_pairs, rho (null where a side does not vary): of the distances by z and by reference of all pairs of a label.

    ``points`` has id, label, z and reference; pairs are those of different ids.
    """
    rows = points.where("label is not null and z is not null and reference is not null").select("id", "label", "z", "reference")
    kind = dict(rows.dtypes)["label"]
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    ranges = F.ceil(F.col("_n") * (F.col("_n") - 1) / 2 / size).cast("int")
    by_hash = F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
    some = rows.join(sizes.where(ranges > 1), "label").withColumn("_k", by_hash).where(F.col("_k") <= CUT_BY)

    def cuts(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n, out = int(frame["_n"].iloc[0]), []
        parts = -(-(n * (n - 1) // 2) // size)
        for c in ("z", "reference"):
            v = N.stacked(frame[c])
            d = np.sort(distances(v, v)[np.triu_indices(len(v), 1)])
            out.append(np.unique(d[np.arange(1, parts) * len(d) // parts]))
        return pd.DataFrame([(*key, *out)], columns=["label", "z", "r"])

    found = some.groupBy("label").applyInPandas(cuts, f"label {kind}, z array<long>, r array<long>")
    edges = {r["label"]: (np.array(r["z"]), np.array(r["r"])) for r in found.collect()}  # labels of over a range of pairs only
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)

    blocks = F.greatest(F.lit(1), F.ceil(F.col("_n") / block)).cast("int")
    packed = ["_n", "_a", "_b", "_x", "_y", "_w"]
    blob = "_n int, _a long, _b long, _x binary, _y binary, _w binary"

    def pairs(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        label, i, j = key
        x = y = np.zeros(0, np.int64)
        if len(left) and len(right):
            x, y = (distances(N.stacked(left[c]), N.stacked(right[c])).ravel() for c in ("z", "reference"))
            if i == j:
                once = (left["id"].to_numpy()[:, None] < right["id"].to_numpy()[None, :]).ravel()
                x, y = x[once], y[once]
        out = [(label, *f) for f in _parted(x, y, None, edges.get(label, none)[0])] if len(x) else []
        return pd.DataFrame(out, columns=["label", "_p", *packed])

    def first(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        label, p = key
        s, order = _ordered(_unpacked(frame["_x"], frame["_n"], frame["_a"]))
        w, y = _weights(frame), _unpacked(frame["_y"], frame["_n"], frame["_b"])[order]
        w = None if w is None else w[order]
        out = [(label, p, *f) for f in _parted(y, _places(s, w), w, edges.get(label, none)[1])]
        return pd.DataFrame(out, columns=["label", "_p", "_q", *packed])

    def second(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        label, q = key
        s, order = _ordered(_unpacked(frame["_x"], frame["_n"], frame["_a"]))
        u, w = _unpacked(frame["_y"], frame["_n"], frame["_b"]) / 2, _weights(frame)
        v = np.empty(len(s))
        v[order] = _places(s, None if w is None else w[order]) / 2
        begin = np.r_[0, np.cumsum(frame["_n"].to_numpy())[:-1]]
        w = np.ones(len(s)) if w is None else w.astype(np.float64)
        sums = {"n": w, "u": w * u, "v": w * v, "uv": w * u * v, "uu": w * u * u, "vv": w * v * v}
        out = pd.DataFrame({c: np.add.reduceat(x, begin) for c, x in sums.items()})
        return out.assign(label=label, _p=frame["_p"].to_numpy(), _q=q)[["label", "_p", "_q", *sums]]

    def ranked(some: DataFrame) -> DataFrame:
        """label, _p, _q and sums over the pairs of a cell, a range of either side; the pairs of ``some`` points with their label's ``_n``."""
        dealt = some.withColumn("_m", blocks).withColumn("_i", F.pmod(F.xxhash64("id"), F.col("_m")).cast("int"))
        a = dealt.withColumn("_j", F.explode(F.sequence(F.col("_i"), F.col("_m") - 1))).select("label", "_i", "_j", "id", "z", "reference")
        b = dealt.withColumnRenamed("_i", "_j").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_j"))))
        b = b.select(*[F.col(c).alias(c) for c in ("label", "_i", "_j", "id", "z", "reference")])
        keys = ["label", "_i", "_j"]
        made = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(pairs, f"label {kind}, _p int, {blob}")
        made = made.groupBy("label", "_p").applyInPandas(first, f"label {kind}, _p int, _q int, {blob}")
        return made.groupBy("label", "_q").applyInPandas(second, f"label {kind}, _p int, _q int, n double, u double, v double, uv double, uu double, vv double")

    sized = rows.join(sizes.where("_n >= 2"), "label")
    with _cleaned(points.sparkSession):
        cells = reduce(DataFrame.unionAll, [cut(ranked(sized.where(which))) for which in _rounds(sizes, list(edges))])
    # its pairs' ranks are their places, the pairs before the range, less the mean rank
    cells = cells.groupBy("label", "_p", "_q").agg(*[F.sum(c).alias(c) for c in ("n", "u", "v", "uv", "uu", "vv")])
    for c, p in (("_a", "_p"), ("_b", "_q")):
        cells = cells.join(F.broadcast(_before(cells, p, c)), ["label", p])
    n, u, v, at, bt = (F.col(c) for c in ("n", "u", "v", "_a", "_b"))
    return cells.groupBy("label").agg(
        F.sum("n").cast("long").alias("n_pairs"),
        (F.sum(F.col("uv") + bt * u + at * v + at * bt * n) / F.nullif(
            F.sqrt(F.sum(F.col("uu") + 2 * at * u + at * at * n)) * F.sqrt(F.sum(F.col("vv") + 2 * bt * v + bt * bt * n)), F.lit(0.0))).alias("rho"),
    )


def _rounds(sizes: DataFrame, large: list) -> list[Column]:
    """Conditions on ``label`` that take every label once: those of over a range one by one until ``AT_ONCE`` is full, the others by their hash."""
    pairs = F.col("_n") * (F.col("_n") - 1) / 2
    is_large = F.col("label").isin(large) if large else F.lit(False)
    rounds, held = [], 0
    for r in sizes.where(is_large).select("label", pairs.alias("n")).orderBy(F.desc("n"), "label").collect():
        if not rounds or held + r["n"] > AT_ONCE:
            rounds.append([])
            held = 0
        rounds[-1].append(r["label"])
        held += r["n"]
    rest = sizes.where(~is_large).agg(F.sum(pairs)).first()[0]
    parts = max(1, -(-int(rest or 0) // AT_ONCE))
    small = [~is_large & (F.pmod(F.xxhash64("label"), F.lit(parts)) == k) for k in range(parts)] if rest or not rounds else []
    return [F.col("label").isin(names) for names in rounds] + small


def _before(cells: DataFrame, part: str, name: str) -> DataFrame:
    """label, ``part`` and ``name``: how many pairs of the label lie in the ranges before, less the mean rank of all."""
    each = cells.groupBy("label", part).agg(F.sum("n").alias("_c"))
    before = F.sum("_c").over(W.partitionBy("label").orderBy(part).rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")
    return each.select("label", part, (before - (F.sum("_c").over(W.partitionBy("label")) + 1) / 2).alias(name))
