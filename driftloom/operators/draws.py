"""Draws of a whole group at once: its bouts as a matrix, its draws as rows of weights, and their product.

A bout is one row with its moments as arrays. A group's draws are shared out to some tasks, as many as
the work of all groups needs; each of them gets the group's bouts once, packed into a few rows, and
passes on a row per draw (or, of a resample, the draw's means). The choices are those of :mod:`resampling`, hash by hash: one digest for
a bout and one for a draw, mixed over whole arrays. A group
of over ``NUMBERS`` numbers is not put into one task: it goes the relational way there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from driftloom.functions.lineage import cut
from driftloom.functions.scalars import FACTOR, SHIFT, lane

#: Bouts times dimensions of a group that a task holds, at most.
NUMBERS = 16_000_000
#: Tasks that share the draws of a group, at most, and choices that are too few to share; shares of the work of all groups, about.
CHUNKS, SHARE, TASKS = 64, 5_000_000, 256
#: Bytes of bouts that are packed at once.
PACKED = 32 << 20
#: Weights that are held at once.
BLOCK = 2_000_000

Work = Callable[["Group", range], dict[str, list]]


class Group:
    """The bouts of one group in order: the numbers that their choices are hashed from, and their moments."""

    def __init__(self, pieces: pa.Table, values: Sequence[str]):
        columns = {c: pieces.column(c).combine_chunks().flatten() for c in pieces.column_names if c not in ("_key", *values)}
        order = pc.sort_indices(columns["bout"])
        self.rows = pa.table({c: v.take(order) for c, v in columns.items()})
        self.n, place = len(order), order.to_numpy()
        self.lanes = tuple(self.rows.column(c).to_numpy().astype(np.uint32) for c in ("_a", "_b"))
        self.key = pieces.column("_key")[0].as_py()
        for v in values:
            flat = pieces.column(v).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            setattr(self, v, flat.reshape(self.n, -1)[place])

    def ranks(self, draws: range, seed: int) -> np.ndarray:
        """For each draw, the place of each bout in the order of its hashes."""
        high, low = (mixed(x, d) for x, d in zip(self.lanes, of_draws(draws, seed)))
        order = np.argsort(high.astype(np.uint64) << np.uint64(32) | low, axis=1, kind="stable")
        out = np.empty_like(order)
        np.put_along_axis(out, order, np.broadcast_to(np.arange(self.n), order.shape), axis=1)
        return out

    def times(self, draws: range, seed: int) -> np.ndarray:
        """For each draw with replacement, how often each bout was drawn."""
        if not hasattr(self, "slots"):
            head, step = f"{self.key}:" if self.key else "", 1 << 16
            self.slots = np.concatenate([lanes([f"{head}{i}" for i in range(at, min(at + step, self.n))])[0] for at in range(0, self.n, step)])
        first = mixed(self.slots, of_draws(draws, seed)[0]) % np.uint32(self.n)
        place = first + np.arange(len(draws))[:, None] * self.n
        return np.bincount(place.ravel(), minlength=len(draws) * self.n).reshape(len(draws), self.n).astype(np.float64)


def lanes(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The first and the second 32 bits of the names' digests."""
    found = np.frombuffer(b"".join([hashlib.md5(n.encode()).digest()[:8] for n in names]), ">u4").astype(np.uint32).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def of_draws(draws: Sequence[int], seed: int) -> tuple[np.ndarray, np.ndarray]:
    return lanes([f"{seed}:{d}" for d in draws])


def mixed(x: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """``scalars.mixed`` of every draw (a row) with every ``x`` (a column); 32-bit products wrap around."""
    z = x[None, :] ^ draw[:, None]
    for _ in range(2):
        z ^= z >> np.uint32(SHIFT)
        z *= np.uint32(FACTOR)
    z ^= z >> np.uint32(SHIFT)
    return z


def packed(rows: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per bout, its ``values`` as arrays in the order of dimensions."""
    entries = F.sort_array(F.collect_list(F.struct("dim", *values)))
    arrays = rows.groupBy(*by, "bout").agg(entries.alias("_e"))
    return arrays.select(*by, "bout", *[F.col("_e")[v].alias(v) for v in values])


def by_size(rows: DataFrame, by: Sequence[str], values: Sequence[str], grouped: Callable[[DataFrame], DataFrame], relational: Callable[[DataFrame], DataFrame], bouts: DataFrame | None = None) -> DataFrame:
    """``grouped`` of the packed ``bouts`` of all groups of up to NUMBERS numbers, and ``relational`` of the rows of larger ones."""
    bouts = cut(packed(rows, by, values) if bouts is None else bouts)
    if not by:
        size = bouts.agg(F.sum(F.size(values[0]))).first()[0] or 0
        return grouped(bouts) if size <= NUMBERS else relational(rows)
    large = bouts.groupBy(*by).agg(F.sum(F.size(values[0])).alias("_size")).where(F.col("_size") > NUMBERS).select(*by)
    if not large.take(1):
        return grouped(bouts)
    large = cut(large)
    return grouped(bouts.join(large, list(by), "left_anti")).unionByName(relational(rows.join(large, list(by), "left_semi")))


def in_pieces(bouts: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """by and the other columns as arrays: the bouts that a task has of a group in one row, ``values`` as one flat array."""
    rest = [c for c in bouts.columns if c not in by]
    kinds = {c: bouts.schema[c].dataType.simpleString() for c in bouts.columns}
    fields = [*(f"`{c}` {kinds[c]}" for c in by), *(f"`{c}` {kinds[c] if c in values else f'array<{kinds[c]}>'}" for c in rest)]
    struct = StructType.fromDDL(", ".join(fields))
    schema = to_arrow_schema(struct)

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        order, begins = np.arange(len(table)), np.array([0])
        if by:
            codes = [table.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for c in by]
            order = np.lexsort(codes)
            begins = np.flatnonzero(np.r_[True, np.any([c[order][1:] != c[order][:-1] for c in codes], axis=0)])
        table, ends = table.take(pa.array(order)), np.r_[begins, len(order)]
        columns = [table.column(c).combine_chunks().take(pa.array(begins)) for c in by]
        for c in rest:
            column, at = table.column(c).combine_chunks(), ends
            if c in values:
                at, column = np.r_[0, np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))][ends], column.flatten()
            columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), column))
        return pa.Table.from_arrays(columns, names=[*by, *rest]).cast(schema).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held += [batch] if len(batch) else []
            if sum(b.nbytes for b in held) > PACKED:
                yield pack(held)
                held = []
        if held:
            yield pack(held)

    return bouts.select(*by, *rest).mapInArrow(run, struct)


def in_groups(bouts: DataFrame, by: Sequence[str], values: Sequence[str], n_draws: int, work: Work, fields: str) -> DataFrame:
    """by and ``fields``: what ``work`` makes of each group and each of its shares of the draws 1 to ``n_draws``."""
    sizes = bouts.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_n")
    total = (sizes.agg(F.sum("_n")).first()[0] or 0) * n_draws
    share = max(SHARE, -(-total // TASKS))  # a group is sent to no more tasks than all groups together need
    chunks = F.least(F.lit(min(CHUNKS, n_draws)), F.ceil(F.col("_n") * n_draws / share)).cast("int")
    text = [F.col(c).cast("string") for c in by]
    digest = F.md5(F.concat_ws(":", *text, F.col("bout").cast("string")).cast("binary"))
    rows = in_pieces(bouts.withColumns({"_a": lane(digest, 0), "_b": lane(digest, 1)}), by, values)
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    rows = rows.join(F.broadcast(sizes.withColumn("_chunks", chunks)), same)  # one row for each group
    rows = rows.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).withColumn("_key", F.concat_ws(":", *text))
    rows = rows.drop("_n", *(f"_by{i}" for i in range(len(by))))
    if total > SHARE * int(bouts.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(-(-total // share), *by, "_chunk")
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in by]
    names = [f.split()[0] for f in fields.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        chunk, chunks = table.column("_chunk")[0].as_py(), table.column("_chunks")[0].as_py()
        group = Group(table.drop_columns([*by, "_chunk", "_chunks"]), values)
        draws = range(1 + n_draws * chunk // chunks, 1 + n_draws * (chunk + 1) // chunks)
        found: dict[str, list] = {n: [] for n in names}
        step = max(1, BLOCK // max(1, group.n))
        for first in range(0, len(draws), step):
            part = work(group, draws[first : first + step])
            for n in names:
                found[n] += list(part[n])
        zero = pa.array(np.zeros(len(found[names[0]]), np.int64))
        return pa.table([*(table.column(c).take(zero) for c in by), *(pa.array(found[n]) for n in names)], names=[*by, *names]).cast(schema)

    struct = StructType.fromDDL(", ".join([*kinds, fields]))
    schema = to_arrow_schema(struct)
    return rows.groupBy(*by, "_chunk").applyInArrow(run, struct)


def sides(group: Group, draws: range, seed: int, n_bouts: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Weights (0 or 1) of the two sides: halves, or ``n_bouts`` each."""
    rank = group.ranks(draws, seed)
    k = n_bouts or group.n // 2
    left = rank < k
    right = (rank < 2 * k) & ~left if n_bouts else ~left
    return left.astype(np.float64), right.astype(np.float64)


def mean_and_noise(w: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, the means by dimension, and the sum over dimensions of variance / n, for each row of weights."""
    n = w.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mu = w @ m / n[:, None]
        v = (w @ (m * m) - n[:, None] * mu * mu) / (n - 1)[:, None]
        return n, mu, (v / n[:, None]).sum(axis=1)


def total_variances(w: np.ndarray, group: Group) -> np.ndarray:
    """The renditions' total variance for each row of weights; not a number where there are fewer than two."""
    n, sx, sxx = w @ group.n_rows[:, :1], w @ group.sx, w @ group.sxx
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.maximum((sxx - sx * sx / n) / (n - 1), 0.0)
    return np.where(n[:, 0] > 1, v.sum(axis=1), np.nan)


def gaps(group: Group, draws: range, seed: int, n_bouts: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which draws count, their unbiased distance and their gap by dimension."""
    m = group.m - group.m.mean(axis=0)
    left, right = sides(group, draws, seed, n_bouts)
    (nl, ml, el), (nr, mr, er) = mean_and_noise(left, m), mean_and_noise(right, m)
    gap = ml - mr
    return (nl >= 2) & (nr >= 2), (gap * gap).sum(axis=1) - el - er, gap


def _kept(draws: range, good: np.ndarray) -> list[int]:
    return (np.array(draws)[good]).tolist()


def centroid(bouts: DataFrame, by: Sequence[str], n_draws: int, seed: int, fewest: int, n_bouts: int | None = None) -> DataFrame:
    """by, draw, drift of halves, or of two sides of ``n_bouts``, of groups of ``fewest`` bouts or more."""

    def work(group: Group, draws: range) -> dict[str, list]:
        if group.n < fewest:
            return {"draw": [], "drift": []}
        good, drift, _ = gaps(group, draws, seed, n_bouts)
        return {"draw": _kept(draws, good), "drift": drift[good].tolist()}

    return in_groups(bouts, by, ["m"], n_draws, work, "draw int, drift double")


def dispersion(bouts: DataFrame, by: Sequence[str], n_draws: int, seed: int, fewest: int, n_bouts: int | None = None) -> DataFrame:
    """by, draw, log_ratio (right side over left) of the same draws."""

    def work(group: Group, draws: range) -> dict[str, list]:
        if group.n < fewest:
            return {"draw": [], "log_ratio": []}
        left, right = (total_variances(w, group) for w in sides(group, draws, seed, n_bouts))
        good = (left > 0) & (right > 0)
        return {"draw": _kept(draws, good), "log_ratio": np.log(right[good] / left[good]).tolist()}

    return in_groups(bouts, by, ["n_rows", "sx", "sxx"], n_draws, work, "draw int, log_ratio double")


def normals(key: str, width: int, draws: Sequence[int], seed: int) -> np.ndarray:
    """For each draw, a normal number by dimension."""
    named = lanes([":".join([*([key] if key else []), "direction", str(i)]) for i in range(width)])
    u1, u2 = (mixed(x, d).astype(np.float64) for x, d in zip(named, of_draws(draws, seed)))
    return np.sqrt(-2 * np.log((u1 + 1) / 2**32)) * np.cos(2 * np.pi * u2 / 2**32)


def directed(bouts: DataFrame, by: Sequence[str], n_draws: int, seed: int, n_bouts: int) -> DataFrame:
    """by, draw, drift, along: the gap of two sides of ``n_bouts`` along a random unit vector as well."""

    def work(group: Group, draws: range) -> dict[str, list]:
        if group.n < 2 * n_bouts:
            return {"draw": [], "drift": [], "along": []}
        good, drift, gap = gaps(group, draws, seed, n_bouts)
        u = normals(group.key, group.m.shape[1], draws, seed)
        along = (gap * u).sum(axis=1) / np.sqrt((u * u).sum(axis=1))
        return {"draw": _kept(draws, good), "drift": drift[good].tolist(), "along": along[good].tolist()}

    return in_groups(bouts, by, ["m"], n_draws, work, "draw int, drift double, along double")


def common_sides(units: DataFrame, n_bouts: int, n_draws: int, seed: int) -> DataFrame:
    """draw, left, right: two disjoint sets of ``n_bouts`` of all ``units`` (bout), as arrays; no row with fewer units."""
    kind = dict(units.dtypes)["bout"]

    def work(group: Group, draws: range) -> dict[str, list]:
        if group.n < 2 * n_bouts:
            return {"draw": [], "left": [], "right": []}
        names, place = np.array(group.rows.column("bout").to_pylist(), object), np.argsort(group.ranks(draws, seed), axis=1)
        left, right = place[:, :n_bouts], place[:, n_bouts : 2 * n_bouts]
        return {"draw": list(draws), "left": names[left].tolist(), "right": names[right].tolist()}

    return in_groups(units, [], [], n_draws, work, f"draw int, left array<{kind}>, right array<{kind}>")


def common_directed(means: DataFrame, sides: list[tuple], seed: int) -> DataFrame:
    """label, draw, drift, along of ``sides`` (draw, left, right) that are the same for all labels, each with the bouts it has.

    ``means`` has label, bout, dim, m. Only bouts of the sides are looked at, so a label's matrix is no
    larger than all draws of both sides.
    """
    draws = [d for d, _, _ in sides]
    kind = dict(means.dtypes)["bout"]
    drawn = means.sparkSession.createDataFrame([(b,) for b in {b for _, x, y in sides for b in (*x, *y)}], f"bout {kind}")
    rows = packed(means.join(F.broadcast(drawn), "bout", "left_semi"), ["label"], ["m"])

    def run(table: pa.Table) -> pa.Table:
        m = table.column("m").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        m = m - m.mean(axis=0)
        place = {b: i for i, b in enumerate(table.column("bout").to_pylist())}
        w = np.zeros((2, len(draws), len(table)))
        for i, (_, *both) in enumerate(sides):
            for k, own in enumerate(both):
                w[k, i, [place[b] for b in own if b in place]] = 1
        (nl, ml, el), (nr, mr, er) = (mean_and_noise(x, m) for x in w)
        good, gap = (nl >= 2) & (nr >= 2), ml - mr
        u = normals("", m.shape[1], draws, seed)
        drift, along = (gap * gap).sum(axis=1) - el - er, (gap * u).sum(axis=1) / np.sqrt((u * u).sum(axis=1))
        label = table.column("label").take(pa.array(np.zeros(int(good.sum()), np.int64)))
        columns = [label, pa.array(np.array(draws, np.int32)[good]), pa.array(drift[good]), pa.array(along[good])]
        return pa.table(columns, names=["label", "draw", "drift", "along"])

    return rows.groupBy("label").applyInArrow(run, f"label {dict(means.dtypes)['label']}, draw int, drift double, along double")


def resampled_means(bouts: DataFrame, by: Sequence[str], n_draws: int, seed: int, collapse: bool) -> DataFrame:
    """by, first, n, mu, noise: arrays over the draws from ``first`` on, of the bouts drawn with replacement."""

    def work(group: Group, draws: range) -> dict[str, list]:
        w, centre = group.times(draws, seed), group.m.mean(axis=0)
        n, mu, noise = mean_and_noise((w > 0).astype(np.float64) if collapse else w, group.m - centre)
        return {"first": [draws[0]], "n": [n.tolist()], "mu": [(mu + centre).tolist()], "noise": [noise.tolist()]}

    return in_groups(bouts, by, ["m"], n_draws, work, "first int, n array<double>, mu array<array<double>>, noise array<double>")


def resampled_variances(bouts: DataFrame, by: Sequence[str], n_draws: int, seed: int) -> DataFrame:
    """by, first, tv: the renditions' total variance of the draws from ``first`` on, bouts drawn twice counting twice."""

    def work(group: Group, draws: range) -> dict[str, list]:
        return {"first": [draws[0]], "tv": [total_variances(group.times(draws, seed), group).tolist()]}

    return in_groups(bouts, by, ["n_rows", "sx", "sxx"], n_draws, work, "first int, tv array<double>")


def divergences(bouts: DataFrame, by: Sequence[str], n_draws: int, seed: int, fewest: int) -> DataFrame:
    """by, draw, jsd of halves; ``bouts`` has the arrays pair (a name for first and second) and times."""

    def work(group: Group, draws: range) -> dict[str, list]:
        if group.n < fewest:
            return {"draw": [], "jsd": []}
        pair, times = (group.rows.column(c).combine_chunks() for c in ("pair", "times"))
        row = np.repeat(np.arange(group.n), np.diff(pair.offsets.to_numpy()))
        names, column = np.unique(np.array(pair.flatten().to_pylist(), object).astype(str), return_inverse=True)
        counts = np.zeros((group.n, len(names)))
        np.add.at(counts, (row, column), times.flatten().to_numpy())
        left, right = (w @ counts for w in sides(group, draws, seed, None))
        good = (left.sum(axis=1) > 0) & (right.sum(axis=1) > 0)
        p, q = (x[good] / x[good].sum(axis=1, keepdims=True) for x in (left, right))
        m = (p + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            parts = [np.where(x > 0, x * np.log2(x / m), 0.0).sum(axis=1) for x in (p, q)]
        return {"draw": _kept(draws, good), "jsd": np.maximum((parts[0] + parts[1]) / 2, 0.0).tolist()}

    return in_groups(bouts, by, [], n_draws, work, "draw int, jsd double")


def ends(drawn: DataFrame, pairs: DataFrame, by: Sequence[str], side: str, values: Sequence[str], what: Callable[[dict, dict], np.ndarray], alpha: float) -> DataFrame:
    """by, both sides, low, high: the percentile interval of ``what`` of each draw of every pair of sides.

    A group's sides are held once, as arrays of draws, and its pairs are worked through one after the
    other; only their ends leave the task. ``what`` gets the values of the two sides and says which
    draws count by numbers. Pairs without a draw that counts have no row.
    """
    kinds = dict(pairs.dtypes)
    a, b = f"{side}_a", f"{side}_b"
    names = [*by, a, b]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "low double", "high double"])

    def run(shares: pa.Table, wanted: pa.Table) -> pa.Table:
        order = np.argsort(shares.column("first").to_numpy(), kind="stable")
        parts: dict = {}
        columns = [shares.column(v).to_pylist() for v in values]
        for i, s in zip(order, shares.column(side).take(pa.array(order)).to_pylist()):
            parts.setdefault(s, []).append([np.array(c[i], np.float64) for c in columns])
        held = {s: {v: np.concatenate([p[k] for p in own]) for k, v in enumerate(values)} for s, own in parts.items()}
        rows, low, high = [], [], []
        for i, (x, y) in enumerate(zip(wanted.column(a).to_pylist(), wanted.column(b).to_pylist())):
            if x in held and y in held:
                found = what(held[x], held[y])
                found = np.sort(found[~np.isnan(found)])
                if len(found):
                    rows.append(i)
                    low.append(_at(found, alpha / 2))
                    high.append(_at(found, 1 - alpha / 2))
        kept = wanted.select(names).take(pa.array(rows, pa.int64()))
        return kept.append_column("low", pa.array(low, pa.float64())).append_column("high", pa.array(high, pa.float64()))

    one = [] if by else [F.lit(1).alias("_all")]
    keys = list(by) or ["_all"]
    left = drawn.select(*by, side, "first", *values, *one).groupBy(*keys)
    return left.cogroup(pairs.select(*names, *one).groupBy(*keys)).applyInArrow(run, schema)


def _at(x: np.ndarray, p: float) -> float:
    place = (len(x) - 1) * p
    low, high = x[int(np.floor(place))], x[int(np.ceil(place))]
    return float(low + (high - low) * (place - np.floor(place)))
