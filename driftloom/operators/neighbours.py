"""Exact nearest neighbours by Euclidean distance, without comparing all with all.

Vectors are dealt into cells, each round the nearest of some pivots, with the cell's radius. By the
triangle inequality nothing in a cell is nearer to a query than the pivot's distance less the radius,
so a query visits its cells in the order of that bound, twice as many each round, until the bound of
the next one is over the distance of its kth neighbour so far. Cells of any size are cut into blocks,
and so are the queries that visit a block; a task compares a block's queries with its vectors.
Where the bounds exclude little (vectors without clusters, in many dimensions), the queries left after
a round are compared with all vectors, wide block against wide block, tile by tile: also exact, and a
vector is then sent to as many tasks as there are wide blocks, not cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.functions.lineage import cut

#: Vectors of a block; of a cell, about; pivots at most, as every task holds them.
BLOCK, CELL, PIVOTS = 2048, 512, 1024
#: Rows of a block of which each meets all blocks of the other side; of a tile of distances.
WIDE, TILE = 32_768, 1024
#: The share of the cells that a query may still have to visit, on average, before all are compared with all.
MOST = 1 / 16


def squared_distances(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Squared distances as |q|^2 + |t|^2 - 2 q.t, from the mean of ``t`` so that little cancels; no more than one product is held."""
    centre = t.mean(axis=0)
    q, t = q - centre, t - centre
    left = np.column_stack([-2 * q, (q * q).sum(axis=1), np.ones(len(q))])
    out = left @ np.column_stack([t, np.ones(len(t)), (t * t).sum(axis=1)]).T
    return np.maximum(out, 0.0, out=out)


def stacked(z: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in z])


def best(a: pd.DataFrame, b: pd.DataFrame, d: np.ndarray, k: int) -> pd.DataFrame:
    """id, other, other_label, d2: the ``k`` nearest of ``b`` for each of ``a``, other than itself, ties to the smaller id."""
    ids, labels, own = b["id"].to_numpy(), b["label"].to_numpy(), a["id"].to_numpy()
    d = np.round(d, 9)
    d[own[:, None] == ids[None, :]] = np.inf
    m = min(k, len(ids))
    last = np.partition(d, m - 1, axis=1)[:, m - 1]
    row, column = np.nonzero((d <= last[:, None]) & (d < np.inf))  # ties of the last place as well
    order = np.lexsort((ids[column], d[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, column = row[place < k], column[place < k]
    return pd.DataFrame({"id": own[row], "other": ids[column], "other_label": labels[column], "d2": d[row, column]})


def dealt_blocks(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` with its block: of ``WIDE`` rows in large tables, as each is sent to all of the other side's; six blocks or more where there are rows enough."""
    rows = df.count()
    n = max(1, -(-rows // WIDE), min(-(-rows // BLOCK), 6))
    return df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n


def against(queries: DataFrame, train: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on each block of ``queries`` with each block of ``train``."""
    q, n_q = dealt_blocks(queries, "_q")
    t, n_t = dealt_blocks(train, "_t")
    q = q.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(n_t - 1))))
    q = q.select(*[F.col(c).alias(c) for c in q.columns])  # columns of its own, also where both come from one table
    t = t.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        return work(a, b)

    return q.groupBy("_q", "_t").cogroup(t.groupBy("_q", "_t")).applyInPandas(run, schema)


def tiles(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Rows of ``a``, rows of ``b`` and their squared distances, a tile at a time; all of ``b`` for some rows of ``a``, then the next rows."""
    q, t = stacked(a["z"]), stacked(b["z"])
    for i in range(0, len(q), TILE):
        for j in range(0, len(t), TILE):
            yield slice(i, i + TILE), slice(j, j + TILE), squared_distances(q[i : i + TILE], t[j : j + TILE])


def best_of_tiles(a: pd.DataFrame, b: pd.DataFrame, k: int) -> pd.DataFrame:
    """The same as ``best``, of blocks of any size; a tile's distances beyond the ``k`` nearest so far are only compared."""
    ids, labels, own = b["id"].to_numpy(), b["label"].to_numpy(), a["id"].to_numpy()
    shared = np.isin(own, ids)
    held: list[np.ndarray] = []
    out = []

    def nearest_held() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, column, d = (np.concatenate(v) for v in zip(*held))
        order = np.lexsort((ids[column], d, row))
        row, column, d = row[order], column[order], d[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        return row[place < k], column[place < k], d[place < k]

    for at, to, d in tiles(a, b):
        if to.start == 0:
            held, bound = [], np.full(len(d), np.inf)
        if shared[at].any():
            d[own[at][:, None] == ids[to][None, :]] = np.inf
        limit = bound
        if np.isinf(bound).any():
            m = min(k, d.shape[1])
            limit = np.minimum(bound, np.partition(d, m - 1, axis=1)[:, m - 1])
        row, column = np.nonzero(d <= (limit + 2e-9)[:, None])  # before rounding, with all that may be equal after it
        found = d[row, column]
        kept = np.isfinite(found)
        held.append((row[kept], column[kept] + to.start, np.round(found[kept], 9)))
        held = [nearest_held()]
        row, _, found = held[0]
        full = np.flatnonzero(np.bincount(row, minlength=len(d)) >= k)
        bound[full] = found[np.searchsorted(row, full, side="right") - 1]
        if to.stop >= len(b):
            row, column, found = held[0]
            out.append(pd.DataFrame({"id": own[at][row], "other": ids[column], "other_label": labels[column], "d2": found}))
    return pd.concat(out)


def _dealt(train: DataFrame, pivots: np.ndarray) -> DataFrame:
    """id, label, z, cell (the nearest pivot) and its distance."""
    kinds = dict(train.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                d = squared_distances(stacked(frame["z"]), pivots)
                cell = d.argmin(axis=1)
                yield frame.assign(cell=cell.astype(np.int32), far=np.sqrt(d[np.arange(len(d)), cell]))

    return train.select("id", "label", "z").mapInPandas(run, f"id {kinds['id']}, label {kinds['label']}, z array<double>, cell int, far double")


def _visits(state: DataFrame, pivots: np.ndarray, radius: np.ndarray, blocks: np.ndarray, width: int) -> DataFrame:
    """id, z, kth, at, cell, block: the next ``width`` cells of each query of ``state`` (id, z, kth, at), as far as their bounds allow."""
    kinds = dict(state.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for begin in range(0, len(frame), BLOCK):
                part = frame.iloc[begin : begin + BLOCK]
                d = np.sqrt(squared_distances(stacked(part["z"]), pivots))
                # a little less than the bound, so that rounding never leaves out a neighbour
                bound = np.maximum(d - radius, 0.0) * (1 - 1e-7) - 1e-6
                order = np.lexsort((d, bound), axis=1)
                for i, (name, z, kth, at) in enumerate(zip(part["id"], part["z"], part["kth"], part["at"])):
                    cells = order[i, at : at + width]
                    cells = cells[bound[i, cells] <= np.sqrt(kth)]
                    out += [(name, z, kth, at + width, int(c), b) for c in cells for b in range(blocks[c])]
            yield pd.DataFrame(out, columns=["id", "z", "kth", "at", "cell", "block"])

    return state.mapInPandas(run, f"id {kinds['id']}, z array<double>, kth double, at int, cell int, block int")


def nearest(queries: DataFrame, train: DataFrame, k: int, cell: int = CELL, counted: list | None = None) -> DataFrame:
    """id, other, other_label, d2, rank: the ``k`` nearest rows of ``train`` for each of ``queries``, other than itself, ties to the smaller id.

    Both have id, label and z. ``counted`` gets the number of distances that each round works out, at
    the cost of a job for each.
    """
    train = cut(train.select("id", "label", "z"))
    wanted = int(min(PIVOTS, max(1, train.count() // cell)))
    chosen = train.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    if not chosen:
        return train.selectExpr("id", "id as other", "label as other_label", "0d as d2", "0 as rank").limit(0)
    pivots = np.unique(np.array([r["z"] for r in chosen], np.float64), axis=0)
    dealt = cut(_dealt(train, pivots))
    sizes = {r["cell"]: (r["n"], r["far"]) for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    radius = np.array([sizes.get(c, (0, 0.0))[1] for c in range(len(pivots))])
    blocks = np.array([-(-sizes.get(c, (0, 0.0))[0] // BLOCK) for c in range(len(pivots))])
    many = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("cell") + 1)
    held = cut(dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), many)).cast("int")).drop("far"))
    kinds = dict(train.dtypes)
    schema = f"id {kinds['id']}, other {kinds['id']}, other_label {kinds['label']}, d2 double"

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=["id", "other", "other_label", "d2"])
        return best_of_tiles(a, b, k)

    state = cut(queries.select("id", "z").withColumns({"kth": F.lit(float("inf")), "at": F.lit(0)}))
    rank = F.row_number().over(W.partitionBy("id").orderBy("d2", "other"))
    out, width = None, 1
    while True:
        visits = _visits(state, pivots, radius, blocks, width)
        if counted is not None:
            per_block = held.groupBy("cell", "block").agg(F.count(F.lit(1)).alias("n"))
            counted.append(visits.join(per_block, ["cell", "block"]).agg(F.sum("n")).first()[0] or 0)
        # a block's queries in parts, so that a task holds a bounded number of them
        many = visits.groupBy("cell", "block").agg(F.ceil(F.count(F.lit(1)) / WIDE).cast("int").alias("_parts"))
        many = F.broadcast(cut(many))
        asked = visits.join(many, ["cell", "block"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).drop("_parts")
        told = held.join(many, ["cell", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        keys = ["cell", "block", "part"]
        found = asked.groupBy(*keys).cogroup(told.groupBy(*keys)).applyInPandas(compare, schema)
        found = found if out is None else found.unionByName(out)
        out = cut(found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"))
        kth = out.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.max("d2")).alias("_d2"))
        at = state.select("id", "z", (F.col("at") + width).alias("at"))
        state = cut(at.join(kth, "id", "left").select("id", "z", F.coalesce("_d2", F.lit(float("inf"))).alias("kth"), "at").where(F.col("at") < len(pivots)))
        state = _unfinished(state, pivots, radius)
        left, cells = state.agg(F.count(F.lit(1)), F.sum("cells")).first()
        if not left:
            return out.withColumn("rank", rank)
        state = state.drop("cells")
        if cells > MOST * len(pivots) * left:
            rest = against(state.select("id", "z"), train, lambda a, b: best_of_tiles(a, b, k), schema)
            done = out.join(state.select("id"), "id", "left_anti")
            return done.unionByName(rest.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")).withColumn("rank", rank)
        width *= 2


def _unfinished(state: DataFrame, pivots: np.ndarray, radius: np.ndarray) -> DataFrame:
    """The queries whose next cell may have a nearer neighbour, with the number of cells that may."""
    kinds = dict(state.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                d = np.sqrt(squared_distances(stacked(frame["z"]), pivots))
                bound = np.maximum(d - radius, 0.0) * (1 - 1e-7) - 1e-6
                within = (bound <= np.sqrt(frame["kth"].to_numpy())[:, None]).sum(axis=1) - frame["at"].to_numpy()
                yield frame.assign(cells=within)[within > 0]

    return cut(state.mapInPandas(run, f"id {kinds['id']}, z array<double>, kth double, at int, cells long"))
