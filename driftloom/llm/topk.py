"""Exact top-k inner-product search: branch and bound over ball trees.

A top tree, built from a bounded sample, deals all vectors into cells; each cell's ball (its centre
and the exact largest distance of its vectors from it) bounds the inner products that a query can
find in it: q . centre + |q| radius. A query visits cells in the order of these bounds, in rounds: the
first cell, then four, sixteen and so on. After each round the kth score so far is its floor, and it
is only sent to cells whose bounds reach that, so a round without any is the last. A cell of more
than some 4,096 vectors is several shards, dealt by a hash, and each shard has a ball tree of its own.
A block of queries walks it together: a node is entered by the queries whose bound is not below their
kth score so far, the child with the larger bounds first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.llm.common import checkpoint, table

K = 10
SCALE = 1024
SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 4096, 2048, 64
#: Cells of the top tree at most, and the sampled vectors for each that it is built from.
CELLS, SAMPLE = 1024, 16
#: A round's cells, as a multiple of those of the one before.
WIDER = 4
LOWEST = 1 - 2**63


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, v: the components as floor(scale * x). Null vectors, ids and components, and those that are not finite, take no part."""
    good = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and abs(cast(x as double)) < double('infinity'))"
    value = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    return vectors.where(good).select("vec_id", value.alias("v"))


def _parting(part: np.ndarray) -> np.ndarray:
    """The direction from a vector far from the centre to the one farthest from it."""
    one = part[int(((part - part.mean(axis=0)) ** 2).sum(axis=1).argmax())]
    return part[int(((part - one) ** 2).sum(axis=1).argmax())] - one


class Cells:
    """The top tree for vectors of one length: each inner node sends a vector to one side of a plane, each leaf is a cell."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.planes: list[tuple[np.ndarray, float, int, int]] = []
        self.centres: list[np.ndarray] = []
        self.root = self._build(sample, cells)

    def _build(self, part: np.ndarray, cells: int) -> int:
        if cells > 1 and len(part) > 1:
            towards = _parting(part)
            side = part @ towards
            middle = float(np.median(side))
            if (side > middle).any():
                at = len(self.planes)
                self.planes.append((towards, middle, 0, 0))
                left = self._build(part[side <= middle], cells // 2)
                right = self._build(part[side > middle], cells - cells // 2)
                self.planes[at] = (towards, middle, left, right)
                return at
        self.centres.append(part.mean(axis=0))
        return -len(self.centres)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        out = np.zeros(len(x), np.int64)

        def send(node: int, rows: np.ndarray) -> None:
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                towards, middle, left, right = self.planes[node]
                above = x[rows] @ towards > middle
                send(left, rows[~above])
                send(right, rows[above])

        send(self.root, np.arange(len(x)))
        return out


def _upper(q: np.ndarray, norm: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """What no inner product in a ball is above, rounding allowed for; ``centre`` has a row for each ball."""
    top = q @ centre.T + norm[:, None] * radius
    return top + 1e-9 * (np.abs(top) + norm[:, None] * (radius + np.sqrt((centre**2).sum(axis=1)))) + 1


class Tree:
    """A ball tree over the rows of a matrix, split where the two farthest rows found lie apart."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.nodes: list[tuple[np.ndarray, float, np.ndarray | None, int, int]] = []
        self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray) -> int:
        part = self.x[rows]
        centre = part.mean(axis=0)
        away = np.sqrt(((part - centre) ** 2).sum(axis=1))
        at = len(self.nodes)
        self.nodes.append((centre, float(away.max()), rows, -1, -1))
        if len(rows) > LEAF_ROWS and away.max() > 0:
            order = np.argsort(part @ _parting(part), kind="stable")
            half = len(rows) // 2
            left = self._build(rows[order[:half]])
            right = self._build(rows[order[half:]])
            self.nodes[at] = (centre, float(away.max()), None, left, right)
        return at


class Best:
    """The k best (score, id) of each query so far, ties to the smaller id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.kth = floor.copy()
        self.held: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * queries

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.r_[self.held[q][0], scores], np.r_[self.held[q][1], ids]
        order = np.lexsort((ids, -scores))[: self.k]
        self.held[q] = scores[order], ids[order]
        if len(order) == self.k:
            self.kth[q] = max(self.floor[q], scores[order[-1]])


def search(rows: np.ndarray, ids: np.ndarray, x: np.ndarray, query_rows: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> Best:
    """The k best vectors of ``x`` for each query, none below its floor and not the query's own row."""
    best = Best(len(q), k, floor)
    largest = int(max(np.abs(x).max(), np.abs(q).max())) if x.size else 0
    exact = largest * largest * x.shape[1] < 2**53  # else in Python's whole numbers
    xf, qf = x.astype(np.float64), q.astype(np.float64)
    tree, norm = Tree(xf), np.sqrt((qf**2).sum(axis=1))

    def bound(node: int, of: np.ndarray) -> np.ndarray:
        centre, radius = tree.nodes[node][:2]
        return _upper(qf[of], norm[of], centre[None], np.array([radius]))[:, 0]

    def enter(node: int, of: np.ndarray) -> None:
        of = of[bound(node, of) >= best.kth[of]]
        if not len(of):
            return
        _, _, leaf, left, right = tree.nodes[node]
        if leaf is None:
            closer = [left, right] if bound(left, of).sum() >= bound(right, of).sum() else [right, left]
            for child in closer:
                enter(child, of)
            return
        if exact:
            scores = (qf[of] @ xf[leaf].T).astype(np.int64)
        else:
            products = q[of].astype(object) @ x[leaf].astype(object).T
            scores = np.clip(products, LOWEST, 2**63 - 1).astype(np.int64)
        hit = (scores >= best.kth[of][:, None]) & (rows[leaf][None, :] != query_rows[of][:, None])
        for i in np.flatnonzero(hit.any(axis=1)):
            best.add(int(of[i]), scores[i, hit[i]], ids[leaf[hit[i]]])

    if len(x):
        enter(0, np.arange(len(q)))
    return best


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1) if len(vectors) and len(flat) else np.zeros((len(vectors), 0), np.int64)


def _top_trees(rows: DataFrame, shard_rows: int) -> dict[int, Cells]:
    """A top tree for each length of vectors: as many cells as shards are needed, CELLS at most, from SAMPLE vectors for each."""
    trees = {}
    for dim, n in rows.groupBy("_dim").count().collect():  # a row for each length that vectors have
        cells = min(CELLS, -(-n // shard_rows))
        sample = rows.where(F.col("_dim") == dim).select("v", F.xxhash64("_row").alias("h")).orderBy("h").limit(cells * SAMPLE)
        trees[dim] = Cells(np.array([r["v"] for r in sample.collect()], np.float64).reshape(-1, dim) if dim else np.zeros((1, 0)), cells)
    return trees


def _dealt(rows: DataFrame, trees: dict[int, Cells]) -> DataFrame:
    """``rows`` with ``_cell`` and ``_away``, the distance from its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("_dim").to_numpy()
            cell, away = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            for dim in np.unique(dims):
                at, tree = np.flatnonzero(dims == dim), trees[int(dim)]
                x = _matrix(batch.column("v").take(pa.array(at))).astype(np.float64)
                cell[at] = tree.of(x)
                away[at] = np.sqrt(((x - np.array(tree.centres)[cell[at]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], [*batch.schema.names, "_cell", "_away"])

    return rows.mapInArrow(run, "vec_id long, v array<long>, _dim int, _row long, _cell long, _away double")


def _sent(queries: DataFrame, trees: dict[int, Cells], radii: dict[tuple[int, int], float], first: int, end: int) -> DataFrame:
    """The queries (vec_id, v, _dim, _row, floor), each for those cells that come ``first`` to ``end`` in the order of its bounds and reach its floor."""
    balls = {}
    for dim, tree in trees.items():
        cells = np.array(sorted(c for d, c in radii if d == dim), np.int64)
        balls[dim] = cells, np.array(tree.centres)[cells], np.array([radii[(dim, int(c))] for c in cells])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("_dim").to_numpy()
            floor = batch.column("floor").to_numpy()
            for dim in np.unique(dims):
                cells, centres, radius = balls[int(dim)]
                for at in np.array_split(np.flatnonzero(dims == dim), -(-len(dims) // 1024)):
                    if not len(at):
                        continue
                    q = _matrix(batch.column("v").take(pa.array(at))).astype(np.float64)
                    bound = _upper(q, np.sqrt((q**2).sum(axis=1)), centres, radius)
                    order = np.argsort(-bound, axis=1, kind="stable")[:, first:end]
                    i, j = np.nonzero(np.take_along_axis(bound, order, axis=1) >= floor[at][:, None])
                    kept = batch.take(pa.array(at[i]))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cells[order[i, j]])], [*kept.schema.names, "_cell"])

    return queries.mapInArrow(run, "vec_id long, v array<long>, _dim int, _row long, floor long, _cell long")


def _searched(held: DataFrame, sent: DataFrame, sizes: DataFrame, shard_rows: int, query_rows: int, k: int) -> DataFrame:
    """query_row, query_id, vec_id, score: per group of shard and query block, each query's best above its floor.

    ``sizes`` has a row for each cell: _dim, _cell, n.
    """
    names = ["query_row", "query_id", "vec_id", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        rows, ids, query_rows, query_ids = (t.column(c).to_numpy() for t in (left, right) for c in ("_row", "vec_id"))
        best = search(rows, ids, _matrix(left.column("v")), query_rows, _matrix(right.column("v")), right.column("floor").to_numpy(), k)
        n = [len(s) for s, _ in best.held]
        parts = np.repeat(query_rows, n), np.repeat(query_ids, n), np.concatenate([i for _, i in best.held]), np.concatenate([s for s, _ in best.held])
        return pa.table(dict(zip(names, map(pa.array, parts))))

    asked = sent.groupBy("_dim", "_cell").agg(F.count(F.lit(1)).alias("asked"))
    cells = sizes.join(asked, ["_dim", "_cell"]).select(  # CELLS rows for each length at most
        "_dim", "_cell", F.ceil(F.col("n") / shard_rows).cast("int").alias("_shards"),
        F.ceil(F.col("asked") / query_rows).cast("int").alias("_blocks"),
    )
    cells = F.broadcast(checkpoint(cells))
    by = ("_dim", "_cell", "_shard", "_block")
    vectors = held.join(cells, ["_dim", "_cell"]).select(
        "_dim", "_cell", F.pmod(F.xxhash64("_row"), F.col("_shards")).cast("int").alias("_shard"),
        F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), "_row", "vec_id", "v",
    )
    queries = sent.join(cells, ["_dim", "_cell"]).select(
        "_dim", "_cell", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)).alias("_shard"),
        F.pmod(F.xxhash64("_row"), F.col("_blocks")).cast("int").alias("_block"), "_row", "vec_id", "v", "floor",
    )
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # columns of its own
    pairs = vectors.groupBy(*by).cogroup(queries.groupBy(*by))
    return pairs.applyInArrow(run, ", ".join(f"{n} long" for n in names))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    scale: int = SCALE,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of each row for which ``is_query`` holds.

    Scores are inner products of the components' floor(scale * x), saturated to 64 bits; ties go to
    the smaller vec_id. Candidates of a query are all rows but its own; a query with fewer candidates
    returns them all. Rows stand for themselves: a row that repeats is as many candidates and as many
    queries, and of two rows with one id each is a candidate of the other. Vectors of different
    lengths do not meet. Rows without id, vector or with a component that is null or not finite take
    no part; an empty table gives an empty result; other columns are not read.
    """
    rows = whole_numbers(vectors, scale).withColumn("_dim", F.size("v")).withColumn("_row", F.monotonically_increasing_id())
    rows = checkpoint(rows)
    trees = _top_trees(rows, shard_rows)
    held = checkpoint(_dealt(rows, trees))
    sizes = checkpoint(held.groupBy("_dim", "_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_away").alias("radius")))
    radii = {(d, c): r for d, c, r in sizes.select("_dim", "_cell", "radius").collect()}  # CELLS for each length at most
    queries = rows.where(is_query)
    best = None
    first, width = 0, 1
    while first < max((len(t.centres) for t in trees.values()), default=0):
        asking = queries.withColumn("floor", F.lit(LOWEST))
        if best is not None:
            kth = best.groupBy(F.col("query_row").alias("_row")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
            asking = queries.join(kth, "_row", "left").select("vec_id", "v", "_dim", "_row", F.coalesce("kth", F.lit(LOWEST)).alias("floor"))
        sent = checkpoint(_sent(asking.select("vec_id", "v", "_dim", "_row", "floor"), trees, radii, first, first + width))
        if not sent.take(1):
            break
        found = _searched(held, sent, sizes.select("_dim", "_cell", "n"), shard_rows, query_rows, k)
        found = found if best is None else best.unionByName(found)
        place = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
        best = checkpoint(found.withColumn("rank", place).where(F.col("rank") <= k).drop("rank"))
        first, width = first + width, width * WIDER
    if best is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", place.alias("rank"), "vec_id", "score")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector of ``embeddings``, by integer inner product."""
    return top_k(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"))


ORACLE = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.v, c.v)::bigint as score
    from v q join v c on c.r <> q.r and len(c.v) = len(q.v) where q.vec_id % 100 = 0)
select query_id, rank::int as rank, vec_id, score from
  (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s) where rank <= 10
"""
