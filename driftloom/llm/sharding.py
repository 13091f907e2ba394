"""Balanced label propagation: linked documents move to one shard, shard sizes stay even.

Documents with one text are linked. Each starts in a shard by hash. In each round a join of the
copies with their group's cells tells where most of their neighbours can be together: in the group's
cell with the largest size it could reach under the shard's quota (a group larger than that gets
several such cells). Copies that are elsewhere want to move there. Moves are taken in hash order as
far as the quota of the target goes; the quota cut is found with a histogram of 4,096 buckets per
target, and only its boundary bucket is looked at move by move. Each round takes links off the cut,
and the last is the one that moves nothing.

The copies of a group in a shard are interchangeable, so the state of the propagation is a row
(group, shard, count), not a row per document: a link is one of the pairs in a group, and as many are
cut as there are pairs of copies in different shards. Groups of one stay out of it. At the end
documents are numbered within their shards, linked ones first; those beyond the shard's quota fill
the gaps of the others by number, so counts are at most one apart whatever the propagation has left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.llm.common import checkpoint, partitions, spread_join, table

SHARDS = 40
#: Rounds in a row without more links kept, after which moves only go round in circles.
IDLE = 4
BUCKETS = 4096
FIXED_BYTES = 16


def _picked(values: list[int], at: Column) -> Column:
    """The value for a shard; ``values`` has one entry per shard."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]).cast("array<bigint>"), at + 1)


def _per_shard(df: DataFrame, shards: int, total: str) -> list[int]:
    """Sums by ``shard``: at most one row per shard comes to the driver."""
    found = dict(map(tuple, df.groupBy("shard").agg(F.sum(total)).collect()))
    return [int(found.get(s, 0)) for s in range(shards)]


def wishes(cells: DataFrame, room: list[int]) -> DataFrame:
    """The cells whose copies want to move: g, shard, n, target.

    A group's leaders are its cells of greatest reach, as many as it needs to hold all its copies;
    its other cells are joined with them.
    """
    here = F.struct("shard", "n", _picked(room, F.col("shard")).alias("space"))
    groups = cells.groupBy("g").agg(F.sum("n").alias("all"), F.collect_list(here).alias("cells"))  # a cell for each shard at most
    ranked = F.array_sort(
        F.transform("cells", lambda c: F.struct(
            (-F.least(F.col("all"), c["n"] + c["space"])).alias("reach"), (-c["n"]).alias("n"),
            F.xxhash64("g", c["shard"]).alias("h"), c["shard"].alias("shard"), c["space"].alias("space"),
        ))
    )
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).cast("bigint").alias("before"), none.alias("leaders"), none.alias("open"))

    def step(have: Column, c: Column) -> Column:
        shard = F.array(c["shard"].cast("int"))
        more = F.struct(
            (have["before"] - c["reach"]).alias("before"), F.concat(have["leaders"], shard).alias("leaders"),
            F.when(c["space"] > 0, F.concat(have["open"], shard)).otherwise(have["open"]).alias("open"),
        )
        return F.when(have["before"] < F.col("all"), more).otherwise(have)

    leaders = groups.select("g", F.aggregate(ranked, start, step).alias("x"))
    leaders = leaders.select("g", "x.leaders", F.array_sort("x.open").alias("open")).where("size(open) > 0")
    moving = cells.join(leaders, "g").where(~F.array_contains("leaders", F.col("shard").cast("int")))
    pick = F.pmod(F.xxhash64("g", "shard"), F.size("open")).cast("int")
    return moving.select("g", "shard", "n", F.element_at("open", pick + 1).alias("target"))


def propagate(cells: DataFrame, shards: int, quotas: list[int], rounds: int | None = None) -> DataFrame:
    """The cells (g, shard, n) after rounds of moves under the shards' quotas: until nothing moves any more, or ``rounds`` of them.

    Rounds also end when IDLE of them in a row have brought no more copies together.
    """
    state = checkpoint(cells)
    best, idle = -1, 0
    while rounds is None or rounds > 0:
        rounds = None if rounds is None else rounds - 1
        load = _per_shard(state, shards, "n")
        room = [max(0, q - n) for q, n in zip(quotas, load)]
        moves = checkpoint(
            wishes(state, room).withColumn("_b", F.pmod(F.xxhash64("target", "g"), F.lit(BUCKETS)))
        )
        hist = moves.groupBy("target", "_b").agg(F.sum("n").alias("n"))
        before = F.sum("n").over(W.partitionBy("target").orderBy("_b")) - F.col("n")
        hist = hist.withColumn("_before", before).where(F.col("_before") + F.col("n") > _picked(room, F.col("target")))
        cut = {r[0]: r[1] for r in hist.groupBy("target").agg(F.min(F.struct("_b", "_before"))).collect()}
        edge = _picked([cut[s][0] if s in cut else BUCKETS for s in range(shards)], F.col("target"))
        left = [room[s] - cut[s][1] if s in cut else 0 for s in range(shards)]
        at_edge = moves.where(F.col("_b") == edge)
        earlier = F.sum("n").over(W.partitionBy("target").orderBy("g", "shard")) - F.col("n")
        part = F.greatest(F.lit(0), F.least(F.col("n"), _picked(left, F.col("target")) - earlier))
        taken = (
            moves.where(F.col("_b") < edge).withColumn("_m", F.col("n"))
            .unionByName(at_edge.withColumn("_m", part).where("_m > 0"))
        )
        change = taken.select("g", F.col("target").alias("shard"), F.col("_m").alias("n")).unionByName(
            taken.select("g", "shard", (-F.col("_m")).alias("n"))
        )
        state = checkpoint(state.unionByName(change).groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
        if not taken.take(1):
            break
        kept = state.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
        best, idle = max(best, kept), 0 if kept > best else idle + 1
        if idle >= IDLE:
            break
    return state


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, links (other rows with the text), cut_links (those in other shards), shard, slot of every row.

    The counts of the shards differ by one at most, and slots run from 0 without gaps. Null texts
    are empty, and linked with the empty ones; a text of any length is read whole; a null doc_id is
    an id like any other; rows that repeat are documents each, and interchangeable, as are equal
    texts where moves tie; an empty table gives an empty result; only doc_id and text are read.
    """
    spark = docs.sparkSession
    salts = shards * -(-partitions(spark) // shards)
    text = F.coalesce("text", F.lit(""))
    rows = checkpoint(
        docs.select(
            "doc_id",
            (F.octet_length(text) + FIXED_BYTES).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("g"),
            F.pmod(F.xxhash64("doc_id", text), F.lit(salts)).cast("int").alias("salt"),
        )
    )
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    dealt = checkpoint(rows.groupBy("g", "salt").agg(F.count(F.lit(1)).alias("n")))
    groups = dealt.groupBy("g").agg(F.sum("n").alias("all")).where("all > 1")
    linked = dealt.join(groups.select("g"), "g", "left_semi")
    cells = linked.groupBy("g", F.pmod("salt", F.lit(shards)).alias("shard")).agg(F.sum("n").alias("n"))
    cells = propagate(cells, shards, quotas, rounds)
    ends = cells.groupBy("g").agg(
        F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("cells")
    )  # as many as shards at most
    starts = linked.withColumn("start", F.sum("n").over(W.partitionBy("g").orderBy("salt")) - F.col("n")).select(
        "g", "salt", "start"
    )
    lookup = starts.join(ends, "g")
    number = F.row_number().over(W.partitionBy("g", "salt").orderBy("doc_id")) - 1
    rank = F.col("start") + F.col("number")
    found = F.aggregate(
        "cells",
        F.struct(F.lit(-1).cast("int").alias("shard"), rank.cast("bigint").alias("left")),
        lambda a, c: F.when(a["shard"] >= 0, a)
        .when(a["left"] < c["n"], F.struct(c["shard"].cast("int").alias("shard"), a["left"].alias("left")))
        .otherwise(F.struct(a["shard"].alias("shard"), (a["left"] - c["n"]).alias("left"))),
    )["shard"]
    placed = rows.withColumn("number", number).join(lookup, ["g", "salt"], "left")
    placed = checkpoint(
        placed.select(
            "doc_id", "size", "text_crc32", "salt", "g",
            F.col("start").isNotNull().alias("linked"),
            F.coalesce(found, F.pmod("salt", F.lit(shards))).cast("int").alias("shard"),
        )
    )
    return _with_cuts(checkpoint(_evened(placed, shards, quotas)))


def _with_cuts(placed: DataFrame) -> DataFrame:
    """``placed`` with links and cut_links in place of ``g`` and ``linked``."""
    cells = placed.where("linked").groupBy("g", "shard").agg(F.count(F.lit(1)).alias("here"))
    total = F.sum("here").over(W.partitionBy("g"))  # a row for each shard at most
    cells = checkpoint(cells.withColumn("links", total - 1).withColumn("cut_links", total - F.col("here")))
    columns = ["doc_id", "size", "text_crc32", "links", "cut_links", "shard", "slot"]
    linked = spread_join(placed.where("linked").drop("linked"), cells, ["g", "shard"], "here").select(columns)
    none = F.lit(0).cast("long")
    return linked.unionByName(placed.where("not linked").withColumns({"links": none, "cut_links": none}).select(columns))


def _evened(placed: DataFrame, shards: int, quotas: list[int]) -> DataFrame:
    """Slots within the shards, linked documents first; what is beyond a quota fills the other shards."""
    by = ["shard", "linked", "salt"]
    counts = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))  # 2 * salts * shards rows at most
    load = _per_shard(counts, shards, "n")
    first = F.sum("n").over(W.partitionBy("shard").orderBy(F.desc("linked"), "salt")) - F.col("n")
    counts = counts.withColumn("first", first).drop("n")
    number = F.row_number().over(W.partitionBy(*by).orderBy("doc_id", "text_crc32", "size")) - 1
    ranked = placed.withColumn("_n", number).join(counts, by).withColumn("_rank", F.col("first") + F.col("_n"))
    surplus = [max(0, n - q) for n, q in zip(load, quotas)]
    gap = [max(0, q - n) for n, q in zip(load, quotas)]
    surplus_at = [sum(surplus[:s]) for s in range(shards)]
    gap_at = [sum(gap[:s]) for s in range(shards)]
    over = F.col("_rank") - _picked(quotas, F.col("shard"))
    spare = _picked(surplus_at, F.col("shard")) + over
    gap_ends = F.array(*[F.lit(a + g) for a, g in zip(gap_at, gap)]).cast("array<bigint>")
    target = F.size(F.filter(gap_ends, lambda e: e <= spare))
    slot = _picked(load, F.col("_to")) + spare - _picked(gap_at, F.col("_to"))
    ranked = ranked.withColumn("_to", F.when(over < 0, F.col("shard")).otherwise(target))
    return ranked.select(
        "doc_id", "size", "text_crc32", "g", "linked",
        F.col("_to").cast("int").alias("shard"),
        F.when(over < 0, F.col("_rank")).otherwise(slot).cast("long").alias("slot"),
    )


def op7_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 40 shards whose counts are at most one apart, copies together."""
    found = balanced_shards(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "links", "cut_links",
    )
