"""Mixing sources to target weights with hash-threshold histograms.

Every row gets a 60-bit hash of its id, its text and its number among the rows that are equal in
both. A source whose target is ``b`` whole passes plus a remainder takes each document ``b`` times,
and once more those whose hash lies under a threshold. The threshold comes from histograms: words by
source and leading 12 hash bits, whole buckets under the budget, then only the boundary bucket by
the next 12 bits. No source is ever sorted.

From the boundary sub-bucket on, documents are looked at one by one in the order of their hashes,
some 4,096 of a source at a time, and taken if they fit in what is left of the budget. What has not
fitted never will, so the next look is for smaller documents further on, until there are none: what
a source lacks in the end is less than any document that it could still have taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.llm.common import WORD, boxed, checkpoint, numbered, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEAT = 2
#: The source table is broadcast up to this many sources (some 100 bytes each), else joined.
BROADCAST_SOURCES = 20_000
HASH_BITS, STEP = 60, 12
#: Documents of a source that are looked at one by one at a time, about.
LOOK = 4096
TOP = 1 << HASH_BITS
WALKS = "cast(array() as array<struct<low:bigint,high:bigint,g:bigint,taken:array<bigint>>>)"
IS_TAKEN = "_h < _t or exists(_walks, x -> _h >= x.low and _h < x.high and size <= x.g and array_contains(x.taken, _h))"


def _keyed() -> list[Column]:
    """size, ``_k`` (sorts as the source by code point, null last), ``_id`` and ``_m`` (name the document)."""
    return [
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~")).alias("_k"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"),
        F.coalesce(F.md5("text"), F.lit("null")).alias("_m"),
    ]


def _hashed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_h`` in place of ``_id`` and ``_m``."""
    rows = numbered(rows, ["_k", "_id", "_m"])
    digest = F.md5(F.concat_ws(":", "_id", "_m", "_nth"))
    return rows.withColumn("_h", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")).drop("_id", "_m", "_nth")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, _k and _h of every row."""
    return checkpoint(_hashed(docs.select("doc_id", "source", *_keyed())))


def targets(docs: DataFrame, weights: Sequence[int], share: float, max_repeat: int) -> DataFrame:
    """One row per source: its size, target, whole passes and the words left for the threshold.

    The sources that stop at ``max_repeat`` times their size are those with the smallest size per
    weight; in that order, the first uncapped source is found with running sums.
    """
    by_source = docs.groupBy("_k").agg(F.sum("size").alias("source_size"))
    place = F.pmod(F.row_number().over(W.orderBy("_k")) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    cap = F.col("source_size") * max_repeat
    order = W.orderBy("_full", "_k")
    everything = W.partitionBy()
    t = (
        by_source.withColumn("_w", weight.cast("double"))
        .withColumn("_full", cap / F.col("_w"))
        .withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_before", F.coalesce(F.sum(cap).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_weights", F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_weights"))
    )
    level = F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_k", "_level"))).over(everything)
    target = F.least(F.coalesce(level["_level"] * F.col("_w"), cap.cast("double")), cap.cast("double"))
    t = t.withColumn("target", F.round(target, 6))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return (
        t.withColumn("_passes", passes.cast("long"))
        .withColumn("_gap", F.floor(F.col("target") - F.col("_passes") * F.col("source_size")).cast("long"))
        .select("_k", "source_size", "target", "_passes", "_gap")
    )


def _threshold(rows: DataFrame, state: DataFrame, hint) -> DataFrame:  # noqa: ANN001
    """``state`` with ``_t``, where the sub-bucket begins in which a source's gap is used up, and the gap that is left there."""
    base = state.select("_k", "_gap", F.lit(0).cast("long").alias("_t"))
    for level in (1, 2):
        shift, above = HASH_BITS - STEP * level, HASH_BITS - STEP * (level - 1)
        inside = rows.join(hint(base), "_k").where(F.shiftright("_h", above) == F.shiftright("_t", above))
        hist = inside.groupBy("_k", F.shiftright("_h", shift).alias("_b")).agg(F.sum("size").alias("_s"))
        hist = hist.withColumn("_cum", F.sum("_s").over(W.partitionBy("_k").orderBy("_b")))
        hist = hist.join(hint(base.select("_k", F.col("_gap").alias("_g"))), "_k")
        edge = hist.where("_cum > _g").groupBy("_k").agg(F.min_by(F.struct("_b", (F.col("_cum") - F.col("_s")).alias("_before")), "_b").alias("_x"))
        base = base.join(edge, "_k", "left").select(
            "_k", (F.col("_gap") - F.coalesce("_x._before", F.lit(0))).alias("_gap"),
            F.coalesce(F.col("_x._b") * F.lit(1 << shift), F.lit(TOP)).alias("_t"),
        )
        base = checkpoint(base)
    return state.drop("_gap").join(hint(base), "_k")


def _walked(docs: str, gap: str) -> Column:
    """(gap, taken): which of the documents, in order of their hashes, are taken while they fit."""
    start = F.struct(F.col(gap).alias("gap"), F.expr("cast(array() as array<bigint>)").alias("taken"))

    def step(have: Column, doc: Column) -> Column:
        more = F.struct((have["gap"] - doc["size"]).alias("gap"), F.concat(have["taken"], F.array(doc["_h"])).alias("taken"))
        return F.when(doc["size"] <= have["gap"], more).otherwise(have)

    return F.aggregate(F.array_sort(F.col(docs)), start, step)


def plan(rows: DataFrame, weights: Sequence[int], share: float, max_repeat: int) -> tuple[DataFrame, bool]:
    """Each source's passes, threshold and later takes for the ``sized`` rows, and whether they are few enough to broadcast."""
    state = checkpoint(targets(rows, weights, share, max_repeat))
    small = state.count() <= BROADCAST_SOURCES
    hint = F.broadcast if small else (lambda df: df)
    rows = rows.where("size > 0").select("_k", "size", "_h")
    state = _threshold(rows, state, hint).withColumn("_walks", F.expr(WALKS)).withColumn("_next", F.col("_t"))
    while True:
        state = checkpoint(state)
        ahead = rows.join(hint(state.select("_k", "_gap", "_next")), "_k").where("size <= _gap and _h >= _next")
        counts = ahead.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.first("_next").alias("_next"))
        width = (F.lit(TOP) - F.col("_next")) * (F.lit(float(LOOK)) / F.col("_n"))
        high = F.when(F.col("_n") <= LOOK, F.lit(TOP)).otherwise(F.least(F.lit(TOP), F.col("_next") + F.ceil(width)))
        bounds = checkpoint(counts.select("_k", high.cast("long").alias("_high")))
        if not bounds.take(1):
            return state, small
        found = ahead.join(hint(bounds), "_k").where("_h < _high").groupBy("_k").agg(
            F.first("_gap").alias("_gap"), F.collect_list(F.struct("_h", "size")).alias("_docs")  # some LOOK of them
        )
        found = found.select("_k", _walked("_docs", "_gap").alias("_x"))
        walk = F.struct(F.col("_next").alias("low"), F.col("_high").alias("high"), F.col("_gap").alias("g"), F.col("_x.taken").alias("taken"))
        state = state.join(hint(bounds), "_k", "left").join(hint(found), "_k", "left").select(
            "_k", "source_size", "target", "_passes", "_t", F.coalesce("_x.gap", "_gap").alias("_gap"),
            F.when(F.col("_x").isNull(), F.col("_walks")).otherwise(F.concat("_walks", F.array(walk))).alias("_walks"),
            F.coalesce("_high", F.lit(TOP)).alias("_next"),
        )


def _copies(rows: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    copies = F.when(F.col("size") > 0, F.col("_passes") + F.expr(f"cast({IS_TAKEN} as bigint)")).otherwise(0)
    return rows.join(F.broadcast(state) if small else state, "_k").withColumn("copies", copies.cast("long"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (= copies * size) of every row.

    Null texts and texts without words have size 0 and are taken 0 times; a text of any length is
    counted whole; a null source is one source, the last; a null doc_id is an id like any other. Rows
    that repeat, or share an id, have hashes of their own by text and number, so some of them may be
    taken and others not; of equal rows it is undefined which, and the result is the same. An empty
    table gives an empty result; columns beyond doc_id, text and source are not looked at. Reruns
    agree: nothing but ids, texts and sources decides.
    """
    rows = sized(docs)
    found = _copies(rows, *plan(rows, weights, share, max_repeat))
    return found.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as ``mix`` takes it."""
    state, small = plan(sized(docs), weights, share, max_repeat)
    found = _copies(_hashed(boxed(docs, *_keyed())), state, small).where("copies > 0")
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table mixed to the weights 5, 2, 1 at 150 % of its words."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: Rounds of the SQL: each takes the documents up to the first that does not fit.
SQL_ROUNDS = 24


def _oracle() -> str:
    """Running sums in hash order in place of histograms and looks: the same documents."""
    steps = []
    for r in range(1, SQL_ROUNDS + 1):
        prev = "start" if r == 1 else f"r{r - 1}"
        steps.append(f"""
e{r} as (select rid, k, size, sum(size) over (partition by k order by h) as cum, gap from {prev} where not extra and size > 0 and size <= gap),
t{r} as (select rid, cum from e{r} where cum <= gap),
g{r} as (select k, max(cum) as words from e{r} where cum <= gap group by k),
r{r} as (select p.* exclude (gap, extra), p.gap - coalesce(g.words, 0) as gap, p.extra or t.rid is not null as extra
  from {prev} p left join t{r} t on p.rid = t.rid left join g{r} g on p.k = g.k)""")
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce('=' || source, '~') as k,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(concat(coalesce(doc_id::varchar, 'null'), ':', coalesce(md5(text), 'null'), ':',
        row_number() over (partition by source, doc_id, text))), 1, 15))::bigint as h from documents),
s0 as (select k, sum(size)::bigint as source_size from d group by k),
s1 as (select *, (case (row_number() over (order by k) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end)::double as w from s0),
s2 as (select *, 2 * source_size / w as f, sum(source_size) over () * {SHARE}::double as everything from s1),
s3 as (select *, (everything - coalesce(sum(2 * source_size) over (order by f, k rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by f, k rows between current row and unbounded following) as level from s2),
s4 as (select *, (select arg_min(level, (f, k)) from s3 where level <= f) as cut from s3),
s5 as (select k, source_size, round(least(coalesce(cut * w, 2.0::double * source_size), 2.0::double * source_size), 6) as target from s4),
s as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as passes from s5),
start as (select d.*, s.source_size, s.target, s.passes, floor(s.target - s.passes * s.source_size)::bigint as gap, false as extra from d join s on d.k = s.k),
{",".join(steps)}
select doc_id, size, source_size, target, (case when size > 0 then (passes + extra::bigint) * size else 0 end)::bigint as taken from r{SQL_ROUNDS}
"""


ORACLE = _oracle()
