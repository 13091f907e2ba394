"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word: a run of anything but the space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a session whose tasks run in the driver's own process (``local``) gets a
    temporary folder; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="driftloom-")


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder, its lineage cut."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def boxed(docs: DataFrame, *more: Column) -> DataFrame:
    """All columns of ``docs`` in one, ``_row``, whatever their names, and ``more`` beside it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *more)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def document_key() -> list[Column]:
    """Two columns that name a row of documents by its id and its text; rows equal in both are one document."""
    tag = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return [F.xxhash64(tag, "text").alias("_k1"), F.hash("text", tag).alias("_k2")]


#: Keys of a join that are broadcast at most: some 10 MB.
FEW_KEYS = 100_000


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], rows_of: str) -> DataFrame:
    """The inner join of ``rows`` with ``keyed``, which has each key once and, in ``rows_of``, about how many rows have it.

    Up to FEW_KEYS keys are broadcast. Of more, a key with more rows than a shuffle partition's even
    share is dealt out to several tasks by a hash of the whole row. There are no more such keys than
    partitions; they are broadcast.
    """
    keyed = checkpoint(keyed)
    count, total = keyed.agg(F.count(F.lit(1)), F.sum(rows_of)).first()
    if count <= FEW_KEYS:
        return rows.join(F.broadcast(keyed), keys)
    share = max(1000, (total or 0) // partitions(rows.sparkSession))
    parts = F.ceil(F.col(rows_of) / share).cast("int").alias("_parts")
    hot = keyed.where(F.col(rows_of) > share).select(*keys, parts)
    salt = F.pmod(F.xxhash64(*rows.columns), F.coalesce("_parts", F.lit(1))).cast("int")
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_parts")
    right = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), parts) - 1)))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def looked_up(rows: DataFrame, keyed: DataFrame, keys: list[str]) -> DataFrame:
    """The left join of ``rows`` with ``keyed``, which has each of its keys once.

    Up to FEW_KEYS keys are broadcast. More are joined as tables that nothing has dealt out before,
    so that Spark may split the tasks of hot keys among ``rows``.
    """
    keyed = checkpoint(keyed)
    few = keyed.count() <= FEW_KEYS
    return rows.join(F.broadcast(keyed) if few else keyed, keys, "left")


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``_nth``: 1, 2, ... for the rows that are equal in ``keys`` (none of them null), in any order.

    Rows are numbered within the partitions that hold them, and each goes on where the one before
    has ended, so that the copies of a key are never in one task.
    """
    held = checkpoint(rows.withColumn("_held", F.spark_partition_id()))
    counts = held.groupBy(*keys, "_held").agg(F.count(F.lit(1)).alias("_n"))
    several = counts.groupBy(*keys).agg(F.sum("_n").alias("_n")).where("_n > 1").select(*keys)
    counts = checkpoint(counts.join(several, keys, "left_semi"))
    if not counts.take(1):
        return held.drop("_held").withColumn("_nth", F.lit(1).cast("long"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_held")) - F.col("_n")
    starts = counts.withColumn("_before", before).drop("_n")
    own = F.row_number().over(W.partitionBy(*keys, "_held").orderBy(F.lit(1)))
    found = held.withColumn("_own", own).join(starts, [*keys, "_held"], "left")
    return found.withColumn("_nth", F.coalesce("_before", F.lit(0)) + F.col("_own")).drop("_held", "_own", "_before")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links ``a``, ``b`` (longs): ``node``, ``root`` (its smallest node).

    Alternating large-star and small-star steps: every node hands its larger neighbours to its
    smallest one, then its smaller ones, until each node points at its root. A hub's rows meet only
    in joins and in minima that are taken before the shuffle, so no group is gathered in one task.
    Nodes without links are not returned; an empty table gives an empty result.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state = checkpoint(pairs.distinct())
    seen = None
    while True:
        mark = tuple(state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == seen:
            return state.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").unionByName(
                state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = mark
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = checkpoint(small.unionByName(lowest.withColumnRenamed("m", "b")).distinct())
