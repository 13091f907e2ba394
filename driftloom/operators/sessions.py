"""Order-dependent operators: sessions by gaps, merged runs, blocks, adjacent pairs, first days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seconds(ts: str | Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, with their fraction."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp")) / 1e6


def sessions(df: DataFrame, by: Sequence[str], at: Column, gap: float, order: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``bout``: from 0, one more after each gap of over ``gap``; a gap of exactly that stays together."""
    if gap <= 0:
        raise ValueError(f"the gap must be positive, not {gap}")
    along = W.partitionBy(*by).orderBy("_at", *order)
    rows = df.withColumn("_at", at)
    new = F.coalesce((F.col("_at") - F.lag("_at").over(along) > gap).cast("long"), F.lit(0))
    rows = rows.withColumn("_new", new)
    bout = F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("bout", bout).drop("_at", "_new")


def gaps(df: DataFrame, by: Sequence[str], at: Column, order: Sequence[str] = ()) -> DataFrame:
    """``by`` and gap: the positive distances of neighbours."""
    rows = df.select(*by, *order, at.alias("_at"))
    along = W.partitionBy(*by).orderBy("_at", *order)
    found = rows.withColumn("gap", F.col("_at") - F.lag("_at").over(along))
    return found.where("gap > 0").select(*by, "gap")


def suggested_gap(df: DataFrame, by: Sequence[str], at: Column, low: float = 0.5, high: float = 0.99) -> DataFrame:
    """The geometric mean of two percentiles of the positive gaps, for groups of three stamps or more; at least 1e-6."""
    found = gaps(df, by, at)
    enough = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 3").select(*by)
    p = found.groupBy(*by).agg(F.percentile("gap", F.array(F.lit(low), F.lit(high))).alias("_p"))
    p = p.join(enough, list(by), "left_semi") if by else p
    return p.select(*by, F.greatest(F.sqrt(F.col("_p")[0] * F.col("_p")[1]), F.lit(1e-6)).alias("gap_s"))


def merged_runs(df: DataFrame, by: Sequence[str], least_silence: float, least_length: float) -> DataFrame:
    """Disjoint intervals, those less than ``least_silence`` apart joined, then the short ones dropped, in this order."""
    along = W.partitionBy(*by).orderBy("onset_s", "offset_s")
    apart = F.coalesce((F.col("onset_s") - F.lag("offset_s").over(along) >= least_silence).cast("long"), F.lit(0))
    rows = df.withColumn("_apart", apart)
    rows = rows.withColumn("_run", F.sum("_apart").over(along.rowsBetween(W.unboundedPreceding, 0)))
    runs = rows.groupBy(*by, "_run").agg(F.min("onset_s").alias("onset_s"), F.max("offset_s").alias("offset_s"))
    return runs.where(F.col("offset_s") - F.col("onset_s") >= least_length).drop("_run")


def blocks(df: DataFrame, by: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """``df`` with block: every ``size`` rows of a group, in order, from 0."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("block", F.floor((rank - 1) / F.lit(size)).cast("long"))


def bigrams(df: DataFrame, bout: Sequence[str], order: Sequence[str], label: str, keep: Sequence[str] = (), types: Sequence | None = None, splice: bool = True) -> DataFrame:
    """``keep``, bout, first, second of each adjacent pair within a bout.

    Labels beyond ``types`` are taken out before pairs are formed, as if they were not there; with
    ``splice`` off, pairs with such a label are left out instead.
    """
    if types is not None and splice:
        df = df.where(F.col(label).isin(*types))
    along = W.partitionBy(*bout).orderBy(*order)
    pairs = df.select(*dict.fromkeys([*keep, *bout]), F.col(label).alias("first"), F.lead(label).over(along).alias("second"))
    pairs = pairs.where("second is not null")
    if types is not None and not splice:
        pairs = pairs.where(F.col("first").isin(*types) & F.col("second").isin(*types))
    return pairs


def sequences(df: DataFrame, bout: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """bout, labels: the labels of each bout in order. For bouts, which are small; never for whole tables."""
    along = F.sort_array(F.collect_list(F.struct(*order, F.col(label).alias("_label"))))
    return df.groupBy(*bout).agg(F.transform(along, lambda x: x["_label"]).alias("labels"))


def reference_day(df: DataFrame, by: Sequence[str], day: str = "day") -> DataFrame:
    return df.groupBy(*by).agg(F.min(day).alias("reference_day"))


def nearest_share(df: DataFrame, by: Sequence[str], distance: str, key: str, share: float, least: int = 50) -> DataFrame:
    """Of each group, the rows of smallest distance: ``share`` of them, but ``least`` at any rate."""
    whole = W.partitionBy(*by)
    rank = F.row_number().over(whole.orderBy(distance, key))
    most = F.greatest(F.floor(F.count(F.lit(1)).over(whole) * F.lit(share)), F.lit(least))
    return df.withColumn("_rank", rank).withColumn("_most", most).where("_rank <= _most").drop("_rank", "_most")


def average_ranks(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with the rank of a value among its group's, ties sharing the mean of their ranks."""
    whole = W.partitionBy(*by)
    ties = F.count(F.lit(1)).over(W.partitionBy(*by, value))
    return df.withColumn(name, F.rank().over(whole.orderBy(value)) + (ties - 1) / 2)
