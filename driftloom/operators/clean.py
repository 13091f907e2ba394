"""Filters, repairs and counts of what they leave out. Nothing is dropped without a count beside it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.functions.scalars import not_in, portable_hash


def exclude(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose value is not one of ``values`` (labels or days)."""
    return df.where(not_in(column, values))


def rare_filter(df: DataFrame, by: Sequence[str], least: int) -> tuple[DataFrame, DataFrame]:
    """(rows of groups with ``least`` rows or more, the groups left out with their counts)."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    kept = df.join(counts.where(F.col("n") >= least).select(*by), list(by), "left_semi")
    return kept, counts.where(F.col("n") < least)


def ordered_intervals(df: DataFrame, onset: str = "onset_s", offset: str = "offset_s") -> tuple[DataFrame, DataFrame]:
    """(rows whose offset follows their onset, one row with the number of the others as n_invalid)."""
    good = F.coalesce(F.col(offset) > F.col(onset), F.lit(False))
    return df.where(good), df.agg(F.count_if(~good).alias("n_invalid"))


def clamped(df: DataFrame, low: Column | float, high: Column | float, onset: str = "onset_s", offset: str = "offset_s") -> DataFrame:
    """``df`` with onset and offset pulled into [low, high], and the flags was_low, was_high, was_empty.

    Rows that are empty after the repair are flagged and stay; ``repaired`` drops and counts them.
    """
    lowest, highest = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    begin, end = F.greatest(F.col(onset), lowest), F.least(F.col(offset), highest)
    flags = {"was_low": F.col(onset) < lowest, "was_high": F.col(offset) > highest, "was_empty": end <= begin}
    return df.withColumns(flags).withColumns({onset: begin, offset: end})


def repaired(df: DataFrame, low: Column | float, high: Column | float, onset: str = "onset_s", offset: str = "offset_s") -> tuple[DataFrame, DataFrame]:
    """(the rows that are not empty after clamping, one row with n_low, n_high and n_empty)."""
    marked = clamped(df, low, high, onset, offset)
    flags = ("was_low", "was_high", "was_empty")
    counts = marked.agg(*[F.count_if(f).alias(f"n_{f[4:]}") for f in flags])
    return marked.where("not was_empty").drop(*flags), counts


def supported(df: DataFrame, by: Sequence[str], unit: str, rows: int = 20, units: int = 4) -> DataFrame:
    """The groups with enough rows and distinct units, and their numbers n_rows and n_units."""
    found = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(unit).alias("n_units"))
    return found.where((F.col("n_rows") >= rows) & (F.col("n_units") >= units))


def with_days(df: DataFrame, individual: str = "bird", day: str = "day", least: int = 2) -> DataFrame:
    """Individuals with at least ``least`` days; a ValueError if there is none."""
    enough = df.groupBy(individual).agg(F.count_distinct(day).alias("n_days")).where(F.col("n_days") >= least)
    if enough.isEmpty():
        raise ValueError(f"no {individual} has {least} days or more")
    return df.join(enough.select(individual), individual, "left_semi")


def stratified_cap(df: DataFrame, by: Sequence[str], key: str, most: int | None, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each group, chosen by a hash of their key; none or 0 keeps all."""
    if not most:
        return df
    order = W.partitionBy(*by).orderBy(portable_hash(F.lit(seed), F.col(key)), key)
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_rank")


def train_test(df: DataFrame, by: Sequence[str], key: str, share: float = 0.7, seed: int = 0) -> DataFrame:
    """``df`` with is_train: the first ``share`` of each group in the order of a hash."""
    whole = W.partitionBy(*by)
    rank = F.row_number().over(whole.orderBy(portable_hash(F.lit(seed), F.col(key)), key))
    return df.withColumn("is_train", rank <= F.floor(F.lit(share) * F.count(F.lit(1)).over(whole)))


def within_span(df: DataFrame, spans: DataFrame, by: Sequence[str], margin: float = 0.05) -> DataFrame:
    """Intervals that lie between a group's first onset and last offset in ``spans``, give or take a margin."""
    edges = spans.groupBy(*by).agg(F.min("onset_s").alias("_first"), F.max("offset_s").alias("_last"))
    inside = (F.col("onset_s") >= F.col("_first") - margin) & (F.col("offset_s") <= F.col("_last") + margin)
    return df.join(edges, list(by)).where(inside).drop("_first", "_last")


def coverage(expected: DataFrame, found: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """n_audio, n_annotated and n_unannotated: keys of ``expected``, those ``found`` has, and the rest."""
    wanted = expected.select(*by, key).distinct()
    have = found.select(F.col(key)).distinct().withColumn("_found", F.lit(True))
    joined = wanted.join(have, key, "left")
    counts = joined.groupBy(*by).agg(F.count(F.lit(1)).alias("n_audio"), F.count("_found").alias("n_annotated"))
    return counts.withColumn("n_unannotated", F.greatest(F.col("n_audio") - F.col("n_annotated"), F.lit(0).cast("long")))


def has_groups(df: DataFrame, column: str, wanted: Sequence[str]) -> None:
    """A ValueError unless the column's values are exactly ``wanted``."""
    found = {r[0] for r in df.select(column).distinct().limit(len(wanted) + 1).collect()}
    if found != set(wanted):
        raise ValueError(f"{column} has {sorted(map(str, found))}, not {sorted(wanted)}")


def label_inventory(df: DataFrame, by: Sequence[str], label: str, day: str) -> DataFrame:
    """by, label, n, n_days, first_day, share of the group's rows, place (1 is the most frequent, ties by label)."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(day).alias("n_days"), F.min(day).alias("first_day"))
    whole = W.partitionBy(*by)
    return counts.withColumns({"share": F.col("n") / F.sum("n").over(whole), "place": F.rank().over(whole.orderBy(F.desc("n"), label))})
