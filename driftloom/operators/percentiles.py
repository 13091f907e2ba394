"""Exact percentiles of groups of any size, by histograms that are refined where the rank lies.

``percentile`` keeps all different values of a group in one aggregate. Here a round counts a group's
values in ``BUCKETS`` buckets between two bounds, with the least and the greatest value of each; what
the next round looks at lies between the least value of the bucket that holds the lower rank and the
greatest of the one that holds the upper. Bounds are values of the data, so nothing depends on how
buckets are rounded, and the result is that of ``percentile`` to the last bit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.functions.lineage import cut

BUCKETS = 1024
#: Values of a group that are gathered in the end, at most (or values that are all equal).
FEW = 4096
#: Rows of a group up to which ``percentile`` does the same in one aggregate.
SMALL = 1_000_000
#: Groups up to which bounds are broadcast.
FEW_GROUPS = 100_000


def _between(low: Column, high: Column, place: Column) -> Column:
    """The value at a place between two neighbours, as Spark's ``percentile`` reckons it."""
    down, up = F.floor(place), F.ceil(place)
    return F.when((down == up) | (low == high), low).otherwise((up - place) * low + (place - down) * high)


def _bounded(rows: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """The rows between their group's bounds."""
    return rows.join(F.broadcast(state) if few else state, "_k").where((F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))


def exact(df: DataFrame, by: Sequence[str], value: str | Column, level: float, few: int = FEW, buckets: int = BUCKETS) -> DataFrame:
    """by, n, percentile: of the values that are neither null nor NaN. ``by`` may be empty: one group. Groups without values have no row."""
    x = F.col(value) if isinstance(value, str) else value
    key = F.struct(*by) if by else F.lit(0)
    rows = cut(df.select(key.alias("_k"), x.cast("double").alias("_x")).where("_x is not null and not isnan(_x)"))
    place = (F.col("_n") - 1) * F.lit(float(level))
    state = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    state = cut(state.withColumns({"_before": F.lit(0).cast("long"), "_here": F.col("_n")}))
    small = state.count() <= FEW_GROUPS
    found, known = None, None
    while True:
        done = (F.col("_here") <= few) | (F.col("_lo") == F.col("_hi"))
        found = state.where(done) if found is None else found.unionByName(state.where(done))
        state = state.where(~done)
        if not state.take(1):
            break
        share = (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        # where the difference of huge bounds is no number, halves do
        half = F.when(F.col("_x") > F.col("_lo") / 2 + F.col("_hi") / 2, 0.75).otherwise(0.25)
        share = F.when(F.abs(F.col("_hi") - F.col("_lo")) < float("inf"), share).otherwise(half)
        # both bounds have buckets of their own, so what lies in another one is less than there was
        inner = F.least(F.floor(share * buckets), F.lit(buckets - 1))
        bucket = F.when(F.col("_x") == F.col("_lo"), -1).when(F.col("_x") == F.col("_hi"), buckets).otherwise(inner)
        counts = _bounded(rows, state, small).groupBy("_k", bucket.alias("_b")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most"), *[F.first(c).alias(c) for c in ("_n", "_before")]
        )
        upto = F.sum("_c").over(W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, 0))
        counts = counts.withColumn("_end", F.col("_before") + upto).withColumn("_begin", F.col("_end") - F.col("_c"))
        holds = (F.col("_begin") <= F.ceil(place)) & (F.col("_end") > F.floor(place))
        held = cut(counts.where(holds).groupBy("_k").agg(
            F.count(F.lit(1)).alias("_m"), F.first("_n").alias("_n"), F.min("_least").alias("_lo"), F.max("_most").alias("_hi"),
            F.min("_begin").alias("_before"), F.sum("_c").alias("_here"), F.min(F.struct("_b", "_most"))["_most"].alias("_low"), F.max(F.struct("_b", "_least"))["_least"].alias("_high"),
        ))
        # the two ranks in two buckets: the last value of the one and the first of the other
        apart = held.where("_m > 1").select("_k", "_n", _between(F.col("_low"), F.col("_high"), place).alias("percentile"))
        known = apart if known is None else known.unionByName(apart)
        state = held.where("_m = 1").select("_k", "_n", "_lo", "_hi", "_before", "_here")
    equal = F.col("_lo") == F.col("_hi")
    gathered = _bounded(rows, found.where(~equal), small).groupBy("_k", "_n", "_before").agg(F.sort_array(F.collect_list("_x")).alias("_v"))
    at = [F.get("_v", (f(place) - F.col("_before")).cast("int")) for f in (F.floor, F.ceil)]
    out = gathered.select("_k", "_n", _between(*at, place).alias("percentile"))
    out = out.unionByName(found.where(equal).select("_k", "_n", F.col("_lo").alias("percentile")))
    out = out if known is None else out.unionByName(known)
    return out.select(*[F.col("_k")[c].alias(c) for c in by], F.col("_n").alias("n"), "percentile")


def of_groups(df: DataFrame, by: Sequence[str], value: Column, level: float, most: int = SMALL) -> DataFrame:
    """by, n, percentile, with ``percentile`` where no group has more than ``most`` rows, else in rounds; the result is the same."""
    rows = df.select(*by, value.alias("_x")).where("_x is not null and not isnan(_x)")
    largest = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most:
        return exact(rows, by, "_x", level)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile("_x", F.lit(level)).alias("percentile")).where("n > 0")
