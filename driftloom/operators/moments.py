"""The core relation: sufficient statistics per bout, on which every drift statistic rests.

Points have key columns, a bout and a vector ``z``. A bout is one sampling unit, however many
renditions it has. Drift needs nothing but the bouts' means (centroids) or their n, sum and sum of
squares (dispersion), so renditions are aggregated once, before any pairing or resampling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def points(df: DataFrame, keys: Sequence[str], bout: str, *values: str | Column) -> DataFrame:
    """keys, bout, z: the values as a vector of doubles."""
    z = F.array(*[F.col(v).cast("double") if isinstance(v, str) else v.cast("double") for v in values])
    return df.select(*keys, F.col(bout).alias("bout"), z.alias("z"))


def ordered_means(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str], name: str) -> DataFrame:
    """by, n and the mean ``name`` of each group, added up one by one along ``order``.

    Sums of doubles depend on the order of adding; along an order of the rows they are the same
    however the table is cut into partitions. A running sum holds one number, whatever the group's size.
    """
    so_far = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    rows = df.select(*by, F.sum(value).over(so_far).alias("_s"), F.count(value).over(so_far).alias("_c"), place.alias("n"))
    last = rows.groupBy(*by).agg(F.max("n").alias("n"), F.max_by(F.struct("_s", "_c"), "n").alias("_l"))
    return last.select(*by, "n", (F.col("_l._s") / F.nullif(F.col("_l._c"), F.lit(0))).alias(name))


def long_form(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, "bout", F.posexplode("z").alias("dim", "x"))


def bout_moments(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, bout, dim, n, sx, sxx of every bout and dimension."""
    return long_form(df, keys).groupBy(*keys, "bout", "dim").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx")
    )


def bout_means(moments: DataFrame) -> DataFrame:
    return moments.withColumn("m", F.col("sx") / F.col("n")).drop("sx", "sxx")


def unit_moments(means: DataFrame, keys: Sequence[str], value: str = "m") -> DataFrame:
    """keys, dim, mu, v, units: mean and sample variance over the units."""
    return means.groupBy(*keys, "dim").agg(
        F.avg(value).alias("mu"), F.var_samp(value).alias("v"), F.count(F.lit(1)).alias("units"), F.sum("n").alias("n_rows")
    )


def total_variance(moments: DataFrame, keys: Sequence[str], weight: Column | None = None) -> DataFrame:
    """keys, n_rows, tv: the sum over dimensions of the renditions' sample variance, from the bouts' moments.

    ``weight`` is how often a bout counts. Groups of fewer than two renditions have a null variance.
    """
    w = F.lit(1) if weight is None else weight
    per_dim = moments.groupBy(*keys, "dim").agg(
        F.sum(F.col("n") * w).alias("n"), F.sum(F.col("sx") * w).alias("sx"), F.sum(F.col("sxx") * w).alias("sxx")
    )
    v = F.when(F.col("n") > 1, F.greatest((F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")) / (F.col("n") - 1), F.lit(0.0)))
    return per_dim.groupBy(*keys).agg(F.max("n").alias("n_rows"), F.sum(v).alias("tv"))


def centred(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Points with the mean of their group taken off, so that squares don't cancel; drift is not changed by it."""
    means = df.select(*by, F.posexplode("z").alias("dim", "x")).groupBy(*by, "dim").agg(F.avg("x").alias("m"))
    centre = means.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("_c"))
    joined = df.join(centre, list(by)) if by else df.crossJoin(F.broadcast(centre))  # one row
    return joined.withColumn("z", F.zip_with("z", "_c", lambda x, c: x - c)).drop("_c")
