"""Composite studies over point clouds: windows of age, distance to an endpoint, manipulations, sensitivity, fidelity.

Points have the columns named in each function and a vector ``z``; ``day`` may be a date or a number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.functions.lineage import cut
from driftloom.operators import clean as C
from driftloom.operators import draws as DR
from driftloom.operators import drift as D
from driftloom.operators import embedding as E
from driftloom.operators import fidelity as FD
from driftloom.operators import groups as G
from driftloom.operators import layout as LO
from driftloom.operators import moments as M
from driftloom.operators import power as P
from driftloom.operators import resampling as R
from driftloom.operators import sessions as S


def window_ratios(points: DataFrame, early: tuple, late: tuple, least: int = 100) -> DataFrame:
    """label, n_early, n_late, log_ratio: early over late total variance of labels with enough rows in both windows."""
    day = F.col("day")
    side = F.when(day.between(*early), "early").when(day.between(*late), "late")
    tv = D.variance_of_points(points.withColumn("side", side).where("side is not null"), ["label", "side"])
    wide = tv.where((F.col("n_rows") >= least) & (F.col("tv") > 0)).groupBy("label").agg(
        *[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}") for s in ("early", "late") for c in ("n_rows", "tv")]
    )
    good = wide.where("tv_early is not null and tv_late is not null")
    return good.select("label", F.col("n_rows_early").alias("n_early"), F.col("n_rows_late").alias("n_late"), F.ln(F.col("tv_early") / F.col("tv_late")).alias("log_ratio"))


def distances_to_reference(points: DataFrame, reference: DataFrame) -> DataFrame:
    """label, day, drift: the unbiased distance of each day's bouts from the pooled reference's bouts of the label."""
    fixed = M.unit_moments(M.bout_means(M.bout_moments(reference, ["label"])), ["label"])
    fixed = fixed.select("label", "dim", *[F.col(c).alias(f"r_{c}") for c in ("mu", "v", "units")]).where("r_units >= 2")
    days = M.unit_moments(M.bout_means(M.bout_moments(points, ["label", "day"])), ["label", "day"]).where("units >= 2")
    gap = F.col("mu") - F.col("r_mu")
    term = gap * gap - F.col("v") / F.col("units") - F.col("r_v") / F.col("r_units")
    return days.join(fixed, ["label", "dim"]).groupBy("label", "day").agg(F.sum(term).alias("drift"))


def convergence(distances: DataFrame) -> DataFrame:
    """One row: n, rho (rank correlation of day number and distance) and slope per day, of label means."""
    means = distances.groupBy("day").agg(F.avg("drift").alias("drift")).withColumn("t", F.datediff("day", F.lit("1970-01-01").cast("date")))
    rho = FD.spearman(means.select("t", F.round("drift", 9).alias("drift")), "t", "drift")
    slope = means.agg((F.covar_pop("drift", F.col("t").cast("double")) / F.nullif(F.var_pop("t"), F.lit(0.0))).alias("slope"))
    return rho.crossJoin(slope)  # one row each


def matched_fractions(points: DataFrame, centres: list[list[float]], fractions: Sequence[float], key: str = "id", cluster_rows: int = 100, least: int = 50) -> DataFrame:
    """fraction, day, variance: the mean over modes of the total variance of the rows nearest to each mode's centre."""
    rows = E.assigned(points, centres).select("day", F.col("mode").alias("label"), "distance", F.col(key).alias("_key"), "z")
    big = rows.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("day", "label"))).where(F.col("_n") >= cluster_rows)
    each = big.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    whole = W.partitionBy("fraction", "day", "label")
    most = F.greatest(F.floor(F.col("_n") * F.col("fraction")), F.lit(least))
    near = each.withColumn("_r", F.row_number().over(whole.orderBy("distance", "_key"))).where(F.col("_r") <= most)
    tv = D.variance_of_points(near, ["fraction", "day", "label"])
    return tv.groupBy("fraction", "day").agg(F.avg("tv").alias("variance"))


def manipulation(points: DataFrame, events: DataFrame, least_rows: int = 20, least_bouts: int = 4, least_days: int = 3, n_draws: int = 200, n_boot: int = 200, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(one row per recording, one row per bird): baseline against the days after each recording's event.

    ``points`` has bird, recording, day (date), bout and z; ``events`` recording and t0 (date). The
    event's own day is left out. Distances are in units of the baseline's variance. Several
    recordings of a bird are merged into one value.
    """
    key = ["recording"]
    rows = points.join(events, key).where("day <> t0").withColumn("is_base", F.col("day") < F.col("t0"))
    enough = rows.groupBy(*key).agg(
        F.count_distinct(F.when(F.col("is_base"), F.col("day"))).alias("nb"), F.count_distinct(F.when(~F.col("is_base"), F.col("day"))).alias("np")
    ).where((F.col("nb") >= least_days) & (F.col("np") >= least_days)).select(*key)
    rows = cut(rows.join(enough, key, "left_semi"))
    base = rows.where("is_base")
    scale = D.variance_of_points(base, key).where((F.col("n_rows") >= least_rows) & (F.col("tv") > 0)).select(*key, F.col("tv").alias("scale"))
    side = [*key, "day"]
    moments = cut(M.bout_moments(base, side))
    support = moments.where("dim = 0").groupBy(*side).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("bouts")).where(F.col("rows") >= least_rows)
    usable = moments.join(support.where(F.col("bouts") >= least_bouts).select(*side), side, "left_semi")
    floors = cut(
        R.floor_of(R.centroid_null(M.bout_means(usable), side, n_draws, seed), key, "drift").select(*key, F.col("floor").alias("c"))
        .join(R.floor_of(R.dispersion_null(usable, side, n_draws, seed), key, "log_ratio", absolute=True).select(*key, F.col("floor").alias("dispersion_floor")), key, "left")
        .join(scale, key).select(*key, "scale", (F.col("c") / F.col("scale")).alias("centroid_floor"), "dispersion_floor")
    )
    paired = moments.join(support.select(*side), side, "left_semi")
    control = D.centroid_drift(M.unit_moments(M.bout_means(paired), side), key, "day").join(scale, key)
    control = control.groupBy(*key).agg(F.median(F.col("drift") / F.col("scale")).alias("control_median"), F.max(F.col("drift") / F.col("scale")).alias("control_max"))

    pool = base.withColumn("side", F.lit("1900-01-01").cast("date"))
    after = rows.where("not is_base").withColumn("side", F.col("day"))
    after_ok = C.supported(after, [*key, "side"], "bout", least_rows, 2).select(*key, "side")
    both = pool.unionByName(after.join(after_ok, [*key, "side"], "left_semi")).select(*key, "side", "bout", "z")
    all_moments = cut(M.bout_moments(both, [*key, "side"]))
    means = M.bout_means(all_moments)
    how = (F.col("side_a") == F.lit("1900-01-01").cast("date")) & (F.col("side_b") > F.col("side_a"))
    drift = cut(D.centroid_drift(M.unit_moments(means, [*key, "side"]), key, "side", how))
    low = R.centroid_interval(means, key, "side", drift.select(*key, "side_a", "side_b"), n_boot, seed, collapse=False).select(*key, "side_b", "low")
    spread = D.dispersion_drift(M.total_variance(all_moments, [*key, "side"]), key, "side", how).select(*key, "side_b", "log_ratio")
    post = drift.join(low, [*key, "side_b"], "left").join(spread, [*key, "side_b"], "left").join(floors, key).join(events, key)
    post = post.withColumns({"days_post": F.datediff("side_b", "t0"), "std": F.col("drift") / F.col("scale"), "over": F.col("low") / F.col("scale") > F.col("centroid_floor")})
    recordings = cut(post).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_post_days"), F.max("std").alias("post_max"), F.max_by("std", "days_post").alias("post_final"),
        F.max(F.abs("log_ratio")).alias("dispersion_max"), F.min(F.when(F.col("over"), F.col("days_post"))).alias("first_day_over_floor"),
        F.count_if("over").alias("n_days_over_floor"), F.first("centroid_floor").alias("centroid_floor"), F.first("dispersion_floor").alias("dispersion_floor"),
    ).join(control, key, "left").join(points.select("bird", *key).distinct(), key)
    birds = recordings.groupBy("bird").agg(
        F.count(F.lit(1)).alias("n_recordings"), *[F.avg(c).alias(c) for c in ("centroid_floor", "dispersion_floor", "control_median", "post_max", "dispersion_max")],
        F.min("first_day_over_floor").alias("first_day_over_floor"),
    )
    return recordings, birds.withColumn("ratio", F.col("post_max") / F.nullif(F.col("centroid_floor"), F.lit(0.0)))


def manipulation_test(birds: DataFrame, seed: int = 0) -> DataFrame:
    """Post against control values of all birds, unpaired, one-sided."""
    value = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.col(c).alias("x")) for g, c in (("treated", "post_max"), ("control", "control_median"))]))
    rows = birds.select("bird", value.alias("v")).select(F.concat_ws(":", "v.g", "bird").alias("k"), F.col("v.g").alias("g"), F.col("v.x").alias("x"))
    return G.compare_groups(rows.where("x is not null"), "k", "g", "x", alternative="greater", seed=seed)


def sensitivity(points: DataFrame, bouts: Sequence[int], type_counts: Sequence[int], scale: float, effects: Sequence[float] = P.EFFECTS, n_subsets: int = 5, n_draws: int = 400, alpha: float = 0.05, power: float = 0.8, seed: int = 0) -> DataFrame:
    """n_bouts, n_types, mde: the least detectable effect when the statistic is averaged over so many types.

    A draw takes the same bouts, and the same direction, for all types. The median over random subsets of the types; null
    where no effect on the grid has the power. Cells that need more bouts than there are have no row.
    """
    means = cut(M.bout_means(M.bout_moments(points, ["label"])))
    units = means.select("bout").distinct()
    names = [r[0] for r in means.select("label").distinct().orderBy("label").collect()]
    spark = points.sparkSession
    subsets = []
    for k in type_counts:
        order = lambda s: sorted(names, key=lambda n: (_digest(seed, k, s, n), n))[:k]  # noqa: B023, E731
        subsets += [(k, s, n) for s in range(1 if k >= len(names) else n_subsets) for n in order(s)]
    chosen_types = F.broadcast(spark.createDataFrame(subsets, f"n_types int, subset int, label {dict(points.dtypes)['label']}"))
    cells = []
    for n in bouts:
        sides = []
        for s in (seed + R.NULL_SEED, seed):
            drawn = R.common_subsets(units, n, n_draws, s).collect()  # 2 n bouts for each draw
            per_label = DR.common_directed(means.select("label", "bout", "dim", "m"), [tuple(r) for r in drawn], s)
            sides.append(per_label.join(chosen_types, "label").groupBy("n_types", "subset", "draw").agg(F.avg("drift").alias("drift"), F.avg("along").alias("along")))
        critical = P.critical_value(sides[0], ["n_types", "subset"], "drift", alpha)
        grid = sides[1].join(critical, ["n_types", "subset"]).withColumn("effect", F.explode(F.array(*[F.lit(float(e)) for e in effects])))
        square = F.col("effect") * F.lit(float(scale))
        moved = F.col("drift") - 2 * F.sqrt(square) * F.col("along") + square
        curve = grid.groupBy("n_types", "subset", "effect").agg(F.avg((moved > F.col("critical")).cast("double")).alias("power"))
        least = P.least_detectable(curve, ["n_types", "subset"], "effect", power)
        cells.append(least.groupBy("n_types").agg(F.median("least").alias("mde")).select(F.lit(n).alias("n_bouts"), "n_types", "mde"))
    out = cells[0]
    for c in cells[1:]:
        out = out.unionByName(c)
    return out


def _digest(*parts: object) -> str:
    import hashlib

    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def dispersion_sensitivity(points: DataFrame, bouts: Sequence[int], folds: Sequence[float] = P.FOLDS, n_draws: int = 400, alpha: float = 0.05, power: float = 0.8, seed: int = 0) -> DataFrame:
    """n_bouts, median_fold, n_types, n_unreachable: the least detectable fold change of each type, summed up."""
    moments = M.bout_moments(points, ["label"])
    out = None
    for n in bouts:
        least = P.least_detectable(P.dispersion_power(moments, ["label"], n, folds, alpha, n_draws, seed), ["label"], "fold", power)
        row = least.agg(F.median("least").alias("median_fold"), F.count(F.lit(1)).alias("n_types"), F.count_if(F.col("least").isNull()).alias("n_unreachable"))
        row = row.where("n_types > 0").select(F.lit(n).alias("n_bouts"), "median_fold", "n_types", "n_unreachable")
        out = row if out is None else out.unionByName(row)
    return out


def fidelity_gate(points: DataFrame, components: int, k: int = 5, seed: int = 0, layout: int | None = None, max_pairs: int | None = 20_000) -> DataFrame:
    """embedder, day, accuracy, purity, silhouette, rho: how raw vectors and principal components keep labels and distances.

    With ``layout``, also a neighbour-graph layout of the components in so many dimensions. ``points``
    has id, label, day and z. Fitted on 70 % of the first day; ``day`` is the first day (its
    other 30 %) and each later day. Purity, silhouette and rho are of the held-out part.
    """
    first = S.reference_day(points.withColumn("_all", F.lit(1)), ["_all"]).first()["reference_day"]
    split = C.train_test(points.where(F.col("day") == F.lit(first)), ["label"], "id", 0.7, seed)
    train, test = (split.where("is_train" if t else "not is_train").select("id", "label", "day", "z") for t in (True, False))
    model = E.fitted_pca(train, components)
    out = None
    embedders = [("raw", lambda df: df), ("pca", lambda df: E.projected(model, df))]
    if layout is not None:
        fit = LO.fitted(E.projected(model, train), layout, seed=seed)
        embedders.append(("layout", lambda df: cut(LO.placed(E.projected(model, df), *fit))))
    for name, embed in embedders:
        z_train, z_test = embed(train), embed(test)
        asked = z_test.unionByName(embed(points.where(F.col("day") > F.lit(first)).select("id", "label", "day", "z")))
        found = FD.knn_recovery(z_train, asked, k).join(asked.select("id", "day"), "id")
        by_day = found.groupBy("day").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))
        with_reference = z_test.join(test.select("id", F.col("z").alias("reference")), "id")
        rho = FD.pair_weighted(FD.within_label_correlation(with_reference, max_pairs, seed))
        row = FD.purity(z_test).crossJoin(FD.silhouette(z_test)).crossJoin(rho)  # one row each
        rows = by_day.crossJoin(F.broadcast(row)).select(F.lit(name).alias("embedder"), "day", "accuracy", "purity", "silhouette", "rho")
        out = rows if out is None else out.unionByName(rows)
    return out
