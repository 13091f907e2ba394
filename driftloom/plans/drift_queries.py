"""Queries on drift between days, on the events and embeddings tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.scalars import rounded
from driftloom.operators import drift as D
from driftloom.operators import fidelity, sessions
from driftloom.operators import moments as M
from driftloom.plans import tables as T
from driftloom.plans.registering import registry
from driftloom.plans.tables import SQL_EVENTS, sql_round

R = sql_round
QUERIES, ORACLES, query = registry()


def _drift(spark: SparkSession, sf_dir: str, how: Column | None = None) -> DataFrame:
    return D.drift_of_points(T.event_points(spark, sf_dir), T.TYPES, "day", how)


def gap_days() -> Column:
    return F.datediff("day_b", "day_a").cast("bigint")


def _variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.variance_of_points(T.event_points(spark, sf_dir), T.SIDE)


SQL_GAP = "(day_b - day_a)::bigint"


@query(f"with {SQL_EVENTS} select event_type, day_a, day_b, {SQL_GAP} as gap_days, {R('drift')} as drift from p")
def centroid_drift_daypairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir).select("event_type", "day_a", "day_b", gap_days().alias("gap_days"), rounded("drift").alias("drift"))


SQL_VECTORS = """
x as (select vec_id, label, vec_id % 10 as bout, unnest(embedding)::double as x, unnest(range(len(embedding))) as dim from embeddings),
xm as (select label, bout, dim, avg(x) as m from x group by all),
xs as (select label, dim, avg(m) as mu, var_samp(m) as v, count(*) as units from xm group by all),
xp as (select a.label as label_a, b.label as label_b, sum((a.mu - b.mu) * (a.mu - b.mu)) as naive,
    sum((a.mu - b.mu) * (a.mu - b.mu) - a.v / a.units - b.v / b.units) as drift
    from xs a join xs b on a.dim = b.dim and a.label < b.label where a.units >= 2 and b.units >= 2 group by all)
"""


@query(f"with {SQL_VECTORS} select label_a, label_b, {R('drift')} as drift from xp")
def centroid_drift_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.drift_of_points(T.vectors(spark, sf_dir), [], "label")
    return found.select("label_a", "label_b", rounded("drift").alias("drift"))


@query(f"with {SQL_VECTORS} select label_a, label_b, {R('naive')} as naive, {R('drift')} as unbiased, {R('naive - drift')} as bias from xp")
def naive_vs_unbiased(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.drift_of_points(T.vectors(spark, sf_dir), [], "label")
    bias = F.col("naive") - F.col("drift")
    return found.select("label_a", "label_b", rounded("naive").alias("naive"), rounded("drift").alias("unbiased"), rounded(bias).alias("bias"))


@query(f"""with {SQL_EVENTS} select a.event_type, a.day as day_a, b.day as day_b, {R('ln(b.tv / a.tv)')} as log_ratio
    from tv a join tv b on a.event_type = b.event_type and a.day < b.day where a.tv > 0 and b.tv > 0""")
def dispersion_drift_daypairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.dispersion_drift(_variances(spark, sf_dir), T.TYPES, "day")
    return found.select("event_type", "day_a", "day_b", rounded("log_ratio").alias("log_ratio"))


SQL_SCALE = "sc as (select coalesce(avg(tv), 1.0::double) as scale from tv where n_rows > 1 and day = (select min(day) from tv))"


@query(f"with {SQL_EVENTS}, {SQL_SCALE} select {R('scale')} as scale from sc")
def within_type_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.within_type_scale(_variances(spark, sf_dir), [], "day").select(rounded("scale").alias("scale"))


def _standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = D.within_type_scale(_variances(spark, sf_dir), [], "day")  # one row
    return _drift(spark, sf_dir).crossJoin(F.broadcast(scale)).withColumn("std", F.col("drift") / F.col("scale"))


@query(f"""with {SQL_EVENTS}, {SQL_SCALE} select {SQL_GAP} as gap_days, count(*)::bigint as n_pairs, {R('avg(drift / scale)')} as mean_drift,
    {R('median(drift / scale)')} as median_drift, {R('min(drift / scale)')} as min_drift, {R('max(drift / scale)')} as max_drift
    from p, sc group by 1""")
def standardised_drift_by_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _standardised(spark, sf_dir).groupBy(gap_days().alias("gap_days")).agg(
        F.count(F.lit(1)).alias("n_pairs"), rounded(F.avg("std")).alias("mean_drift"), rounded(F.median("std")).alias("median_drift"),
        rounded(F.min("std")).alias("min_drift"), rounded(F.max("std")).alias("max_drift"),
    )


@query(f"with {SQL_EVENTS} select day_a, day_b, {R('avg(drift)')} as drift, count(*)::bigint as n_types from p group by all")
def day_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day by day matrix in long form; see ``report.day_matrix`` for the wide one."""
    return _drift(spark, sf_dir).groupBy("day_a", "day_b").agg(rounded(F.avg("drift")).alias("drift"), F.count(F.lit(1)).alias("n_types"))


@query(f"with {SQL_EVENTS} select event_type, day_a, day_b, {R('drift')} as drift from p where day_b - day_a = 1")
def consecutive_day_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring days only: an equi join on the shifted day."""
    units = M.unit_moments(M.bout_means(T.event_moments(spark, sf_dir)), T.SIDE)
    shifted = units.withColumn("_day", F.date_sub("day", 1))
    a = units.select("event_type", "dim", F.col("day").alias("_day"), F.col("day").alias("day_a"), *[F.col(c).alias(f"{c}_a") for c in ("mu", "v", "units")])
    b = shifted.select("event_type", "dim", "_day", F.col("day").alias("day_b"), *[F.col(c).alias(f"{c}_b") for c in ("mu", "v", "units")])
    pairs = a.join(b, ["event_type", "dim", "_day"]).where("units_a >= 2 and units_b >= 2")
    gap = F.col("mu_a") - F.col("mu_b")
    term = gap * gap - F.col("v_a") / F.col("units_a") - F.col("v_b") / F.col("units_b")
    return pairs.groupBy("event_type", "day_a", "day_b").agg(rounded(F.sum(term)).alias("drift"))


@query(f"with {SQL_EVENTS} select event_type, day_a, day_b, {R('drift')} as drift from p where day_b - day_a between 1 and 10")
def band_day_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _drift(spark, sf_dir, F.datediff("day_b", "day_a").between(1, 10))
    return found.select("event_type", "day_a", "day_b", rounded("drift").alias("drift"))


@query(f"""with {SQL_EVENTS}, first5 as (select day from (select distinct day from e) order by day limit 5),
    rm as (select event_type, user_id as bout, avg(value) as m from e semi join first5 using (day) group by all),
    r as (select event_type, avg(m) as mu, var_samp(m) as v, count(*) as units from rm group by all)
    select s.event_type, s.day, {R('(s.mu - r.mu) * (s.mu - r.mu) - s.v / s.units - r.v / r.units')} as drift
    from s join r using (event_type) anti join first5 using (day)""")
def distance_to_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every later day against the first five days pooled."""
    points = T.event_points(spark, sf_dir)
    first = points.select("day").distinct().orderBy("day").limit(5)
    pooled = points.join(F.broadcast(first), "day", "left_semi").select("event_type", "bout", "z")
    reference = M.unit_moments(M.bout_means(M.bout_moments(pooled, T.TYPES)), T.TYPES)
    later = M.unit_moments(M.bout_means(T.event_moments(spark, sf_dir)), T.SIDE).join(F.broadcast(first), "day", "left_anti")
    both = later.join(reference.select("event_type", "dim", *[F.col(c).alias(f"r_{c}") for c in ("mu", "v", "units")]), ["event_type", "dim"])
    gap = F.col("mu") - F.col("r_mu")
    term = gap * gap - F.col("v") / F.col("units") - F.col("r_v") / F.col("r_units")
    return both.where("units >= 2 and r_units >= 2").groupBy("event_type", "day").agg(rounded(F.sum(term)).alias("drift"))


@query(f"""with u0 as (select user_id % 8 as unit, event_type, ts::date as day, user_id as bout, value from events),
    u as (select * from u0 semi join (select unit, event_type, day from u0 group by all having count(*) >= 5 and count(distinct bout) >= 2) using (unit, event_type, day)),
    um as (select unit, event_type, day, bout, avg(value) as m from u group by all),
    us as (select unit, event_type, day, avg(m) as mu, var_samp(m) as v, count(*) as units from um group by all),
    ud as (select a.unit, a.day as day_a, b.day as day_b, avg((a.mu - b.mu) * (a.mu - b.mu) - a.v / a.units - b.v / b.units) as drift
        from us a join us b on a.unit = b.unit and a.event_type = b.event_type and a.day < b.day group by all)
    select unit, {R('max(drift)')} as max_drift, {R('median(drift)')} as median_drift, count(*)::bigint as n_pairs from ud group by unit""")
def per_unit_max_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of eight units of users, the largest and the median drift of its day pairs."""
    found = unit_drift(spark, sf_dir)
    return found.groupBy("unit").agg(
        rounded(F.max("drift")).alias("max_drift"), rounded(F.median("drift")).alias("median_drift"), F.count(F.lit(1)).alias("n_pairs")
    )


def unit_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit (user_id % 8), day_a, day_b, drift averaged over the types."""
    rows = T.events(spark, sf_dir).withColumn("unit", F.col("user_id") % 8)
    points = D.supported_sides(M.points(rows, ["unit", *T.SIDE], "user_id", "value"), ["unit", *T.SIDE], 5, 2)
    found = D.drift_of_points(points, ["unit", "event_type"], "day")
    return found.groupBy("unit", "day_a", "day_b").agg(F.avg("drift").alias("drift"))


@query(f"""with {SQL_EVENTS}, d as (select a.event_type, a.day as day_a, b.day as day_b, abs(ln(b.tv / a.tv)) as disp
        from tv a join tv b on a.event_type = b.event_type and a.day < b.day where a.tv > 0 and b.tv > 0),
    j as (select round(drift, 6) as x, round(disp, 6) as y from p join d using (event_type, day_a, day_b)),
    rk as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx,
        rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from j)
    select count(*)::bigint as n, {R('corr(rx, ry)')} as rho from rk""")
def metric_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of centroid drift and of the size of dispersion drift over all day pairs."""
    points = T.event_points(spark, sf_dir)
    centroid = D.drift_of_points(points, T.TYPES, "day").select("event_type", "day_a", "day_b", F.round("drift", 6).alias("x"))
    spread = D.dispersion_drift(D.variance_of_points(points, T.SIDE), T.TYPES, "day")
    both = centroid.join(spread, ["event_type", "day_a", "day_b"]).select("x", F.round(F.abs("log_ratio"), 6).alias("y"))
    return fidelity.spearman(both, "x", "y").select("n", rounded("rho").alias("rho"))


@query(f"""with m as (select label, vec_id, unnest(embedding)::double as x, unnest(range(len(embedding))) as dim from embeddings),
    c as (select label, dim, avg(x) as c from m group by all),
    d as (select label, vec_id, round(sqrt(sum((x - c) * (x - c))), 9) as dist from m join c using (label, dim) group by all),
    k as (select label, vec_id from (select *, row_number() over (partition by label order by dist, vec_id) as r,
        greatest(floor(count(*) over (partition by label) * 0.25), 10) as most from d) where r <= most),
    v as (select label, dim, var_samp(x) as v, count(*) as n from m semi join k using (label, vec_id) group by all)
    select label, max(n)::bigint as n_rows, {R('sum(v)')} as total_variance from v group by label""")
def matched_fraction_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total variance of the quarter of each label's vectors (ten at least) that is nearest to its centre."""
    rows = T.vectors(spark, sf_dir)
    away = M.centred(rows, ["label"])
    square = F.aggregate("z", F.lit(0.0), lambda t, x: t + x * x)
    away = away.select("label", "vec_id", F.round(F.sqrt(square), 9).alias("dist"))
    near = sessions.nearest_share(away, ["label"], "dist", "vec_id", 0.25, 10).select("label", "vec_id")
    found = D.variance_of_points(rows.join(near, ["label", "vec_id"], "left_semi"), ["label"])
    return found.select("label", "n_rows", rounded("tv").alias("total_variance"))


@query(f"""with t0 as (select user_id, min(ts)::date as t0 from events where event_type = 'signup' group by user_id),
    x as (select e.user_id, e.ts::date as day, e.value, t0 from events e join t0 using (user_id)),
    base as (select user_id, avg(value) as baseline, count(*) as n from x where day < t0 group by user_id having count(*) >= 2),
    post as (select user_id, day, avg(value) as m from x where day > t0 group by all)
    select user_id, {R('any_value(baseline)')} as baseline, count(*)::bigint as n_days, {R('max(abs(m - baseline))')} as max_change,
        min(day) filter (where abs(m - baseline) > 50) as first_crossing
    from post join base using (user_id) group by user_id""")
def pre_post_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user before and after the day of the first signup, which itself is left out."""
    rows = T.events(spark, sf_dir)
    marker = rows.where("event_type = 'signup'").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("t0"))
    rows = rows.join(marker, "user_id")
    base = M.ordered_means(rows.where("day < t0"), ["user_id"], "value", ["event_id"], "baseline").where("n >= 2")
    post = M.ordered_means(rows.where("day > t0"), ["user_id", "day"], "value", ["event_id"], "m").drop("n")
    change = F.abs(F.col("m") - F.col("baseline"))
    return post.join(base, "user_id").groupBy("user_id").agg(
        rounded(F.first("baseline")).alias("baseline"), F.count(F.lit(1)).alias("n_days"), rounded(F.max(change)).alias("max_change"),
        F.min(F.when(change > 50, F.col("day"))).alias("first_crossing"),
    )


@query(f"""with r as (select user_id % 8 as unit, user_id, avg(value) as m, min(ts::date) as first_day from events group by all)
    select unit, {R('avg(m)')} as mean_value, min(first_day) as first_day, count(*)::bigint as n_recordings from r group by unit""")
def merge_per_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several recordings of a unit count as one value: the mean of their means."""
    rows = T.events(spark, sf_dir).withColumn("unit", F.col("user_id") % 8)
    each = rows.groupBy("unit", "user_id").agg(F.avg("value").alias("m"), F.min("day").alias("first_day"))
    return each.groupBy("unit").agg(rounded(F.avg("m")).alias("mean_value"), F.min("first_day").alias("first_day"), F.count(F.lit(1)).alias("n_recordings"))


@query()
def pca_embedding_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift between labels in the first 16 principal components, fitted on label 0 only."""
    from driftloom.operators.embedding import fitted_pca, projected

    rows = T.vectors(spark, sf_dir)
    model = fitted_pca(rows.where("label = 0"), 16)
    found = D.drift_of_points(projected(model, rows), [], "label")
    return found.select("label_a", "label_b", rounded("drift").alias("drift"))
