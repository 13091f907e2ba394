"""Draws over vectors of 64 dimensions: floors, intervals and power of the labels' clouds, and other small queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.lineage import cut
from driftloom.functions.scalars import rounded
from driftloom.operators import clean as C
from driftloom.operators import drift as D
from driftloom.operators import matching as MT
from driftloom.operators import moments as M
from driftloom.operators import power as P
from driftloom.operators import resampling as R
from driftloom.plans import studies
from driftloom.plans import tables as T
from driftloom.plans.drift_queries import SQL_VECTORS
from driftloom.plans.registering import registry
from driftloom.plans.resampling_queries import N_BOOT, N_DRAWS, POWER_DRAWS, sql_halves
from driftloom.plans.tables import sql_hashed, sql_round

X = sql_round
QUERIES, ORACLES, query = registry()
LABEL = ["label"]
N_BOUTS, SCALE, EFFECTS = 4, 64.0, (0.01, 0.05, 0.1, 0.2, 0.5)


def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(M.bout_moments(T.vectors(spark, sf_dir), LABEL))


def _sql_gaps(chosen: str, extra: str = "") -> str:
    """Per label, draw and dimension of the ``chosen`` bouts: the gap, the two noises."""
    return f"""select label, draw, dim, avg(m) filter (is_left) - avg(m) filter (not is_left) as gap,
    var_samp(m) filter (is_left) / count(*) filter (is_left) + var_samp(m) filter (not is_left) / count(*) filter (not is_left) as noise{extra}
    from {chosen} join xm using (label, bout) group by label, draw, dim having count(*) filter (is_left) >= 2 and count(*) filter (not is_left) >= 2"""


@query(f"""with {SQL_VECTORS}, {sql_halves('h', 'label', N_DRAWS, source='xm')}, g as ({_sql_gaps('h')}),
    n as (select label, draw, sum(gap * gap - noise) as drift from g group by all)
    select label, count(*)::bigint as n_draws, {X('quantile_cont(drift, 0.95)', 5)} as floor, {X('avg((drift < 0)::int)')} as share_negative from n group by label""")
def split_half_floor_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroid noise floor of each label's vectors, in all dimensions."""
    null = R.centroid_null(M.bout_means(_moments(spark, sf_dir)), LABEL, N_DRAWS)
    return null.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_draws"), rounded(F.percentile("drift", F.lit(0.95)), 5).alias("floor"),
        rounded(F.avg((F.col("drift") < 0).cast("double"))).alias("share_negative"),
    )


@query(f"""with {SQL_VECTORS}, {sql_halves('h', 'label', N_DRAWS, source='xm')},
    v as (select label, draw, dim, var_samp(x) filter (is_left) as a, var_samp(x) filter (not is_left) as b from h join x using (label, bout) group by all),
    t as (select label, draw, ln(sum(b) / sum(a)) as log_ratio from v group by all)
    select label, count(*)::bigint as n_draws, {X('quantile_cont(abs(log_ratio), 0.95)')} as floor from t group by label""")
def dispersion_floor_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.floor_of(R.dispersion_null(_moments(spark, sf_dir), LABEL, N_DRAWS), LABEL, "log_ratio", absolute=True)
    return found.select("label", "n_draws", rounded("floor").alias("floor"))


SQL_RESAMPLED = f"""
rn as (select label, bout, count(*) over w as nb, row_number() over (w order by bout) - 1 as i from (select distinct label, bout from xm) window w as (partition by label)),
{sql_hashed("rh", "rn", "label::varchar, i::varchar", 0, N_BOOT)},
rs as (select label, draw, h1 % nb as i from rh),
rw as (select rs.label, draw, bout, count(*) as w from rs join rn using (label, i) group by all)"""


@query(f"""with {SQL_VECTORS}, {SQL_RESAMPLED},
    bs as (select label, draw, dim, count(*) as n, avg(m) as mu, var_samp(m) as v from rw join xm using (label, bout) group by all having count(*) >= 2),
    bd as (select a.label as label_a, b.label as label_b, a.draw, sum((a.mu - b.mu) * (a.mu - b.mu) - a.v / a.n - b.v / b.n) as d
        from bs a join bs b on a.label < b.label and a.draw = b.draw and a.dim = b.dim group by all),
    bi as (select label_a, label_b, quantile_cont(d, 0.025) as low, quantile_cont(d, 0.975) as high from bd group by all)
    select label_a, label_b, {X('drift', 5)} as drift, {X('low', 5)} as low, {X('high', 5)} as high from xp join bi using (label_a, label_b)""")
def bootstrap_ci_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the distance of every two labels, in all dimensions; a bout drawn twice counts once."""
    means = M.bout_means(_moments(spark, sf_dir))
    drift = cut(D.centroid_drift(M.unit_moments(means, LABEL), [], "label"))
    keys = ["label_a", "label_b"]
    found = drift.join(R.centroid_interval(means, [], "label", drift.select(*keys), N_BOOT), keys)
    return found.select(*keys, *[rounded(c, 5).alias(c) for c in ("drift", "low", "high")])


def _sql_directed(name: str, seed: int) -> str:
    return f"""
{name}_n as (select *, count(*) over (partition by label) as nb from (select distinct label, bout from xm)),
{name}_k as (select * from {name}_n where nb >= {2 * N_BOUTS}),{sql_hashed(name + "_h", name + "_k", "label::varchar, bout::varchar", seed, POWER_DRAWS)},
{name}_r as (select label, draw, bout, row_number() over (partition by label, draw order by h1, h2, bout) as r from {name}_h),
{name}_c as (select distinct label, dim from xm),{sql_hashed(name + "_w", name + "_c", "label::varchar, 'direction', dim::varchar", seed, POWER_DRAWS)},
{name}_s as (select *, r <= {N_BOUTS} as is_left from {name}_r where r <= {2 * N_BOUTS}),
{name}_g as ({_sql_gaps(name + '_s')}),
{name}_u as (select {name}_g.*, sqrt(-2 * ln((h1 + 1) / 4294967296.0)) * cos(2 * pi() * (h2 / 4294967296.0)) as u from {name}_g join {name}_w using (label, draw, dim)),
{name} as (select label, draw, sum(gap * gap - noise) as drift, sum(gap * u) / sqrt(sum(u * u)) as along from {name}_u group by all)"""


@query(f"""with {SQL_VECTORS}, {_sql_directed('nl', R.NULL_SEED)}, {_sql_directed('al', 0)},
    cr as (select label, quantile_cont(drift, 0.95) as critical from nl group by all),
    gr as (select unnest([{", ".join(f"{e}::double" for e in EFFECTS)}]) as effect)
    select label, effect, {X(f'avg((drift - 2 * sqrt(effect * {SCALE}) * along + effect * {SCALE} > critical)::int)')} as power
    from al join cr using (label), gr group by label, effect""")
def power_curve_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a displacement along a random direction of all dimensions would show, by its size."""
    means = M.bout_means(_moments(spark, sf_dir))
    found = P.centroid_power(means, LABEL, N_BOUTS, SCALE, EFFECTS, n_draws=POWER_DRAWS)
    return found.select("label", "effect", rounded("power").alias("power"))


@query(f"""with e as (select user_id % 8 as bird, event_type as label, ts::date as day from events),
    n as (select bird, label, count(*) as n, count(distinct day) as n_days, min(day) as first_day from e group by all)
    select bird, label, n::bigint as n, n_days::bigint as n_days, first_day, {X('n / sum(n) over (partition by bird)')} as share,
    rank() over (partition by bird order by n desc, label)::int as place from n""")
def label_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of each individual: how many, on how many days, since when, and which share of all."""
    rows = T.events(spark, sf_dir).select((F.col("user_id") % 8).alias("bird"), F.col("event_type").alias("label"), "day")
    found = C.label_inventory(rows, ["bird"], "label", "day")
    return found.select("bird", "label", "n", "n_days", "first_day", rounded("share").alias("share"), "place")


@query(f"""with c as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn) as k from conversations),
    z as (select a.conv_id, a.role as t, b.role as p from c a join c b on b.conv_id = a.conv_id + 1 and a.k = b.k)
    select conv_id, count(*)::bigint as n, {X('avg((t = p)::int)')} as accuracy from z group by conv_id""")
def sequence_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles of each conversation against those of the next, place by place, as far as the shorter goes."""
    turns = T.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    after = turns.withColumn("conv_id", F.col("conv_id") - 1)
    found = MT.zipped(turns, after, ["conv_id"], "turn", "role").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg((F.col("true_label") == F.col("predicted_label")).cast("double"))).alias("accuracy")
    )
    return found


FRACTIONS = (0.25, 0.5, 1.0)


@query(f"""with x as (select vec_id, vec_id % 5 as day, label, unnest(embedding)::double as x, unnest(range(len(embedding))) as dim from embeddings),
    c as (select label as i, dim, round(avg(x), 6) as c from x where label < 3 group by all),
    d as (select vec_id, day, i, sum((x - c) * (x - c)) as d2 from x join c using (dim) group by all),
    m as (select vec_id, day, arg_min(i, (d2, i)) as mode, min(d2) as d2 from d group by all),
    b as (select *, count(*) over (partition by day, mode) as n, row_number() over (partition by day, mode order by sqrt(d2), vec_id) as r from m),
    k as (select fraction, b.* from b, (select unnest([{", ".join(f"{f}::double" for f in FRACTIONS)}]) as fraction) where n >= 10 and r <= greatest(floor(n * fraction), 5)),
    v as (select fraction, k.day, mode, dim, var_samp(x) as v from k join x using (vec_id) group by all),
    t as (select fraction, day, mode, sum(v) as tv from v group by all)
    select fraction, day, {X('avg(tv)')} as variance from t group by all""")
def matched_fraction_given_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance of the rows nearest to each of three given centres (means of labels), by fraction kept and pseudo-day."""
    rows = T.vectors(spark, sf_dir)
    means = rows.where("label < 3").select("label", F.posexplode("z").alias("dim", "x")).groupBy("label", "dim").agg(F.round(F.avg("x"), 6).alias("c"))
    found = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("dim", "c"))).alias("c")).orderBy("label").collect()  # three rows
    centres = [[x["c"] for x in r["c"]] for r in found]
    points = rows.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 5).alias("day"), "z")
    fractions = studies.matched_fractions(points, centres, FRACTIONS, cluster_rows=10, least=5)
    return fractions.select("fraction", "day", rounded("variance").alias("variance"))
