"""Queries for the composite studies."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.scalars import rounded
from driftloom.operators import embedding as E
from driftloom.operators import moments as M
from driftloom.operators import power as P
from driftloom.operators import resampling as R
from driftloom.plans import studies
from driftloom.plans import tables as T
from driftloom.plans.registering import registry
from driftloom.plans.tables import sql_round

X = sql_round
QUERIES, ORACLES, query = registry()
BOUTS = (5, 10, 20)
EARLY = (dt.date(2024, 1, 1), dt.date(2024, 1, 8))
LATE = (dt.date(2024, 1, 22), dt.date(2024, 1, 30))


def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label (the type), day, bout (the user), z."""
    return M.points(T.events(spark, sf_dir).withColumn("label", F.col("event_type")), ["label", "day"], "user_id", "value")


@query(f"""with w as (select event_type as label, value, case when ts::date between date '{EARLY[0]}' and date '{EARLY[1]}' then 'e'
        when ts::date between date '{LATE[0]}' and date '{LATE[1]}' then 'l' end as side from events),
    v as (select label, count(*) filter (side = 'e') as n_early, count(*) filter (side = 'l') as n_late,
        var_samp(value) filter (side = 'e') as ve, var_samp(value) filter (side = 'l') as vl from w group by label)
    select label, n_early::bigint as n_early, n_late::bigint as n_late, {X('ln(ve / vl)')} as log_ratio from v where n_early >= 20 and n_late >= 20""")
def window_variance_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispersion of each type in the first eight days over that in the last nine."""
    found = studies.window_ratios(labelled_events(spark, sf_dir), EARLY, LATE, 20)
    return found.select("label", "n_early", "n_late", rounded("log_ratio").alias("log_ratio"))


@query(f"""with e as (select event_type as label, ts::date as day, user_id as bout, value from events),
    rm as (select label, bout, avg(value) as m from e where day >= date '{LATE[0]}' group by all),
    r as (select label, avg(m) as mu, var_samp(m) as v, count(*) as units from rm group by label),
    dm as (select label, day, bout, avg(value) as m from e where day < date '{LATE[0]}' group by all),
    d as (select label, day, avg(m) as mu, var_samp(m) as v, count(*) as units from dm group by all having count(*) >= 2),
    k as (select day, avg((d.mu - r.mu) * (d.mu - r.mu) - d.v / d.units - r.v / r.units) as drift from d join r using (label) group by day),
    t as (select (day - date '1970-01-01')::double as t, drift from k),
    rk as (select rank() over (order by t)::double as a, rank() over (order by round(drift, 9)) + (count(*) over (partition by round(drift, 9)) - 1) / 2.0 as b from t)
    select (select count(*) from t)::bigint as n, {X('(select corr(a, b) from rk)')} as rho, {X('(select covar_pop(drift, t) / var_pop(t) from t)')} as slope""")
def reference_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the days before the last nine come nearer to them: rank correlation and slope over days."""
    points = labelled_events(spark, sf_dir)
    late = F.col("day") >= F.lit(LATE[0])
    found = studies.convergence(studies.distances_to_reference(points.where(~late), points.where(late)))
    return found.select("n", rounded("rho").alias("rho"), rounded("slope").alias("slope"))


@query()
def matched_fraction_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance near the modes of the last pseudo-day, by fraction of rows kept and by pseudo-day."""
    rows = T.vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), (F.col("vec_id") % 5).alias("day"), "z")
    centres = E.modes(rows.where("day = 4"), 3, "id")
    found = studies.matched_fractions(rows, centres, (0.25, 0.5, 1.0), cluster_rows=10, least=5)
    return found.select("fraction", "day", rounded("variance").alias("variance"))


@query()
def manipulation_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as recordings of eight birds, the first signup after five days as event: drift per bird against its floor."""
    rows = T.events(spark, sf_dir)
    marker = rows.where("event_type = 'signup' and day > date '2024-01-06'").groupBy((F.col("user_id") % 40).alias("recording")).agg(F.min("day").alias("t0"))
    keyed = rows.withColumns({"recording": F.col("user_id") % 40, "bird": F.col("user_id") % 8})
    points = M.points(keyed, ["bird", "recording", "day"], "user_id", "value")
    _, birds = studies.manipulation(points, marker, 4, 4, 3)
    numbers = ["centroid_floor", "dispersion_floor", "control_median", "post_max", "dispersion_max", "ratio"]
    return birds.select("bird", "n_recordings", "first_day_over_floor", *[rounded(c).alias(c) for c in numbers])


TYPE_COUNTS, SCALE, EFFECTS = (1, 3, 5), 2000.0, (0.05, 0.1, 0.5, 1.0, 2.0)


def _sql_least_effects(n: int, draws: int = 400, scale: float = SCALE) -> str:
    """least_{n}: for each number of types and subset of them the least effect that ``n`` bouts a side would show."""
    parts = []
    for name, seed in (("nl", R.NULL_SEED), ("al", 0)):
        p = f"{name}{n}"
        parts.append(f"""
{p}_k as (select * from (select bout, count(*) over () as nb from un) where nb >= {2 * n}),{T.sql_hashed(p + "_h", p + "_k", "bout::varchar", seed, draws)},
{p}_r as (select draw, bout, row_number() over (partition by draw order by h1, h2, bout) as r from {p}_h),
{p}_c as (select distinct dim from bm),{T.sql_hashed(p + "_w", p + "_c", "'direction', dim::varchar", seed, draws)},
{p}_g as (select label, draw, dim, avg(m) filter (r <= {n}) - avg(m) filter (r > {n}) as gap,
    var_samp(m) filter (r <= {n}) / count(*) filter (r <= {n}) + var_samp(m) filter (r > {n}) / count(*) filter (r > {n}) as noise
    from {p}_r join bm using (bout) where r <= {2 * n} group by all having count(*) filter (r <= {n}) >= 2 and count(*) filter (r > {n}) >= 2),
{p}_u as (select {p}_g.*, sqrt(-2 * ln((h1 + 1) / 4294967296.0)) * cos(2 * pi() * (h2 / 4294967296.0)) as u from {p}_g join {p}_w using (draw, dim)),
{p}_l as (select label, draw, sum(gap * gap - noise) as drift, sum(gap * u) / sqrt(sum(u * u)) as along from {p}_u group by all),
{p} as (select n_types, subset, draw, avg(drift) as drift, avg(along) as along from {p}_l join ch using (label) group by all)""")
    return f"""{",".join(parts)},
cr{n} as (select n_types, subset, quantile_cont(drift, 0.95) as critical from nl{n} group by all),
pw{n} as (select n_types, subset, effect, avg((drift - 2 * sqrt(effect * {scale}) * along + effect * {scale} > critical)::int) as power
    from al{n} join cr{n} using (n_types, subset), gr group by all),
least{n} as (select n_types, subset, min(effect) filter (power >= 0.8) as least from pw{n} group by all)"""


def _sql_sensitivity(rows: str, label: str, bouts: tuple, counts: tuple, effects: tuple, scale: float) -> str:
    """The table of least effects; ``rows`` defines bm (label, bout, dim, m)."""
    union = " union all ".join(f"select {n}::int as n_bouts, n_types, median(least) as mde from least{n} group by n_types" for n in bouts)
    return f"""with {rows},
    un as (select distinct bout from bm), la as (select label, count(*) over () as all_types from (select distinct label from bm)),
    ch as (select k::int as n_types, subset, label from (select k, subset, label, all_types, row_number() over (partition by k, subset
        order by md5(concat_ws(':', '0', k::varchar, subset::varchar, {label})), label) as r from la, (values {", ".join(f"({k})" for k in counts)}) v(k), range(0, 5) t(subset))
        where r <= k and (subset = 0 or k < all_types)),
    gr as (select unnest([{", ".join(f"{x}::double" for x in effects)}]) as effect), {", ".join(_sql_least_effects(n, scale=scale) for n in bouts)} {union}"""


SQL_ROWS = "e as (select event_type as label, user_id as bout, value from events), bm as (select label, bout, 0 as dim, avg(value) as m from e group by all)"


@query(_sql_sensitivity(SQL_ROWS, "label", BOUTS, TYPE_COUNTS, EFFECTS, SCALE))
def sensitivity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least detectable effect by bouts per side and types averaged."""
    return studies.sensitivity(labelled_events(spark, sf_dir), BOUTS, TYPE_COUNTS, SCALE, EFFECTS)


VECTOR_BOUTS, VECTOR_COUNTS, VECTOR_SCALE, VECTOR_EFFECTS = (4, 8), (1, 4, 10), 64.0, (0.001, 0.005, 0.01, 0.05, 0.1, 0.2, 0.5)
SQL_VECTOR_ROWS = """x as (select label, vec_id % 20 as bout, unnest(embedding)::double as x, unnest(range(len(embedding))) as dim from embeddings),
    bm as (select label, bout, dim::int as dim, avg(x) as m from x group by all)"""


@query(_sql_sensitivity(SQL_VECTOR_ROWS, "label::varchar", VECTOR_BOUTS, VECTOR_COUNTS, VECTOR_EFFECTS, VECTOR_SCALE))
def sensitivity_table_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the labels' vectors: displacements along random directions of 64 dimensions."""
    points = T.vectors(spark, sf_dir).select("label", (F.col("vec_id") % 20).alias("bout"), "z")
    return studies.sensitivity(points, VECTOR_BOUTS, VECTOR_COUNTS, VECTOR_SCALE, VECTOR_EFFECTS)


def _sql_least_folds(n: int, draws: int = 400) -> str:
    """least_{n}: per label the least fold change that ``n`` bouts a side would show."""
    parts = []
    for name, seed in (("nl", R.NULL_SEED), ("al", 0)):
        p = f"{name}{n}"
        parts.append(f"""
{p}_k as (select * from un where nb >= {2 * n}),{T.sql_hashed(p + "_h", p + "_k", "label, bout::varchar", seed, draws)},
{p}_r as (select label, draw, bout, row_number() over (partition by label, draw order by h1, h2, bout) as r from {p}_h),
{p}_v as (select label, draw, var_samp(value) filter (r <= {n}) as a, var_samp(value) filter (r > {n}) as b from {p}_r join e using (label, bout) where r <= {2 * n} group by all),
{p} as (select label, draw, ln(b / a) as x from {p}_v where a > 0 and b > 0)""")
    return f"""{",".join(parts)},
cr{n} as (select label, quantile_cont(abs(x), 0.95) as critical from nl{n} group by all),
pw{n} as (select label, fold, avg((abs(x + ln(fold)) > critical)::int) as power from al{n} join cr{n} using (label), gr group by all),
least{n} as (select label, min(fold) filter (power >= 0.8) as least from pw{n} group by label)"""


SQL_TABLE = " union all ".join(
    f"select {n}::int as n_bouts, median(least) as median_fold, count(*)::bigint as n_types, count(*) filter (least is null)::bigint as n_unreachable from least{n} having count(*) > 0"
    for n in BOUTS
)


@query(f"""with e as (select event_type as label, user_id as bout, value from events), un as (select label, bout, count(*) over (partition by label) as nb from (select distinct label, bout from e)),
    gr as (select unnest([{", ".join(f"{f}::double" for f in P.FOLDS)}]) as fold), {", ".join(map(_sql_least_folds, BOUTS))} {SQL_TABLE}""")
def dispersion_sensitivity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.dispersion_sensitivity(labelled_events(spark, sf_dir), BOUTS)


@query()
def fidelity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw vectors, 16 principal components and their layout in 8 dimensions side by side, fitted on the first pseudo-day; rho over all pairs."""
    rows = T.vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "label", (F.col("vec_id") % 5).alias("day"), "z")
    found = studies.fidelity_gate(rows, 16, layout=8, max_pairs=None)
    return found.select("embedder", "day", *[rounded(c, 4).alias(c) for c in ("accuracy", "purity", "silhouette", "rho")])
