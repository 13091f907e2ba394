"""Queries for the studies with one result each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.lineage import cut
from driftloom.functions.scalars import rounded
from driftloom.plans import composites
from driftloom.plans import tables as T
from driftloom.plans.recordings import recorded_turns
from driftloom.plans.registering import registry
from driftloom.plans.resampling_queries import N_DRAWS, SQL_CENTROID_NULL, SQL_DISPERSION_NULL, SQL_EVENTS
from driftloom.plans.study_queries import EARLY, LATE, labelled_events
from driftloom.plans.tables import sql_round

X = sql_round
QUERIES, ORACLES, query = registry()


def _sql_sections(null: str, pairs: str) -> str:
    return f"""nx as (select {null}), px as (select {pairs}), fx as (select quantile_cont(x, 0.95) as floor from nx)
    select 'null' as section, null::int as separation, count(*)::bigint as n, {X('avg(x)')} as mean, {X('quantile_cont(x, 0.95)')} as p95, {X('avg((x < 0)::int)')} as share from nx
    union all select 'pairs', separation, count(*)::bigint, {X('avg(x)')}, {X('quantile_cont(x, 0.95)')}, {X('avg((x > floor)::int)')} from px, fx group by separation"""


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("section", "separation", "n", *[rounded(c).alias(c) for c in ("mean", "p95", "share")])


@query(f"""with {SQL_EVENTS}, {SQL_CENTROID_NULL}, {_sql_sections('drift as x from cn', '(day_b - day_a)::int as separation, drift as x from p')}""")
def noise_floor_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroid drift of all day pairs by separation beside its noise floor."""
    return _rounded(composites.centroid_study(cut(T.event_moments(spark, sf_dir)), T.TYPES, N_DRAWS))


@query(f"""with {SQL_EVENTS}, {SQL_DISPERSION_NULL}, {_sql_sections('abs(log_ratio) as x from dn',
    '(b.day - a.day)::int as separation, abs(ln(b.tv / a.tv)) as x from tv a join tv b on a.event_type = b.event_type and a.day < b.day where a.tv > 0 and b.tv > 0')}""")
def dispersion_floor_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variances' log ratio of all day pairs by separation beside its noise floor."""
    return _rounded(composites.dispersion_study(cut(T.event_moments(spark, sf_dir)), T.TYPES, N_DRAWS))


@query(f"""with e as (select event_type as label, ts::date as day, user_id as bout, value from events),
    bm as (select label, day, bout, avg(value) as m from e group by all),
    us as (select label, day, avg(m) as mu, var_samp(m) as v, count(*) as units from bm group by all having count(*) >= 2),
    pr as (select b.day - a.day as gap, (a.mu - b.mu) * (a.mu - b.mu) - a.v / a.units - b.v / b.units as drift from us a join us b on a.label = b.label and a.day < b.day),
    rm as (select label, bout, avg(value) as m from e where day >= date '{LATE[0]}' group by all),
    r as (select label, avg(m) as mu, var_samp(m) as v, count(*) as units from rm group by label),
    k as (select day, avg((d.mu - r.mu) * (d.mu - r.mu) - d.v / d.units - r.v / r.units) as drift from us d join r using (label) where day < date '{LATE[0]}' group by day),
    t as (select (day - date '1970-01-01')::double as t, drift from k),
    rk as (select rank() over (order by t)::double as a, rank() over (order by round(drift, 9)) + (count(*) over (partition by round(drift, 9)) - 1) / 2.0 as b from t)
    select 'consecutive' as measure, count(*)::bigint as n, {X('avg(drift)')} as value from pr where gap = 1
    union all select 'week_or_more', count(*)::bigint, {X('avg(drift)')} from pr where gap >= 7
    union all select 'rho', (select count(*) from t)::bigint, {X('(select corr(a, b) from rk)')}
    union all select 'slope', (select count(*) from t)::bigint, {X('(select covar_pop(drift, t) / var_pop(t) from t)')}""")
def development_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive days, distant days, and whether days come nearer to the last nine."""
    found = composites.development(labelled_events(spark, sf_dir), F.col("day") >= F.lit(LATE[0]))
    return found.select("measure", "n", rounded("value").alias("value"))


@query(f"""with {SQL_EVENTS}, {SQL_DISPERSION_NULL}, w as (select event_type as label, value, case when ts::date between date '{EARLY[0]}' and date '{EARLY[1]}' then 'e'
        when ts::date between date '{LATE[0]}' and date '{LATE[1]}' then 'l' end as side from events),
    v as (select label, count(*) filter (side = 'e') as n_early, count(*) filter (side = 'l') as n_late,
        ln(var_samp(value) filter (side = 'e') / var_samp(value) filter (side = 'l')) as log_ratio from w group by label),
    fl as (select event_type as label, quantile_cont(abs(log_ratio), 0.95) as floor from dn group by event_type)
    select label, n_early::bigint as n_early, n_late::bigint as n_late, {X('log_ratio')} as log_ratio, {X('floor')} as floor, abs(log_ratio) > floor as over
    from v left join fl using (label) where n_early >= 20 and n_late >= 20""")
def windows_over_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type's early over late dispersion, held against the halves of its days."""
    found = composites.windows_over_floors(labelled_events(spark, sf_dir), EARLY, LATE, 20, N_DRAWS)
    return found.select("label", "n_early", "n_late", rounded("log_ratio").alias("log_ratio"), rounded("floor").alias("floor"), "over")


@query("""with e as (select event_id, event_type as label, ts::date as day from events), c as (select label, count(*) as n from e group by label),
    k as (select *, row_number() over (partition by day, label order by md5(concat_ws(':', '0', event_id::varchar)), event_id) as r
        from e semi join (select label from c where n >= 2000 and label <> 'error') using (label)),
    s as (select label, count(*) as n_kept, count(distinct day) as n_days from k where r <= 40 group by label)
    select label, n::bigint as n, coalesce(n_kept, 0)::bigint as n_kept, coalesce(n_days, 0)::bigint as n_days,
    case when label = 'error' then 'excluded' when n_kept is null then 'rare' else 'kept' end as why from c left join s using (label)""")
def rendition_set_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of events: no errors, labels of 2,000 events or more, 40 of each label and day; what each label kept and why."""
    rows = T.events(spark, sf_dir).withColumn("label", F.col("event_type"))
    return composites.rendition_set(rows, "label", "day", "event_id", ["error"], 2000, 40)[1]



@query("""select (conv_id % 5)::int as day, count(*)::bigint as n_true, count(*)::bigint as n_pred, count(*)::bigint as n_matched, 1.0::double as f1
    from conversations where conv_id % 5 > 0 group by 1""")
def segmentation_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold tuned on the first pseudo-day's recordings finds every turn of the other days, and nothing else."""
    found = composites.segmentation_evaluation(*recorded_turns(spark, sf_dir), (0.001, 0.2, 0.5))
    return found.select("day", "n_true", "n_pred", "n_matched", rounded("f1").alias("f1"))
