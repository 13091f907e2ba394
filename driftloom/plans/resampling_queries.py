"""Queries on noise floors, intervals, power and group tests, all drawn with portable hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.lineage import cut
from driftloom.functions.scalars import rounded
from driftloom.operators import drift as D
from driftloom.operators import groups as G
from driftloom.operators import moments as M
from driftloom.operators import power as P
from driftloom.operators import resampling as R
from driftloom.operators import sessions as S
from driftloom.plans import drift_queries as Q
from driftloom.plans import tables as T
from driftloom.plans.registering import registry
from driftloom.plans.tables import SQL_EVENTS, sql_hashed, sql_round

#: The operators' own numbers of draws.
N_DRAWS, N_BOOT = 200, 1000
X = sql_round
QUERIES, ORACLES, query = registry()


def sql_halves(name: str, by: str, n_draws: int, seed: int = 0, source: str = "bm", unit: str = "bout") -> str:
    return f"""
{name}_u as (select distinct {by}, {unit} as bout from {source}),
{name}_n as (select *, count(*) over (partition by {by}) as nb from {name}_u),
{name}_k as (select * from {name}_n where nb >= 4),{sql_hashed(name + "_h", name + "_k", f"{_texts(by)}, bout::varchar", seed, n_draws)},
{name} as (select {by}, bout, draw, row_number() over (partition by {by}, draw order by h1, h2, bout) <= nb // 2 as is_left from {name}_h)"""


def _texts(columns: str) -> str:
    return ", ".join(f"{c}::varchar" for c in columns.split(", "))


SQL_CENTROID_NULL = f"""{sql_halves('h', 'event_type, day', N_DRAWS)},
cn as (select event_type, day, draw, pow(avg(m) filter (is_left) - avg(m) filter (not is_left), 2)
    - var_samp(m) filter (is_left) / count(*) filter (is_left) - var_samp(m) filter (not is_left) / count(*) filter (not is_left) as drift
    from h join bm using (event_type, day, bout) group by all having count(*) filter (is_left) >= 2 and count(*) filter (not is_left) >= 2)"""
SQL_DISPERSION_NULL = f"""{sql_halves('h', 'event_type, day', N_DRAWS)},
dv as (select h.event_type, h.day, draw, var_samp(value) filter (is_left) as a, var_samp(value) filter (not is_left) as b
    from h join e on e.event_type = h.event_type and e.day = h.day and e.user_id = h.bout group by all),
dn as (select event_type, day, draw, ln(b / a) as log_ratio from dv where a > 0 and b > 0)"""


def _centroid_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.centroid_null(M.bout_means(T.event_moments(spark, sf_dir)), T.SIDE, N_DRAWS)


def _dispersion_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dispersion_null(T.event_moments(spark, sf_dir), T.SIDE, N_DRAWS)


@query(f"""with {SQL_EVENTS}, {SQL_CENTROID_NULL}
    select event_type, count(*)::bigint as n_draws, {X('quantile_cont(drift, 0.95)')} as floor from cn group by event_type""")
def split_half_floor_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile of centroid drift when nothing changed, the draws of all days pooled per type."""
    found = R.floor_of(_centroid_null(spark, sf_dir), T.TYPES, "drift")
    return found.select("event_type", "n_draws", rounded("floor").alias("floor"))


@query(f"""with {SQL_EVENTS}, {SQL_DISPERSION_NULL}
    select event_type, count(*)::bigint as n_draws, {X('quantile_cont(abs(log_ratio), 0.95)')} as floor from dn group by event_type""")
def split_half_floor_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.floor_of(_dispersion_null(spark, sf_dir), T.TYPES, "log_ratio", absolute=True)
    return found.select("event_type", "n_draws", rounded("floor").alias("floor"))


SQL_PAIRS = """
c as (select conv_id % 5 as day, conv_id as bout, role as first, lead(role) over (partition by conv_id order by turn) as second from conversations),
pr as (select * from c where second is not null)"""


def _jsd_sql(name: str, by: str, left: str, right: str) -> str:
    return f"""
{name}_l0 as (select {by}, first, second, count(*) as n from {left} group by all),
{name}_l as (select {by}, first, second, n / sum(n) over (partition by {by}) as p from {name}_l0),
{name}_r0 as (select {by}, first, second, count(*) as n from {right} group by all),
{name}_r as (select {by}, first, second, n / sum(n) over (partition by {by}) as p from {name}_r0),
{name}_c as (select {by}, coalesce(l.p, 0) as p, coalesce(r.p, 0) as q from {name}_l l full join {name}_r r using ({by}, first, second)),
{name}_b as (select * from {name}_c semi join {name}_l using ({by}) semi join {name}_r using ({by})),
{name} as (select {by}, greatest((sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end) + sum(case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end)) / 2, 0) as jsd
    from {name}_b group by {by})"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day (conv_id % 5), bout, first, second: adjacent roles of each conversation."""
    turns = T.read(spark, sf_dir, "conversations").select((F.col("conv_id") % 5).alias("day"), F.col("conv_id").alias("bout"), "turn", "role")
    return S.bigrams(turns, ["bout"], ["turn"], "role", ["day"])


@query(f"with {SQL_PAIRS} select first, second, count(*)::bigint as n, {X('count(*) / sum(count(*)) over ()')} as p from pr group by all")
def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _pairs(spark, sf_dir).groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("first", "second", "n", rounded(F.col("n") / F.col("_all")).alias("p"))


@query(f"""with {SQL_PAIRS}, dd as (select a.day as day_a, b.day as day_b from (select distinct day from pr) a join (select distinct day from pr) b on a.day < b.day),
    jl as (select dd.day_a, dd.day_b, first, second from dd join pr on pr.day = dd.day_a), jr as (select dd.day_a, dd.day_b, first, second from dd join pr on pr.day = dd.day_b),
    {_jsd_sql('j', 'day_a, day_b', 'jl', 'jr')} select day_a, day_b, {X('jsd')} as jsd from j""")
def syntax_jsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.syntax_drift(D.transition_shares(_pairs(spark, sf_dir), ["day"]), "day")
    return found.select("day_a", "day_b", rounded("jsd").alias("jsd"))


@query(f"""with {SQL_PAIRS}, {sql_halves('h', 'day', N_DRAWS, source='pr')},
    hl as (select h.day, h.draw, first, second from h join pr using (day, bout) where is_left),
    hr as (select h.day, h.draw, first, second from h join pr using (day, bout) where not is_left),
    {_jsd_sql('j', 'day, draw', 'hl', 'hr')}
    select day, count(*)::bigint as n_draws, {X('quantile_cont(jsd, 0.95)')} as floor from j group by day""")
def split_half_floor_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.floor_of(R.syntax_null(_pairs(spark, sf_dir), ["day"], N_DRAWS), ["day"], "jsd")
    return found.select("day", "n_draws", rounded("floor").alias("floor"))


@query(f"""with {SQL_EVENTS}, {SQL_CENTROID_NULL} select day, count(*)::bigint as n_draws, {X('avg(drift)')} as mean, {X('stddev_pop(drift)')} as sd,
    {X('quantile_cont(drift, 0.95)')} as p95, {X('avg((drift < 0)::int)')} as share_negative from cn group by day""")
def null_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centroid_null(spark, sf_dir).groupBy("day").agg(
        F.count(F.lit(1)).alias("n_draws"), rounded(F.avg("drift")).alias("mean"), rounded(F.stddev_pop("drift")).alias("sd"),
        rounded(F.percentile("drift", F.lit(0.95))).alias("p95"), rounded(F.avg((F.col("drift") < 0).cast("double"))).alias("share_negative"),
    )


SQL_RESAMPLES = f"""
rn as (select event_type, day, bout, count(*) over w as nb, row_number() over (w order by bout) - 1 as i from bm window w as (partition by event_type, day)),
{sql_hashed("rh", "rn", "event_type, day::varchar, i::varchar", 0, N_BOOT)},
rs as (select event_type, day, draw, h1 % nb as i from rh),
rw as (select rs.event_type, rs.day, draw, bout, count(*) as w from rs join rn using (event_type, day, i) group by all),
pairs as (select event_type, day_a, day_b, drift from p)"""


def _sql_boot(weight: str) -> str:
    return f"""{SQL_RESAMPLES},
bs as (select event_type, day, draw, sum({weight}) as n, sum(m * {weight}) / sum({weight}) as mu,
    (sum(m * m * {weight}) - sum(m * {weight}) * sum(m * {weight}) / sum({weight})) / nullif(sum({weight}) - 1, 0) as v from rw join bm using (event_type, day, bout) group by all),
bd as (select event_type, day_a, day_b, draw, (a.mu - b.mu) * (a.mu - b.mu) - a.v / a.n - b.v / b.n as d from pairs
    join bs a on a.event_type = pairs.event_type and a.day = day_a join bs b on b.event_type = pairs.event_type and b.day = day_b and b.draw = a.draw
    where a.n >= 2 and b.n >= 2),
bi as (select event_type, day_a, day_b, quantile_cont(d, 0.025) as low, quantile_cont(d, 0.975) as high from bd group by all)"""


SQL_BOOT_COLLAPSED = _sql_boot("1").replace("draw, event_type, day_a", "event_type, day_a").replace(
    "select event_type, day_a, day_b, draw, (a.mu", "select pairs.event_type, day_a, day_b, a.draw, (a.mu"
)
SQL_BOOT_REPEATED = _sql_boot("w").replace("select event_type, day_a, day_b, draw, (a.mu", "select pairs.event_type, day_a, day_b, a.draw, (a.mu")


def _drifts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(bout moments, all day pairs with their drift)."""
    moments = cut(T.event_moments(spark, sf_dir))
    units = M.unit_moments(M.bout_means(moments), T.SIDE)
    return moments, cut(D.centroid_drift(units, T.TYPES, "day"))


def _boot(spark: SparkSession, sf_dir: str, collapse: bool) -> DataFrame:
    moments, pairs = _drifts(spark, sf_dir)
    keys = ["event_type", "day_a", "day_b"]
    ends = R.centroid_interval(M.bout_means(moments), T.TYPES, "day", pairs.select(*keys), N_BOOT, collapse=collapse)
    found = pairs.join(ends, keys)
    return found.select(*keys, rounded("drift").alias("drift"), rounded("low").alias("low"), rounded("high").alias("high"))


@query(f"""with {SQL_EVENTS}, {SQL_BOOT_COLLAPSED} select event_type, day_a, day_b, {X('drift')} as drift, {X('low')} as low, {X('high')} as high
    from pairs join bi using (event_type, day_a, day_b)""")
def bootstrap_ci_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the drift of all day pairs; a bout drawn twice counts once."""
    return _boot(spark, sf_dir, True)


@query(f"""with {SQL_EVENTS}, {SQL_BOOT_REPEATED} select event_type, day_a, day_b, {X('drift')} as drift, {X('low')} as low, {X('high')} as high
    from pairs join bi using (event_type, day_a, day_b)""")
def bootstrap_ci_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with bouts that count as often as they are drawn."""
    return _boot(spark, sf_dir, False)


@query(f"""with {SQL_EVENTS}, {SQL_RESAMPLES},
    bv as (select event_type, day, draw, (sum(sxx * w) - sum(sx * w) * sum(sx * w) / sum(n * w)) / nullif(sum(n * w) - 1, 0) as tv from rw join bm using (event_type, day, bout) group by all),
    bd as (select pairs.event_type, day_a, day_b, a.draw, ln(b.tv / a.tv) as d from pairs join bv a on a.event_type = pairs.event_type and a.day = day_a
        join bv b on b.event_type = pairs.event_type and b.day = day_b and b.draw = a.draw where a.tv > 0 and b.tv > 0),
    bi as (select event_type, day_a, day_b, quantile_cont(d, 0.025) as low, quantile_cont(d, 0.975) as high from bd group by all)
    select bi.event_type, day_a, day_b, {X('ln(b.tv / a.tv)')} as log_ratio, {X('low')} as low, {X('high')} as high
    from bi join tv a on a.event_type = bi.event_type and a.day = day_a join tv b on b.event_type = bi.event_type and b.day = day_b""")
def bootstrap_ci_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    moments, pairs = _drifts(spark, sf_dir)
    keys = ["event_type", "day_a", "day_b"]
    ends = R.dispersion_interval(moments, T.TYPES, "day", pairs.select(*keys), N_BOOT)
    ratios = D.dispersion_drift(M.total_variance(moments, T.SIDE), T.TYPES, "day")
    found = ratios.join(ends, keys)
    return found.select(*keys, rounded("log_ratio").alias("log_ratio"), rounded("low").alias("low"), rounded("high").alias("high"))


@query(f"""with {SQL_EVENTS}, {SQL_CENTROID_NULL}, {SQL_BOOT_COLLAPSED}, f as (select quantile_cont(drift, 0.95) as floor from cn)
    select day_a, day_b, count(*)::bigint as n_types, {X('avg(drift)')} as mean_drift,
    count(*) filter (low > floor)::bigint as n_over_floor from pairs join bi using (event_type, day_a, day_b), f group by day_a, day_b""")
def types_over_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many types of each pair of days lie over the pooled noise floor."""
    moments, pairs = _drifts(spark, sf_dir)
    keys = ["event_type", "day_a", "day_b"]
    ends = R.centroid_interval(M.bout_means(moments), T.TYPES, "day", pairs.select(*keys), N_BOOT)
    null = R.centroid_null(M.bout_means(moments), T.SIDE, N_DRAWS)
    floor = R.floor_of(null, [], "drift").select("floor")  # one row
    found = pairs.join(ends, keys).crossJoin(F.broadcast(floor))
    return found.groupBy("day_a", "day_b").agg(
        F.count(F.lit(1)).alias("n_types"), rounded(F.avg("drift")).alias("mean_drift"), F.count_if(F.col("low") > F.col("floor")).alias("n_over_floor")
    )


SQL_UNITS = """
ux0 as (select user_id % 8 as unit, event_type, ts::date as day, user_id as bout, value from events),
ux as (select * from ux0 semi join (select unit, event_type, day from ux0 group by all having count(*) >= 5 and count(distinct bout) >= 2) using (unit, event_type, day)),
um as (select unit, event_type, day, bout, avg(value) as m from ux group by all),
us as (select unit, event_type, day, avg(m) as mu, var_samp(m) as v, count(*) as units from um group by all),
ud as (select a.unit, a.day as day_a, b.day as day_b, avg((a.mu - b.mu) * (a.mu - b.mu) - a.v / a.units - b.v / b.units) as drift
    from us a join us b on a.unit = b.unit and a.event_type = b.event_type and a.day < b.day group by all),
g as (select unit, case when unit % 2 = 0 then 'treated' else 'control' end as grp, round(max(drift), 6) as x from ud group by unit)"""
SQL_PERMUTED = """
gi as (select *, row_number() over (order by unit) - 1 as i from g),
masks as (select mask from range(0, 256) t(mask) where bit_count(mask) = (select count(*) from g where grp = 'treated')),
dm as (select mask, avg(x) filter ((mask >> i) & 1 = 1) - avg(x) filter ((mask >> i) & 1 = 0) as d from masks, gi group by mask),
ob as (select avg(x) filter (grp = 'treated') - avg(x) filter (grp = 'control') as observed from g)"""


def group_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, grp, x: the largest drift of each of eight units, even ones treated."""
    found = Q.unit_drift(spark, sf_dir).groupBy("unit").agg(F.round(F.max("drift"), 6).alias("x"))
    return found.withColumn("grp", F.when(F.col("unit") % 2 == 0, "treated").otherwise("control"))


@query(f"""with {SQL_UNITS}, {SQL_PERMUTED} select {X('any_value(observed)')} as observed, count(*)::bigint as n_labelings,
    count(*) filter (abs(d) >= abs(observed) - 1e-12)::bigint as n_extreme,
    {X('(count(*) filter (abs(d) >= abs(observed) - 1e-12) + 1) / (count(*) + 1)')} as p_value from dm, ob""")
def group_permutation_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.permutation_p(group_values(spark, sf_dir), "unit", "grp", "x")
    return found.select(rounded("observed").alias("observed"), "n_labelings", "n_extreme", rounded("p_value").alias("p_value"))


@query(f"""with {SQL_UNITS}, {SQL_PERMUTED},
    gn as (select grp, unit, x, count(*) over (partition by grp) as n, row_number() over (partition by grp order by unit) - 1 as i from g),
    gs as (select grp, draw, ('0x' || substr(md5(concat_ws(':', '1', draw::varchar, grp, i::varchar)), 1, 8))::bigint % n as i from gn, range(1, 2001) t(draw)),
    gd as (select draw, avg(x) filter (gs.grp = 'treated') - avg(x) filter (gs.grp = 'control') as d from gs join gn on gn.grp = gs.grp and gn.i = gs.i group by draw),
    ci as (select quantile_cont(d, 0.025) as low, quantile_cont(d, 0.975) as high from gd),
    sp as (select stddev_samp(x - mean) as sd from (select x, avg(x) over (partition by grp) as mean from g)),
    pv as (select any_value(observed) as observed, (count(*) filter (abs(d) >= abs(observed) - 1e-12) + 1) / (count(*) + 1) as p from dm, ob)
    select {X('observed')} as observed_difference, {X('p')} as p_value, {X('low')} as ci_low, {X('high')} as ci_high,
    (select count(*) from g where grp = 'treated')::bigint as n_treated, (select count(*) from g where grp = 'control')::bigint as n_control,
    {X('sd')} as between_sd, case when 100.0 > sd then 'within-bird' else 'between-bird' end as limiting_factor from pv, ci, sp""")
def group_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.compare_groups(group_values(spark, sf_dir), "unit", "grp", "x", within_sd=100.0)
    numbers = ["observed_difference", "p_value", "ci_low", "ci_high", "between_sd"]
    return found.select(*[rounded(c).alias(c) for c in numbers], "n_treated", "n_control", "limiting_factor")


N_BOUTS, POWER_DRAWS, POWER_SCALE = 8, 500, 2000.0
POWER_EFFECTS = (0.05, 0.1, 0.5, 1.0, 2.0, 4.0)


def _sql_subset(name: str, seed: int) -> str:
    return f"""
{name}_n as (select event_type, day, bout, count(*) over (partition by event_type, day) as nb from bm),
{name}_k as (select * from {name}_n where nb >= {2 * N_BOUTS}),{sql_hashed(name + "_h", name + "_k", "event_type, day::varchar, bout::varchar", seed, POWER_DRAWS)},
{name}_r as (select event_type, day, draw, bout, row_number() over (partition by event_type, day, draw order by h1, h2, bout) as r from {name}_h),
{name} as (select *, r <= {N_BOUTS} as is_left from {name}_r where r <= {2 * N_BOUTS})"""


def _sql_directed(name: str, seed: int) -> str:
    return f"""{_sql_subset(name + '_s', seed)},
{name}_c as (select distinct event_type, day from bm),{sql_hashed(name + "_w", name + "_c", "event_type, day::varchar, 'direction', '0'", seed, POWER_DRAWS)},
{name} as (select event_type, day, draw, pow(avg(m) filter (is_left) - avg(m) filter (not is_left), 2)
    - var_samp(m) filter (is_left) / {N_BOUTS} - var_samp(m) filter (not is_left) / {N_BOUTS} as drift,
    (avg(m) filter (is_left) - avg(m) filter (not is_left)) * any_value(sign(cos(2 * pi() * (h2 / 4294967296.0)))) as along
    from {name}_s join bm using (event_type, day, bout) join {name}_w using (event_type, day, draw) group by event_type, day, draw)"""


@query(f"""with {SQL_EVENTS}, {_sql_directed('nl', R.NULL_SEED)}, {_sql_directed('al', 0)},
    cr as (select event_type, day, quantile_cont(drift, 0.95) as critical from nl group by all),
    gr as (select unnest([{", ".join(f"{e}::double" for e in POWER_EFFECTS)}]) as effect)
    select event_type, day, effect, {X(f'avg((drift - 2 * sqrt(effect * {POWER_SCALE}) * along + effect * {POWER_SCALE} > critical)::int)')} as power
    from al join cr using (event_type, day), gr group by event_type, day, effect""")
def power_curve_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = M.bout_means(T.event_moments(spark, sf_dir))
    found = P.centroid_power(means, T.SIDE, N_BOUTS, POWER_SCALE, POWER_EFFECTS, n_draws=POWER_DRAWS)
    return found.select("event_type", "day", "effect", rounded("power").alias("power"))


def _sql_ratios(name: str, seed: int) -> str:
    return f"""{_sql_subset(name + '_s', seed)},
{name}_v as (select h.event_type, h.day, draw, var_samp(value) filter (is_left) as a, var_samp(value) filter (not is_left) as b
    from {name}_s h join e on e.event_type = h.event_type and e.day = h.day and e.user_id = h.bout group by all),
{name} as (select event_type, day, draw, ln(b / a) as log_ratio from {name}_v where a > 0 and b > 0)"""


@query(f"""with {SQL_EVENTS}, {_sql_ratios('nl', R.NULL_SEED)}, {_sql_ratios('al', 0)},
    cr as (select event_type, day, quantile_cont(abs(log_ratio), 0.95) as critical from nl group by all),
    gr as (select unnest([{", ".join(f"{f}::double" for f in P.FOLDS)}]) as fold)
    select event_type, day, fold, {X('avg((abs(log_ratio + ln(fold)) > critical)::int)')} as power from al join cr using (event_type, day), gr group by event_type, day, fold""")
def power_curve_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.dispersion_power(T.event_moments(spark, sf_dir), T.SIDE, N_BOUTS, n_draws=POWER_DRAWS)
    return found.select("event_type", "day", "fold", rounded("power").alias("power"))


@query(f"""with {SQL_EVENTS}, {_sql_directed('nl', R.NULL_SEED)}, {_sql_directed('al', 0)},
    cr as (select event_type, day, quantile_cont(drift, 0.95) as critical from nl group by all),
    gr as (select unnest([{", ".join(f"{e}::double" for e in POWER_EFFECTS)}]) as effect),
    pc as (select event_type, day, effect, avg((drift - 2 * sqrt(effect * {POWER_SCALE}) * along + effect * {POWER_SCALE} > critical)::int) as power
        from al join cr using (event_type, day), gr group by event_type, day, effect)
    select event_type, day, min(effect) filter (power >= 0.8) as least from pc group by event_type, day""")
def minimum_detectable_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = M.bout_means(T.event_moments(spark, sf_dir))
    curve = P.centroid_power(means, T.SIDE, N_BOUTS, POWER_SCALE, POWER_EFFECTS, n_draws=POWER_DRAWS)
    return P.least_detectable(curve, T.SIDE, "effect")


@query()
def birds_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Individuals per group for an effect of two standard deviations, by simulated permutation tests."""
    return G.birds_needed(G.power_by_size(spark, 0.1, 0.05))


def _sql_analysis(n_null: int, n_boot: int, rows: int, bouts: int) -> str:
    """The whole analysis of one-dimensional points ``e`` (bird, label, day, bout, value), piece by piece."""
    keys = "bird, label, day"
    return f"""
b0 as (select {keys}, bout, count(*) as n, sum(value) as sx, sum(value * value) as sxx, avg(value) as m from e group by all),
su as (select {keys}, count(*) as nb from b0 group by all having sum(n) >= {rows}),
nu as (select * from b0 semi join (select * from su where nb >= {bouts}) using ({keys})),
bm as (select * from b0 semi join (select * from su where nb >= 2) using ({keys})),
{sql_halves('h', keys, n_null, source='nu')},
cn as (select {keys}, draw, pow(avg(m) filter (is_left) - avg(m) filter (not is_left), 2)
    - var_samp(m) filter (is_left) / count(*) filter (is_left) - var_samp(m) filter (not is_left) / count(*) filter (not is_left) as drift
    from h join nu using ({keys}, bout) group by all having count(*) filter (is_left) >= 2 and count(*) filter (not is_left) >= 2),
dv as (select h.bird, h.label, h.day, draw, var_samp(value) filter (is_left) as a, var_samp(value) filter (not is_left) as b
    from h join e using ({keys}, bout) group by all),
fl as (select bird, quantile_cont(drift, 0.95) as centroid_floor from cn group by bird),
fd as (select bird, quantile_cont(abs(ln(b / a)), 0.95) as dispersion_floor from dv where a > 0 and b > 0 group by bird),
tv as (select {keys}, var_samp(value) as tv, count(*) as n_rows from e group by all),
fi as (select bird, min(day) as day from e group by bird),
sc as (select bird, avg(tv) as scale from tv semi join fi using (bird, day) where n_rows >= 2 group by bird),
us as (select {keys}, avg(m) as mu, var_samp(m) as v, count(*) as units from bm group by all),
pt as (select {keys}, (sum(sxx) - sum(sx) * sum(sx) / sum(n)) / (sum(n) - 1) as tv from bm group by all),
pr as (select a.bird, a.label, a.day as day_a, b.day as day_b, (a.mu - b.mu) * (a.mu - b.mu) - a.v / a.units - b.v / b.units as drift
    from us a join us b on a.bird = b.bird and a.label = b.label and a.day < b.day where a.units >= 2 and b.units >= 2),
rn as (select {keys}, bout, count(*) over w as nb, row_number() over (w order by bout) - 1 as i from bm window w as (partition by {keys})),
{sql_hashed("rh", "rn", "bird, label, day::varchar, i::varchar", 0, n_boot)},
rs as (select {keys}, draw, h1 % nb as i from rh),
rw as (select rs.bird, rs.label, rs.day, draw, bout, count(*) as w from rs join rn using ({keys}, i) group by all),
bs as (select {keys}, draw, count(*) as n, avg(m) as mu, var_samp(m) as v,
    (sum(sxx * w) - sum(sx * w) * sum(sx * w) / sum(bm.n * w)) / nullif(sum(bm.n * w) - 1, 0) as tv from rw join bm using ({keys}, bout) group by all),
bc as (select pr.bird, pr.label, day_a, day_b,
    quantile_cont((a.mu - b.mu) * (a.mu - b.mu) - a.v / a.n - b.v / b.n, 0.025) filter (a.n >= 2 and b.n >= 2) as c_low,
    quantile_cont(case when a.tv > 0 and b.tv > 0 then ln(b.tv / a.tv) end, 0.025) as d_low, quantile_cont(case when a.tv > 0 and b.tv > 0 then ln(b.tv / a.tv) end, 0.975) as d_high
    from pr join bs a on a.bird = pr.bird and a.label = pr.label and a.day = day_a join bs b on b.bird = pr.bird and b.label = pr.label and b.day = day_b and b.draw = a.draw group by all),
ty as (select pr.*, c_low, d_low, d_high, ln(y.tv / x.tv) as log_ratio, scale, centroid_floor, dispersion_floor from pr join bc using (bird, label, day_a, day_b)
    join pt x on x.bird = pr.bird and x.label = pr.label and x.day = day_a join pt y on y.bird = pr.bird and y.label = pr.label and y.day = day_b
    join sc on sc.bird = pr.bird left join fl on fl.bird = pr.bird left join fd on fd.bird = pr.bird where x.tv > 0 and y.tv > 0)"""


@query(f"""with e as (select (user_id % 2)::varchar as bird, event_type as label, ts::date as day, user_id as bout, value from events), {_sql_analysis(300, 400, 10, 4)}
    select bird, day_a, day_b, (day_b - day_a)::int as separation_days, count(*)::bigint as n_types,
    count(*) filter (c_low > centroid_floor)::bigint as n_types_exceeding_centroid_floor,
    count(*) filter (d_low > dispersion_floor or d_high < -dispersion_floor)::bigint as n_types_exceeding_dispersion_floor,
    {X('avg(drift)')} as centroid_drift, {X('avg(drift) / any_value(scale)')} as centroid_drift_standardised,
    {X('avg(log_ratio)')} as dispersion_drift, {X('avg(abs(log_ratio))')} as dispersion_drift_abs from ty group by bird, day_a, day_b""")
def drift_against_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis on events: two halves of the users as individuals, drift of every day pair over its floors."""
    from driftloom.plans.analysis import AnalysisConfig, analyse_points

    rows = T.events(spark, sf_dir).withColumn("bird", (F.col("user_id") % 2).cast("string"))
    points = M.points(rows.withColumn("label", F.col("event_type")), ["bird", "day", "label"], "user_id", "value")
    found = analyse_points(points, AnalysisConfig(min_renditions=10, min_bouts=4))
    numbers = ["centroid_drift", "centroid_drift_standardised", "dispersion_drift", "dispersion_drift_abs"]
    counts = ["separation_days", "n_types", "n_types_exceeding_centroid_floor", "n_types_exceeding_dispersion_floor"]
    return found.pairs.select("bird", "day_a", "day_b", *counts, *[rounded(c).alias(c) for c in numbers])
