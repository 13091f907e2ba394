"""Queries on sets of syllables, on what their spectrograms show, and on development with intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.lineage import cut
from driftloom.functions.scalars import rounded
from driftloom.operators import audio as A
from driftloom.operators import embedding as E
from driftloom.operators import moments as M
from driftloom.plans import syllables
from driftloom.plans import tables as T
from driftloom.plans.recordings import RATE, recorded_tones
from driftloom.plans.registering import registry
from driftloom.plans.study_queries import LATE, labelled_events
from driftloom.plans.tables import sql_hashed, sql_round

X = sql_round
QUERIES, ORACLES, query = registry()
SPEC = A.Spectrogram()
#: The spectrum of a frame at RATE: its window, and the bins of the band.
WINDOW = round(SPEC.window * RATE / A.REFERENCE_RATE)
FIRST_BIN = int(SPEC.band[0] * WINDOW / RATE)
BINS = WINDOW // 2 + 1 - FIRST_BIN

SQL_TONES = """
t as (select conv_id, row_number() over (partition by conv_id order by turn) as place, role, 1000 * (1 + length(coalesce(text, '')) % 7) as pitch from conversations)"""


@query(f"""with {SQL_TONES} select conv_id, (conv_id * 1000 + place)::bigint as id, pitch::int as pitch, ceil({FIRST_BIN} * {RATE} / {WINDOW})::int as low_hertz,
    (select max(r) from range(0, {SPEC.rows}) k(r) where ({BINS} * r) // {SPEC.rows} <= pitch * {WINDOW} // {RATE} - {FIRST_BIN})::int as loudest_row from t""")
def tone_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loudest row of the spectrogram of every recorded turn, each of which is a tone of known pitch."""
    recordings, truth = recorded_tones(spark, sf_dir)
    found, _ = A.spectrograms(truth, recordings)
    lines = F.transform(F.sequence(F.lit(0), F.lit(SPEC.rows - 1)), lambda r: F.struct(
        F.aggregate(F.slice("features", r * SPEC.columns + 1, F.lit(SPEC.columns)), F.lit(0.0), lambda s, x: s + x).alias("sum"), (-r).alias("row")
    ))
    return found.select(
        F.col("audio_path").cast("bigint").alias("conv_id"), "id", "pitch", F.lit(-(-FIRST_BIN * RATE // WINDOW)).alias("low_hertz"),
        (-F.array_max(lines)["row"]).alias("loudest_row"),
    )


LEAST, PER_DAY = 15, 60


@query(f"""with {SQL_TONES}, r as (select (conv_id % 2)::varchar as bird, (conv_id % 5)::int as day, role as label, conv_id * 1000 + place as id from t),
    n as (select * from r where label <> 'system'), o as (select * from n semi join (select bird, day, label from n group by all having count(*) >= {LEAST}) using (bird, day, label)),
    k as (select * from (select *, row_number() over (partition by bird, day order by md5(concat_ws(':', '0', id::varchar)), id) as q from o) where q <= {PER_DAY}),
    a as (select bird, count(*) as n_all, count(*) filter (label = 'system') as n_excluded from r group by bird),
    b as (select bird, count(*) as n_often from o group by bird), c as (select bird, count(*) as n_kept, count(distinct day) as n_days, string_agg(distinct label, ',' order by label) as labels from k group by bird)
    select bird, coalesce(n_kept, 0)::bigint as n_syllables, coalesce(n_days, 0)::bigint as n_days, labels, n_excluded::bigint as n_excluded,
    (n_all - n_excluded - coalesce(n_often, 0))::bigint as n_rare, (coalesce(n_often, 0) - coalesce(n_kept, 0))::bigint as n_over_cap, 0::bigint as n_empty
    from a left join b using (bird) left join c using (bird)""")
def syllable_set_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of recorded turns with their spectrograms: no turns of the system, roles frequent on a day, 60 of each day; what was left out and why."""
    recordings, truth = recorded_tones(spark, sf_dir)
    conv = F.col("audio_path").cast("bigint")
    table = truth.withColumns({"bird": (conv % 2).cast("string"), "day": (conv % 5).cast("int")})
    _, summary = syllables.syllable_set(table, recordings, "id", exclude=("system",), least=LEAST, max_per_day=PER_DAY)
    return summary.withColumn("labels", F.array_join(F.array_sort(F.map_keys("labels")), ","))


N_BOOT = 300


@query(f"""with e as (select event_type as label, ts::date as day, ts::date::varchar || '|' || user_id as bout, value from events),
    b0 as (select label, day, bout, avg(value) as m from e group by all),
    bm as (select * from b0 union all select label, date '1900-01-01', bout, m from b0 where day >= date '{LATE[0]}'),
    s as (select label, day, avg(m) as mu, var_samp(m) as v, count(*) as units from bm group by all),
    p as (select a.label, a.day as day_a, b.day as day_b, (a.mu - b.mu) * (a.mu - b.mu) - a.v / a.units - b.v / b.units as drift from s a join s b on a.label = b.label and a.day < b.day
        where a.units >= 2 and b.units >= 2 and case when a.day = date '1900-01-01' then b.day < (select min(day) from b0 where day >= date '{LATE[0]}') else b.day - a.day = 1 end),
    rn as (select label, day, bout, m, count(*) over w as nb, row_number() over (w order by bout) - 1 as i from bm window w as (partition by label, day)),{sql_hashed("rh", "rn", "label, day::varchar, i::varchar", 0, N_BOOT)},
    rs as (select rh.label, rh.day, draw, rn.m from rh join rn on rn.label = rh.label and rn.day = rh.day and rn.i = h1 % rh.nb),
    bs as (select label, day, draw, avg(m) as mu, var_samp(m) as v, count(*) as n from rs group by all),
    bi as (select p.label, day_a, day_b, quantile_cont((a.mu - b.mu) * (a.mu - b.mu) - a.v / a.n - b.v / b.n, 0.025) as low, quantile_cont((a.mu - b.mu) * (a.mu - b.mu) - a.v / a.n - b.v / b.n, 0.975) as high
        from p join bs a on a.label = p.label and a.day = day_a join bs b on b.label = p.label and b.day = day_b and b.draw = a.draw where a.n >= 2 and b.n >= 2 group by all)
    select case when day_a = date '1900-01-01' then 'endpoint' else 'consecutive' end as measure, label, case when day_a = date '1900-01-01' then day_b else day_a end as day_a,
    case when day_a <> date '1900-01-01' then day_b end as day_b, {X('drift')} as drift, {X('low')} as low, {X('high')} as high from p left join bi using (label, day_a, day_b)""")
def development_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of days that follow each other, and of every day from the last nine, each with its interval."""
    found = syllables.development_intervals(labelled_events(spark, sf_dir), F.col("day") >= F.lit(LATE[0]), N_BOOT)
    return found.select("measure", "label", "day_a", "day_b", *[rounded(c).alias(c) for c in ("drift", "low", "high")])


@query(f"""with x as (select vec_id, vec_id % 10 as bout, vec_id % 5 as side, unnest(embedding)::double as x, unnest(range(len(embedding))) as dim from embeddings),
    bm as (select side, bout, dim, avg(x) as m from x group by all), s as (select side, dim, avg(m) as mu, var_samp(m) as v, count(*) as n from bm group by all),
    w as (select side, dim, var_samp(x) as v from x group by all), t as (select side, sum(v) as tv from w group by side),
    d as (select a.side as side_a, b.side as side_b, sum((a.mu - b.mu) * (a.mu - b.mu) - a.v / a.n - b.v / b.n) as drift from s a join s b on a.side < b.side and a.dim = b.dim where a.n >= 2 and b.n >= 2 group by all)
    select side_a, side_b, {X('drift', 5)} as drift, {X('ln(b.tv / a.tv)', 5)} as log_ratio from d join t a on a.side = side_a join t b on b.side = side_b""")
def full_rank_embedding_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift and dispersion of pseudo-days in all principal components of the first one: those of the vectors themselves, as axes are only turned."""
    from driftloom.operators import drift as D

    rows = T.vectors(spark, sf_dir).select(F.lit("one").alias("bird"), (F.col("vec_id") % 5).alias("side"), "bout", F.col("z").alias("features"))
    width = rows.select(F.max(F.size("features"))).first()[0] or 1
    first = rows.where("side = 0").select(F.col("features").alias("z"))
    model = E.fitted_pca(first, width)
    points = E.projected(model, rows.withColumnRenamed("features", "z").select("side", "bout", "z"))
    moments = cut(M.bout_moments(points, ["side"]))
    drift = D.centroid_drift(M.unit_moments(M.bout_means(moments), ["side"]), [], "side")
    found = drift.join(D.dispersion_drift(M.total_variance(moments, ["side"]), [], "side"), ["side_a", "side_b"])
    return found.select("side_a", "side_b", rounded("drift", 5).alias("drift"), rounded("log_ratio", 5).alias("log_ratio"))
