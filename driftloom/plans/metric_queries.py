"""Queries on sessions, ingestion, filters, agreement, fidelity and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.lineage import cut
from driftloom.functions.scalars import named_groups, portable_hash, rounded, token_distance, token_error_rate
from driftloom.operators import audio as A
from driftloom.operators import clean as C
from driftloom.operators import fidelity as FD
from driftloom.operators import matching as MT
from driftloom.operators import sessions as S
from driftloom.plans import tables as T
from driftloom.plans.recordings import recorded_turns
from driftloom.plans.registering import registry
from driftloom.plans.tables import sql_round
from driftloom.sources import names

X = sql_round
GAP = 21_600.0
QUERIES, ORACLES, query = registry()

SQL_SESSIONS = f"""
t as (select user_id, event_id, event_type, epoch_us(ts) / 1e6 as tt from events),
g as (select *, tt - lag(tt) over (partition by user_id order by tt, event_id) as gap from t),
se as (select *, sum((coalesce(gap, 0) > {GAP})::int) over (partition by user_id order by tt, event_id rows unbounded preceding)::bigint as bout from g)"""


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sessions(T.read(spark, sf_dir, "events"), ["user_id"], S.seconds("ts"), GAP, ["event_id"])


@query(f"with {SQL_SESSIONS} select user_id, bout, count(*)::bigint as n_events, {X('max(tt) - min(tt)')} as seconds from se group by all")
def sessionise_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bouts of each user: events at most six hours apart."""
    rows = user_sessions(spark, sf_dir).withColumn("at", S.seconds("ts"))
    return rows.groupBy("user_id", "bout").agg(F.count(F.lit(1)).alias("n_events"), rounded(F.max("at") - F.min("at")).alias("seconds"))


@query(f"""with t as (select event_type, epoch_us(ts) / 1e6 as tt from events), g as (select event_type, tt - lag(tt) over (partition by event_type order by tt) as gap from t)
    select event_type, {X('greatest(sqrt(quantile_cont(gap, 0.5) * quantile_cont(gap, 0.99)), 1e-6)')} as gap_s from g where gap > 0 group by event_type""")
def suggest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.suggested_gap(T.read(spark, sf_dir, "events"), ["event_type"], S.seconds("ts"))
    return found.select("event_type", rounded("gap_s").alias("gap_s"))


@query(f"with {SQL_SESSIONS}, b as (select user_id, bout, max(tt) - min(tt) as s from se group by all) select user_id % 8 as unit, {X('median(s)')} as median_seconds, count(*)::bigint as n_bouts from b group by 1")
def median_bout_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = user_sessions(spark, sf_dir).withColumn("at", S.seconds("ts"))
    bouts = rows.groupBy("user_id", "bout").agg((F.max("at") - F.min("at")).alias("s"))
    return bouts.groupBy((F.col("user_id") % 8).alias("unit")).agg(rounded(F.median("s")).alias("median_seconds"), F.count(F.lit(1)).alias("n_bouts"))


@query("""with r as (select event_id, event_type, ts::date as day, row_number() over (partition by ts::date, event_type
    order by md5(concat_ws(':', '0', event_id::varchar)), event_id) as r from events) select event_type, day, event_id from r where r <= 10""")
def stratified_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten events of each type and day, chosen by hash."""
    return C.stratified_cap(T.events(spark, sf_dir), ["day", "event_type"], "event_id", 10).select("event_type", "day", "event_id")


@query("""with e as (select event_type, ts::date as day from events where event_type not in ('error')), n as (select event_type, day, count(*) as n from e group by all)
    select event_type, sum(case when n >= 65 then n else 0 end)::bigint as n_kept, sum(case when n < 65 then n else 0 end)::bigint as n_dropped,
    count(*) filter (n < 65)::bigint as days_dropped from n group by event_type""")
def label_exclusion_rare_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels taken out by name first, then labels rare on their day, with counts of what went."""
    rows = C.exclude(T.events(spark, sf_dir), "event_type", ["error"])
    kept, dropped = C.rare_filter(rows.select("event_type", "day"), ["event_type", "day"], 65)
    n = kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_kept"))
    d = dropped.groupBy("event_type").agg(F.sum("n").alias("n_dropped"), F.count(F.lit(1)).alias("days_dropped"))
    return n.join(d, "event_type", "full").na.fill(0)


@query(f"""with x as (select l_returnflag, l_discount * 100 - 2 as a, l_quantity / 5 as b from lineitem), y as (select *, greatest(a, 0) as onset, least(b, 8) as offs from x)
    select l_returnflag, count(*) filter (a < 0)::bigint as n_low, count(*) filter (b > 8)::bigint as n_high, count(*) filter (offs <= onset)::bigint as n_empty,
    {X('sum(offs - onset) filter (offs > onset)', 4)} as kept_length from y group by l_returnflag""")
def clamp_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals made of discount and quantity, pulled into 0 to 8; what was low, high or empty is counted."""
    rows = T.read(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_discount") * 100 - 2).alias("onset_s"), (F.col("l_quantity") / 5).alias("offset_s"))
    marked = C.clamped(rows, 0.0, 8.0)
    length = F.when(~F.col("was_empty"), F.col("offset_s") - F.col("onset_s"))
    return marked.groupBy("l_returnflag").agg(
        F.count_if("was_low").alias("n_low"), F.count_if("was_high").alias("n_high"), F.count_if("was_empty").alias("n_empty"),
        rounded(F.sum(length), 4).alias("kept_length"),
    )


@query("""with o as (select distinct o_orderstatus, o_orderkey from orders), l as (select distinct l_orderkey from lineitem where l_returnflag = 'R')
    select o_orderstatus, count(*)::bigint as n_audio, count(l_orderkey)::bigint as n_annotated, greatest(count(*) - count(l_orderkey), 0)::bigint as n_unannotated
    from o left join l on l_orderkey = o_orderkey group by o_orderstatus""")
def coverage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with and without returned items: recordings with and without annotations."""
    orders = T.read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey")
    items = T.read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return C.coverage(orders, items, "o_orderkey", ["o_orderstatus"])


@query(r"""with p as (select url, regexp_extract(url, '^(https?)://(?:blog\.)?([^/]+)/([a-z]{2})/(\d+)', ['scheme', 'host', 'lang', 'id']) as f from pages)
    select f.lang as lang, f.scheme as scheme, count(*)::bigint as n, count(distinct f.host)::bigint as n_hosts, max(f.id::bigint)::bigint as last_id from p
    where f.id <> '' group by all union all select null, null, count(*)::bigint, 0::bigint, null from p where f.id = ''""")
def manifest_from_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of page addresses by a pattern with named groups; one row counts the addresses that don't match."""
    fields = named_groups("url", r"^(?P<scheme>https?)://(?:blog\.)?(?P<host>[^/]+)/(?P<lang>[a-z]{2})/(?P<id>\d+)")
    rows = T.read(spark, sf_dir, "pages").select(*[c.alias(k) for k, c in fields.items()])
    good = rows.where("id is not null").groupBy("lang", "scheme").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("host").alias("n_hosts"), F.max(F.col("id").cast("bigint")).alias("last_id")
    )
    null = F.lit(None).cast("string")
    bad = rows.where("id is null").agg(F.count(F.lit(1)).alias("n"))
    return good.unionByName(bad.select(null.alias("lang"), null.alias("scheme"), "n", F.lit(0).cast("bigint").alias("n_hosts"), F.lit(None).cast("bigint").alias("last_id")))


@query("""with n as (select event_id, ts, 'b' || (user_id % 4) || case when event_id % 3 = 0 then '_tmpl_x' else '' end || '_' || strftime(ts, '%d%m%y') || '_' || strftime(ts, '%H%M') || '.' || (event_id % 200 - 100) || '.wav' as name,
        strftime(case when event_id % 50 = 0 then ts + interval 1 day else ts end, '%m%d%y') as dir from events),
    f as (select event_id, regexp_extract(name, '^([^_]+)', 1) as bird, event_id % 3 = 0 as t, date_trunc('minute', ts) as stamp, dir, ts::date as day, event_id % 200 - 100 as serial,
        strptime(dir, '%m%d%y')::date as dir_day from n)
    select bird, count(*)::bigint as n, count(*) filter (t)::bigint as n_template, count(*) filter (day <> dir_day)::bigint as n_date_mismatch,
        min(serial)::bigint as first_serial, max(day) as last_day, (sum(epoch(stamp)::bigint % 86400) / 60)::bigint as minutes from f group by bird""")
def filename_parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recording names made from events, read again, and their dates held against their directories'."""
    template = F.when(F.col("event_id") % 3 == 0, "_tmpl_x").otherwise("")
    name = F.concat(F.lit("b"), F.col("user_id") % 4, template, F.lit("_"), F.date_format("ts", "ddMMyy_HHmm"), F.lit("."), F.col("event_id") % 200 - 100, F.lit(".wav"))
    moved = F.when(F.col("event_id") % 50 == 0, F.date_add(F.to_date("ts"), 1)).otherwise(F.to_date("ts"))
    rows = T.read(spark, sf_dir, "events").select(F.concat(F.date_format(moved, "MMddyy"), F.lit("/"), name).alias("path"))
    rows = rows.withColumns({**names.recording("path"), "dir_day": names.directory_day(names.parent("path"))})
    rows = rows.withColumn("day", F.to_date("timestamp"))
    minutes = F.hour("timestamp") * 60 + F.minute("timestamp")
    return rows.groupBy("bird").agg(
        F.count(F.lit(1)).alias("n"), F.count("template").alias("n_template"), F.count_if(F.col("day") != F.col("dir_day")).alias("n_date_mismatch"),
        F.min(F.col("serial").cast("bigint")).alias("first_serial"), F.max("day").alias("last_day"), F.sum(minutes).cast("bigint").alias("minutes"),
    )


@query(f"""with t as (select user_id, epoch_us(ts) / 1e6 as a, epoch_us(ts) / 1e6 + least(value, 120) as b, event_id from events),
    s as (select *, max(b) over (partition by user_id order by a, event_id rows between unbounded preceding and 1 preceding) as before from t),
    d as (select user_id, a, b from s where before is null or a > before),
    i as (select *, sum(coalesce((a - lag_b >= 36000)::int, 0)) over (partition by user_id order by a rows unbounded preceding) as run
        from (select *, lag(b) over (partition by user_id order by a) as lag_b from d)),
    r as (select user_id, min(a) as onset_s, max(b) as offset_s from i group by user_id, run having max(b) - min(a) >= 600)
    select user_id, count(*)::bigint as n_segments, {X('sum(offset_s - onset_s)', 3)} as seconds from r group by user_id""")
def segment_merge_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint intervals of each user, those less than ten hours apart bridged, then those under ten minutes dropped."""
    at = S.seconds("ts")
    rows = T.read(spark, sf_dir, "events").select("user_id", "event_id", at.alias("onset_s"), (at + F.least("value", F.lit(120.0))).alias("offset_s"))
    along = F.max("offset_s").over(S.W.partitionBy("user_id").orderBy("onset_s", "event_id").rowsBetween(S.W.unboundedPreceding, -1))
    disjoint = rows.withColumn("_before", along).where("_before is null or onset_s > _before").select("user_id", "onset_s", "offset_s")
    runs = S.merged_runs(disjoint, ["user_id"], 36_000.0, 600.0)
    return runs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_segments"), rounded(F.sum(F.col("offset_s") - F.col("onset_s")), 3).alias("seconds"))


def _segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sessions of each user as segments, the same with boundaries moved by up to 20 s by hash)."""
    rows = user_sessions(spark, sf_dir).withColumn("at", S.seconds("ts"))
    true = cut(rows.groupBy("user_id", "bout").agg(F.min("at").alias("onset_s"), (F.max("at") + 1).alias("offset_s")))

    def moved(c: str) -> Column:
        return F.col(c) + F.pmod(F.conv(F.substring(portable_hash(F.lit(c), "user_id", "bout"), 1, 8), 16, 10).cast("bigint"), F.lit(41)) - 20

    return true, true.select("user_id", "bout", moved("onset_s").alias("onset_s"), moved("offset_s").alias("offset_s"))


def _sql_jitter(column: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{column}', user_id::varchar, bout::varchar)), 1, 8))::bigint % 41) - 20"


#: Sessions lie six hours apart and move by 20 s at most, so a session's only candidate is near it, and matches are a join.
SQL_SEGMENTS = f"""{SQL_SESSIONS},
tr as (select user_id, bout, min(tt) as onset_s, max(tt) + 1 as offset_s from se group by all),
pd as (select user_id, onset_s + {_sql_jitter('onset_s')} as onset_s, offset_s + {_sql_jitter('offset_s')} as offset_s from tr)"""


def _sql_scored(matches: str, by: str) -> str:
    """precision, recall and f1 of ``matches`` (by, n_true, n_pred, n_matched)."""
    return f"""s0 as (select {by}, sum(n_true)::bigint as n_true, sum(n_pred)::bigint as n_pred, sum(n_matched)::bigint as n_matched from {matches} group by all),
s1 as (select *, case when n_pred > 0 then n_matched / n_pred else 0 end as p, case when n_true > 0 then n_matched / n_true else 0 end as r from s0)
select {by}, n_true, n_pred, n_matched, {X('p')} as precision, {X('r')} as recall, {X('case when p + r > 0 then 2 * p * r / (p + r) else 0 end')} as f1 from s1"""


@query(f"""with {SQL_SEGMENTS}, m as (select user_id % 8 as unit, (select count(*) from tr x where x.user_id = tr.user_id and x.bout = tr.bout) as n_true, 1 as n_pred,
    (select count(*) from pd where pd.user_id = tr.user_id and abs(pd.onset_s - tr.onset_s) <= 10 and abs(pd.offset_s - tr.offset_s) <= 10) as n_matched from tr),
    {_sql_scored('m', 'unit')}""")
def segment_match_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy one-to-one matches of sessions and jittered sessions, both boundaries within ten seconds."""
    counts = MT.segment_counts(*_segments(spark, sf_dir), ["user_id"], 10.0).withColumn("unit", F.col("user_id") % 8)
    found = MT.pooled(counts, ["unit"])
    return found.select("unit", "n_true", "n_pred", "n_matched", *[rounded(c).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""with {SQL_SEGMENTS}, m as (select boundary, 1 as n_true, 1 as n_pred, (select count(*) from pd where pd.user_id = tr.user_id
        and abs(case boundary when 'onset_s' then pd.onset_s - tr.onset_s else pd.offset_s - tr.offset_s end) <= 10) as n_matched from tr, (values ('onset_s'), ('offset_s')) v(boundary)),
    {_sql_scored('m', 'boundary')}""")
def boundary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    true, pred = _segments(spark, sf_dir)
    sides = []
    for side in ("onset_s", "offset_s"):
        found = MT.pooled(MT.boundary_counts(true, pred, ["user_id"], side, 10.0))
        sides.append(found.select(F.lit(side).alias("boundary"), "n_true", "n_pred", "n_matched", *[rounded(c).alias(c) for c in ("precision", "recall", "f1")]))
    return sides[0].unionByName(sides[1])


SQL_TOKENS = """
s as (select conv_id, list(role order by turn) as roles from conversations group by conv_id),
q as (select a.conv_id as pair, a.roles as t, b.roles as p from s a join s b on b.conv_id = a.conv_id + 1),
z as (select pair, t, p, array_to_string(list_transform(t, lambda x: substr(x, 1, 1)), '') as ta, array_to_string(list_transform(p, lambda x: substr(x, 1, 1)), '') as pa from q)"""


def _role_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair, t, p: the roles of each conversation and of the next one."""
    found = S.sequences(T.read(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role")
    after = found.select((F.col("conv_id") - 1).alias("pair"), F.col("labels").alias("p"))
    return found.select(F.col("conv_id").alias("pair"), F.col("labels").alias("t")).join(after, "pair")


@query(f"with {SQL_TOKENS} select pair, levenshtein(ta, pa)::bigint as edits from z")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _role_pairs(spark, sf_dir).select("pair", token_distance(F.col("t"), F.col("p")).alias("edits"))


@query(f"with {SQL_TOKENS} select pair, {X('levenshtein(ta, pa) / len(t)')} as error_rate from z")
def token_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _role_pairs(spark, sf_dir).select("pair", rounded(token_error_rate(F.col("t"), F.col("p"))).alias("error_rate"))


SQL_LABELS = "l as (select quality as t, toxic as p from labels join documents using (doc_id))"


@query(f"with {SQL_LABELS}, a as (select avg((t = p)::int) as acc from l) select t::bigint as true_label, p::bigint as predicted_label, count(*)::bigint as n, {X('any_value(acc)')} as accuracy from l, a group by t, p")
def label_accuracy_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.read(spark, sf_dir, "documents").select("doc_id")
    pairs = T.read(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("quality").cast("bigint").alias("t"), F.col("toxic").cast("bigint").alias("p"))
    accuracy = MT.label_accuracy(pairs, "t", "p")  # one row
    return MT.confusion(pairs, "t", "p").crossJoin(F.broadcast(accuracy)).withColumn("accuracy", rounded("accuracy"))


SQL_DISTANCES = """
x as (select vec_id, label, list_transform(embedding, lambda v: v::double) as z from embeddings),
d as (select q.vec_id as id, q.label as label, t.vec_id as other, t.label as other_label, round(list_distance(q.z, t.z) * list_distance(q.z, t.z), 9) as d2
    from x q join x t on q.vec_id <> t.vec_id {where})"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "label", "z")


@query(f"""with {SQL_DISTANCES.format(where="where q.vec_id % 5 = 0 and t.vec_id % 5 <> 0")},
    k as (select * from (select *, row_number() over (partition by id order by d2, other) as r from d) where r <= 5),
    v as (select id, any_value(label) as label, other_label, count(*) as n from k group by id, other_label),
    w as (select * from (select *, row_number() over (partition by id order by n desc, other_label) as r from v) where r = 1)
    select label, count(*)::bigint as n, {X('avg((label = other_label)::int)')} as accuracy from w group by label""")
def knn_label_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority of the five nearest: every fifth vector against the others, accuracy by label."""
    rows = _labelled(spark, sf_dir)
    found = FD.knn_recovery(rows.where("id % 5 <> 0"), rows.where("id % 5 = 0"), 5)
    same = (F.col("label") == F.col("predicted")).cast("double")
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(same)).alias("accuracy"))


@query(f"""with {SQL_DISTANCES.format(where="")}, k as (select * from (select *, row_number() over (partition by id order by d2, other) as r from d) where r = 1)
    select {X('avg((label = other_label)::int)')} as purity from k""")
def nn_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FD.purity(_labelled(spark, sf_dir)).select(rounded("purity").alias("purity"))


@query(f"""with {SQL_DISTANCES.format(where="")}, n as (select label as other_label, count(*) as n from x group by label),
    m as (select id, label, other_label, sum(sqrt(d2)) as total, any_value(n) as n from d join n using (other_label) group by all),
    e as (select id, max(total / (n - 1)) filter (label = other_label and n > 1) as a, min(total / n) filter (label <> other_label) as b from m group by id)
    select {X('avg(case when a is null then 0 else coalesce((b - a) / nullif(greatest(a, b), 0), 0) end)', 5)} as silhouette from e""")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FD.silhouette(_labelled(spark, sf_dir)).select(rounded("silhouette", 5).alias("silhouette"))


@query(f"""with x0 as (select vec_id, label, list_transform(embedding, lambda v: v::double) as r, row_number() over (partition by label order by md5(concat_ws(':', '0', vec_id::varchar)), vec_id) as k,
        count(*) over (partition by label) as n from embeddings),
    x as (select *, r[1:16] as z from x0 where k <= 200 and n >= 3),
    pr as (select a.label, round(list_distance(a.z, b.z), 9) as dz, round(list_distance(a.r, b.r), 9) as dr from x a join x b on a.label = b.label and a.vec_id < b.vec_id),
    rk as (select label, rank() over (partition by label order by dz) + (count(*) over (partition by label, dz) - 1) / 2.0 as rz,
        rank() over (partition by label order by dr) + (count(*) over (partition by label, dr) - 1) / 2.0 as rr from pr)
    select label, count(*)::bigint as n_pairs, {X('corr(rz, rr)', 5)} as rho from rk group by label""")
def within_type_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of distances in the first 16 dimensions and in all, within each label."""
    rows = T.vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "label", F.slice("z", 1, 16).alias("z"), F.col("z").alias("reference"))
    found = FD.within_label_correlation(rows)
    return found.select("label", "n_pairs", rounded("rho", 5).alias("rho"))


@query(f"""with x as (select vec_id, label, list_transform(embedding, lambda v: v::double) as r, list_transform(embedding[1:16], lambda v: v::double) as z from embeddings),
    pr as (select a.label, round(list_distance(a.z, b.z), 9) as dz, round(list_distance(a.r, b.r), 9) as dr from x a join x b on a.label = b.label and a.vec_id < b.vec_id),
    rk as (select label, rank() over (partition by label order by dz) + (count(*) over (partition by label, dz) - 1) / 2.0 as rz,
        rank() over (partition by label order by dr) + (count(*) over (partition by label, dr) - 1) / 2.0 as rr from pr)
    select label, count(*)::bigint as n_pairs, {X('corr(rz, rr)', 5)} as rho from rk group by label having count(*) >= 3""")
def within_type_rho_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all pairs of a label."""
    rows = T.vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "label", F.slice("z", 1, 16).alias("z"), F.col("z").alias("reference"))
    found = FD.within_label_correlation(rows, None)
    return found.select("label", "n_pairs", rounded("rho", 5).alias("rho"))


@query(f"""select user_id % 16 as bird, ts::date as day, count(*)::bigint as n_files, sum(length(event_type))::bigint as n_sounds, {X('sum(value)', 4)} as seconds,
    (grouping(user_id % 16) * 2 + grouping(ts::date))::bigint as level from events group by rollup (user_id % 16, ts::date)""")
def inventory_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per unit and day, per unit, and over all."""
    from driftloom.sources.datasets import inventory

    rows = T.events(spark, sf_dir).select((F.col("user_id") % 16).alias("bird"), "day", F.char_length("event_type").cast("bigint").alias("sounds"), F.col("value").alias("seconds"))
    found = inventory(rows)
    return found.select("bird", "day", "n_files", "n_sounds", rounded("seconds", 4).alias("seconds"), F.col("level").cast("bigint").alias("level"))


@query("""select conv_id, count(*)::bigint as n, (3200 * count(*))::bigint as n_features, 1.0::double as least_peak, 1.0::double as greatest_peak, true as in_range
    from conversations group by conv_id""")
def spectrogram_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectrograms of all turns of the recorded conversations: of one size, from 0 to 1 each."""
    recordings, truth = recorded_turns(spark, sf_dir)
    found, _ = A.spectrograms(truth, recordings.select("audio_path", "content"))
    peak = F.array_max("features").cast("double")
    return found.groupBy(F.col("audio_path").cast("bigint").alias("conv_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("features")).alias("n_features"), F.min(peak).alias("least_peak"), F.max(peak).alias("greatest_peak"),
        F.min(F.forall("features", lambda x: (x >= 0) & (x <= 1))).alias("in_range"),
    )


@query("select conv_id, count(*)::bigint as n_true, count(*)::bigint as n_found, count(*)::bigint as n_within_10_ms from conversations group by conv_id")
def amplitude_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of the recorded conversations found by their amplitude, each with both boundaries within 10 ms."""
    recordings, truth = recorded_turns(spark, sf_dir)
    found = A.amplitude_segments(recordings, A.AmplitudeSegmenter(threshold=0.2))
    counts = MT.segment_counts(truth, found, ["audio_path"], 0.01)
    return counts.select(
        F.col("audio_path").cast("bigint").alias("conv_id"), "n_true", F.col("n_pred").alias("n_found"), F.col("n_matched").alias("n_within_10_ms")
    )
