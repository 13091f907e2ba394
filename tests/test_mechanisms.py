"""Percentiles in rounds, matching in stretches, hashes of draws, and drift kept up to date by a stream."""

import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.functions import scalars
from driftloom.operators import draws as G
from driftloom.operators import drift as D
from driftloom.operators import matching as MT
from driftloom.operators import moments as M
from driftloom.operators import percentiles as PC
from driftloom.operators import resampling as R
from driftloom.streaming import drift as SD


def plain_mix(x, y):
    z = x ^ y
    for _ in range(2):
        z ^= z >> 16
        z = z * 73244475 % 2**32
    return z ^ z >> 16


def test_hashes_of_draws_agree_in_python_numpy_and_spark(spark):
    rng = random.Random(2)
    pairs = [(rng.getrandbits(32), rng.getrandbits(32)) for _ in range(200)] + [(0, 0), (2**32 - 1, 0)]
    want = [plain_mix(*p) for p in pairs]
    df = spark.createDataFrame(pairs, "x long, y long")
    assert [r[0] for r in df.select(scalars.mixed(F.col("x"), F.col("y"))).collect()] == want
    x, y = (np.array(v, np.uint32) for v in zip(*pairs))
    assert np.diagonal(G.mixed(x, y)).tolist() == want
    digest = hashlib.md5(b"3:17").hexdigest()
    assert [int(v[0]) for v in G.of_draws(range(17, 18), 3)] == [int(digest[:8], 16), int(digest[8:16], 16)]
    row = spark.range(1).select(*[scalars.lane(scalars.portable_hash(F.lit(3), F.lit(17)), k) for k in (0, 1)]).first()
    assert list(row) == [int(digest[:8], 16), int(digest[8:16], 16)]


def test_draws_are_as_random_as_they_should_be():
    """Each of 40 bouts is on the left in half of the draws, and pairs are together in about half of them."""
    names = G.lanes([f"a:2024-01-01:{i}" for i in range(40)])
    high = G.mixed(names[0], G.of_draws(range(1, 4001), 0)[0])
    left = (np.argsort(np.argsort(high, axis=1), axis=1) < 20).astype(float)
    assert np.abs(left.mean(axis=0) - 0.5).max() < 0.035
    together = left.T @ left / len(left)
    assert np.abs(together[~np.eye(40, dtype=bool)] - 19 / 78).max() < 0.035
    normal = G.normals("a", 8, range(1, 4001), 0)
    assert np.abs(normal.mean(axis=0)).max() < 0.08 and np.abs(normal.std(axis=0) - 1).max() < 0.06
    assert np.abs(np.corrcoef(normal.T) - np.eye(8)).max() < 0.08


def test_intervals_of_grouped_pairs_equal_those_of_joined_ones(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(t, d, b, rng.normal(d, 1 + b % 2, 3).tolist()) for t in ("x", "y") for d in range(4) for b in range(3 + d) for _ in range(3)]
    moments = M.bout_moments(spark.createDataFrame(rows, "label string, day int, bout int, z array<double>"), ["label", "day"])
    pairs = spark.createDataFrame([(t, a, b) for t in ("x", "y") for a in range(4) for b in range(a)], "label string, day_b int, day_a int")
    for f in (lambda: R.centroid_interval(M.bout_means(moments), ["label"], "day", pairs, 60), lambda: R.dispersion_interval(moments, ["label"], "day", pairs, 60)):
        grouped = sorted(map(tuple, f().select("label", "day_a", "day_b", "low", "high").collect()))
        with monkeypatch.context() as m:
            m.setattr(G, "NUMBERS", 0)
            joined = sorted(map(tuple, f().select("label", "day_a", "day_b", "low", "high").collect()))
        assert [r[:3] for r in grouped] == [r[:3] for r in joined] and len(grouped) == 12
        assert np.allclose([r[3:] for r in grouped], [r[3:] for r in joined], rtol=0, atol=1e-9)


@pytest.mark.parametrize("few", [1, 5, 4096])
@pytest.mark.parametrize("level", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_percentiles_in_rounds_equal_those_of_one_aggregate(spark, few, level):
    rng = random.Random(9)
    rows = [("normal", rng.gauss(0, 1)) for _ in range(700)] + [("same", 2.5)] * 50 + [("one", -1.0)]
    rows += [("far", x) for x in (-1e308, 1e308, 0.0, 5e-324, 1e-300, 3.0)] + [("two", float(i % 2)) for i in range(200)]
    rows += [("hot", 1.0 + rng.random() * 1e-12) for _ in range(300)] + [("hot", 1e9), ("hot", -1e9)]
    rows += [("whole", float(rng.randint(0, 9))) for _ in range(500)] + [("normal", None), ("normal", float("nan")), ("none", None)]
    rows += [(None, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, x double")
    want = df.where("x is not null and not isnan(x)").groupBy("g").agg(F.count("*").alias("n"), F.percentile("x", F.lit(level)).alias("percentile"))
    found = PC.exact(df, ["g"], "x", level, few=few, buckets=16)
    key = lambda r: (r["g"] or "", r["n"], r["percentile"])
    assert sorted(map(key, found.collect())) == sorted(map(key, want.collect()))
    whole = PC.exact(df, [], "x", level, few=few).first()
    assert whole["percentile"] == df.where("not isnan(x)").agg(F.percentile("x", F.lit(level))).first()[0]
    rounds = PC.of_groups(df, ["g"], F.col("x"), level, most=10)
    assert sorted(map(key, rounds.collect())) == sorted(map(key, want.collect()))


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert PC.exact(df, ["g"], "x", 0.5).count() == 0 and PC.exact(df, [], "x", 0.5).count() == 0
    assert PC.of_groups(df, [], F.col("x"), 0.5).count() == 0


def plain_matches(true, pred, tolerance):
    return MT._greedy(np.array(sorted(true)).reshape(-1, 2), np.array(sorted(pred)).reshape(-1, 2), tolerance)


@pytest.mark.parametrize("many", [3, 40, 10**9])
def test_matches_in_stretches_equal_those_of_one_sweep(spark, many):
    rng = random.Random(6)
    true, pred, want = [], [], {}
    for name in "abcdef":
        at, own, found = 0.0, [], []
        for _ in range(rng.choice([0, 3, 120])):
            at += rng.choice([0.004, 0.02, 0.3, 2.0])
            own.append((at, at + 0.1))
            for _ in range(rng.choice([0, 1, 1, 2])):
                a = at + rng.choice([0, -0.01, 0.01, 0.004, -0.02, rng.uniform(-0.03, 0.03)])
                found.append((a, a + 0.1 + rng.choice([0, 0.005, 0.03])))
        if name == "f":
            own = []
        true += [(name, *s) for s in own]
        pred += [(name, *s) for s in found]
        if own or found:
            want[name] = (len(own), len(found), plain_matches(own, found, 0.01))
    sides = [spark.createDataFrame(rows, "file string, onset_s double, offset_s double") for rows in (true, pred)]
    counts = MT.segment_counts(*sides, ["file"], 0.01, many=many)
    assert {r["file"]: (r["n_true"], r["n_pred"], r["n_matched"]) for r in counts.collect()} == want


def test_a_long_file_is_many_groups(spark):
    rows = spark.range(20_000).selectExpr("'only' as file", "id * 0.5 as onset_s", "id * 0.5 + 0.1 as offset_s", "true as _true")
    parts = MT.islands(rows, ["file"], "onset_s", 0.01)
    sizes = [r["count"] for r in parts.groupBy("file", "_island").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= 6000 and len(sizes) >= 4
    chained = rows.withColumn("onset_s", F.col("onset_s") / 100)  # no gap over the tolerance: one island, whatever the stretches
    assert MT.islands(chained, ["file"], "onset_s", 0.01, many=1000).select("_island").distinct().count() == 1


def stream_rows(seed=1):
    rng = random.Random(seed)
    begin = dt.datetime(2024, 5, 1)
    rows = []
    for i in range(900):
        ts = begin + dt.timedelta(seconds=rng.randint(0, 4 * 86_400 - 1))
        rows.append((f"b{i % 2}", "ab"[i % 3 == 0], ts.date(), f"bout{rng.randint(0, 5)}", ts, [rng.gauss(ts.day, 1), rng.gauss(0, 2)]))
    return rows


POINTS = "bird string, label string, day date, bout string, ts timestamp, z array<double>"


def written(spark, rows, folder, files):
    for i in range(files):
        spark.createDataFrame(rows[i::files], POINTS).coalesce(1).write.mode("append").parquet(folder)


def kept_up(spark, folder, where, **options):
    stream = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 2).parquet(folder)
    query = SD.keep_up(stream, f"{where}/table", f"{where}/checkpoint", late="10 days", **options)
    query.awaitTermination(180)
    assert query.exception() is None
    return SD.moments(spark, f"{where}/table")


def as_dict(df):
    return {(r["bird"], r["label"], r["day"], r["bout"], r["dim"]): (r["n"], r["sx"], r["sxx"]) for r in df.collect()}


def same(found, want):
    assert found.keys() == want.keys()
    assert all(found[k][0] == want[k][0] and np.allclose(found[k][1:], want[k][1:], rtol=1e-12) for k in want)


def test_a_stream_in_any_order_and_started_anew_equals_the_whole_table(spark, tmp_path):
    rows = stream_rows()
    keys = ["bird", "label", "day"]
    whole = M.bout_moments(spark.createDataFrame(rows, POINTS), keys)
    random.Random(3).shuffle(rows)
    folder, where = str(tmp_path / "in"), str(tmp_path)
    written(spark, rows[:500], folder, 4)
    first = kept_up(spark, folder, where)
    same(as_dict(first), as_dict(M.bout_moments(spark.createDataFrame(rows[:500], POINTS), keys)))
    written(spark, rows[500:], folder, 3)  # the query starts anew from its checkpoint
    found = kept_up(spark, folder, where)
    same(as_dict(found), as_dict(whole))
    drifts = [D.centroid_drift(M.unit_moments(M.bout_means(m), keys), ["bird", "label"], "day").orderBy("bird", "label", "day_a", "day_b").collect() for m in (found, whole)]
    assert [r[:4] for r in drifts[0]] == [r[:4] for r in drifts[1]] and len(drifts[0]) == 24
    assert np.allclose([r["drift"] for r in drifts[0]], [r["drift"] for r in drifts[1]])
    floors = [R.floor_of(R.centroid_null(M.bout_means(m), keys, 40), ["bird"], "drift").orderBy("bird").collect() for m in (found, whole)]
    assert np.allclose([r["floor"] for r in floors[0]], [r["floor"] for r in floors[1]])
    SD.compacted(spark, f"{where}/table", f"{where}/compact")
    same(as_dict(SD.moments(spark, f"{where}/compact")), as_dict(whole))


def test_days_close_when_the_watermark_has_passed_them(spark, tmp_path):
    rows = sorted(stream_rows(), key=lambda r: r[4])
    for i in range(6):  # one file after the other in time
        spark.createDataFrame(rows[i * 150 : (i + 1) * 150], POINTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = SD.keep_up(stream, f"{tmp_path}/table", f"{tmp_path}/checkpoint", late="1 hour")
    query.awaitTermination(180)
    found = SD.latest(spark, f"{tmp_path}/table").groupBy("day").agg(F.min("closed").alias("closed"), F.sum("n").alias("n")).orderBy("day").collect()
    assert [r["closed"] for r in found] == [True, True, True, False]
    assert sum(r["n"] for r in found) == len(rows)


def clouds(n=3000, d=6, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 20, (12, d))
    z = centres[rng.integers(0, 12, n)] + rng.normal(0, 1, (n, d))
    z[: n // 3] = z[0]  # a third of all vectors are one
    return [(i, int(i % 7), v) for i, v in enumerate(z.tolist())]


@pytest.mark.parametrize("k", [1, 5])
def test_neighbours_by_bounds_equal_those_by_all_distances(spark, k):
    from driftloom.operators import fidelity as FD
    from driftloom.operators import neighbours as N

    df = spark.createDataFrame(clouds(), "id long, label int, z array<double>")
    asked, counted = df.where("id % 3 = 1"), []
    found = N.nearest(asked, df, k, cell=50, counted=counted)
    want = FD.nearest(asked, df, k)
    columns = ["id", "rank", "other", "other_label"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    # far less than all: but for the third that is one vector, which no bound can part
    assert sum(counted) < 0.55 * asked.count() * df.count()


def test_neighbours_of_few_and_of_nothing(spark):
    from driftloom.operators import neighbours as N

    df = spark.createDataFrame(clouds(5), "id long, label int, z array<double>")
    assert N.nearest(df, df, 10).groupBy("id").count().select("count").distinct().collect() == [(4,)]
    assert N.nearest(df, df.limit(0), 3).count() == 0 and N.nearest(df.limit(0), df, 3).count() == 0
    apart = spark.createDataFrame([(i, 0, v) for i, _, v in clouds(400, 40, 3)], "id long, label int, z array<double>")  # bounds help little
    assert N.nearest(apart, apart, 3, cell=20).count() == 1200


def test_weights_of_neighbours():
    from driftloom.operators import layout as LO

    d = np.sort(np.random.default_rng(0).random((50, 15)), axis=1)
    d[3, 10:] = np.nan
    d[4, :2] = 0.0
    w = LO.smooth(d)
    k = np.full(50, 15)
    k[3] = 10
    assert np.allclose(np.nansum(w, axis=1), np.log2(k), atol=1e-6)
    assert np.allclose(w[np.arange(50) != 4, 0], 1) and np.nanmax(w) <= 1


def test_a_layout_keeps_clusters_and_agrees_with_itself(spark):
    from driftloom.operators import fidelity as FD
    from driftloom.operators import layout as LO

    rng = np.random.default_rng(5)
    centres = rng.normal(0, 6, (6, 20))
    rows = [(i, i % 6, (centres[i % 6] + rng.normal(size=20)).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, label int, z array<double>")
    train = df.where("id < 400")
    edges = LO.edges(train, 10)
    assert edges.where("a >= b or w <= 0 or w > 1 + 1e-9").count() == 0
    first, again = (LO.fitted(train, 2, k=10, epochs=60, seed=3) for _ in range(2))
    assert sorted(map(tuple, first[1].collect())) == sorted(map(tuple, again[1].collect()))
    out = LO.placed(df, *first, k=10)
    assert out.count() == 600 and out.select(F.size("z")).distinct().collect() == [(2,)]
    assert FD.purity(out.select("id", "label", "z")).first()[0] > 0.97
    assert FD.purity(out.where("id >= 400").select("id", "label", "z")).first()[0] > 0.97
    one = LO.fitted(df.limit(1), 3)
    assert LO.placed(df.where("id < 3"), *one).count() == 3


def test_means_by_day_do_not_depend_on_how_the_events_lie_in_files(spark, tmp_path):
    import duckdb

    from driftloom.plans import catalogue

    rng = random.Random(5)
    rows, begin = [], dt.datetime(2024, 1, 1)
    for user in range(300):  # 32 values of two places: their mean often ends in a 5 at the seventh place
        for i in range(34):
            kind = "signup" if i == 32 else "view"
            rows.append((0, begin + dt.timedelta(days=max(i // 16, i - 30), seconds=i), user, kind, rng.randint(0, 20_000) / 100))
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").orderBy("event_id")
    df.coalesce(1).write.parquet(f"{tmp_path}/one/events.parquet")
    df.repartition(7, F.xxhash64("event_id")).orderBy(F.xxhash64("event_id")).write.parquet(f"{tmp_path}/many/events.parquet")
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/one/events.parquet/*.parquet')")
    found = con.execute(catalogue.ORACLES["pre_post_event"])
    columns = [c[0] for c in found.description]
    want = sorted(found.fetchall())
    assert len(want) == 300
    for folder in ("one", "many"):
        got = catalogue.QUERIES["pre_post_event"](spark, f"{tmp_path}/{folder}")
        assert sorted(map(tuple, got.select(*columns).collect())) == want
