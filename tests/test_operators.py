"""Operators against numpy and worked examples."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.functions import distributions, scalars
from driftloom.operators import clean, draws, drift, embedding, fidelity, groups, matching, moments, power, resampling, sessions
from driftloom.streaming import sessions as streaming


def cloud(spark, rows, keys="day int"):
    return spark.createDataFrame(rows, f"{keys}, bout string, z array<double>")


def clustered(seed, day, bouts=12, each=5, d=3, shift=0.0, spread=1.0):
    rng = np.random.default_rng(seed)
    out = []
    for b in range(bouts):
        centre = rng.normal(size=d) * 2
        out += [(day, f"{day}:{b}", (centre + spread * rng.normal(size=d) * 0.5 + shift).tolist()) for _ in range(each)]
    return out


def bout_means(rows):
    names = sorted({r[1] for r in rows})
    return np.stack([np.mean([r[2] for r in rows if r[1] == b], axis=0) for b in names])


def unbiased(a, b):
    gap = ((a.mean(0) - b.mean(0)) ** 2).sum()
    return gap - a.var(0, ddof=1).sum() / len(a) - b.var(0, ddof=1).sum() / len(b)


def test_centroid_drift_equals_numpy(spark):
    a, b = clustered(1, 1), clustered(2, 2, shift=0.4)
    found = drift.drift_of_points(cloud(spark, a + b), [], "day").first()
    assert found["drift"] == pytest.approx(unbiased(bout_means(a), bout_means(b)))
    assert found["naive"] == pytest.approx(((bout_means(a).mean(0) - bout_means(b).mean(0)) ** 2).sum())


def test_drift_without_change_has_both_signs(spark):
    rows = [r for i in range(24) for r in clustered(i, i, bouts=8)]
    signs = {r["drift"] > 0 for r in drift.drift_of_points(cloud(spark, rows), [], "day").collect()}
    assert signs == {True, False}


def test_one_bout_on_a_side_gives_no_drift(spark):
    rows = clustered(1, 1) + clustered(2, 2, bouts=1)
    assert drift.drift_of_points(cloud(spark, rows), [], "day").count() == 0


def test_dispersion_is_antisymmetric_and_ignores_shifts(spark):
    a, b = clustered(1, 1, spread=1), clustered(1, 2, spread=1, shift=50.0)
    wide = [(3, x[1], (np.array(x[2]) * 2).tolist()) for x in a]
    tv = drift.variance_of_points(cloud(spark, a + b + wide), ["day"])
    want = np.array([r[2] for r in a]).var(0, ddof=1).sum()
    assert tv.where("day = 1").first()["tv"] == pytest.approx(want)
    assert moments.total_variance(moments.bout_moments(cloud(spark, a), ["day"]), ["day"]).first()["tv"] == pytest.approx(want)
    found = {(r["day_a"], r["day_b"]): r["log_ratio"] for r in drift.dispersion_drift(tv, [], "day", F.col("day_a") != F.col("day_b")).collect()}
    assert found[1, 2] == pytest.approx(0, abs=1e-9)
    assert found[1, 3] == pytest.approx(math.log(4))
    assert found[3, 1] == pytest.approx(-math.log(4))


def test_centring_changes_nothing(spark):
    rows = clustered(1, 1) + clustered(2, 2)
    plain = drift.drift_of_points(cloud(spark, rows), [], "day").first()["drift"]
    moved = drift.drift_of_points(moments.centred(cloud(spark, rows), []), [], "day").first()["drift"]
    assert moved == pytest.approx(plain)


def test_bigrams_and_divergence(spark):
    rows = [(d, f"{d}{b}", i, c) for d, words in ((1, ["abab", "ab"]), (2, ["abab", "ab"]), (3, ["cdcd"])) for b, w in enumerate(words) for i, c in enumerate(w)]
    df = spark.createDataFrame(rows, "day int, bout string, i int, label string")
    pairs = sessions.bigrams(df, ["bout"], ["i"], "label", ["day"])
    counts = {tuple(r) for r in pairs.where("day = 1").groupBy("first", "second").count().collect()}
    assert counts == {("a", "b", 3), ("b", "a", 1)}
    found = {(r["day_a"], r["day_b"]): r["jsd"] for r in drift.syntax_drift(drift.transition_shares(pairs, ["day"]), "day").collect()}
    assert found[1, 2] == pytest.approx(0)
    assert found[1, 3] == pytest.approx(1)


def test_splicing_labels(spark):
    df = spark.createDataFrame([("x", i, c) for i, c in enumerate("axb")], "bout string, i int, label string")
    spliced = sessions.bigrams(df, ["bout"], ["i"], "label", types=["a", "b"])
    assert [tuple(r)[1:] for r in spliced.collect()] == [("a", "b")]
    assert sessions.bigrams(df, ["bout"], ["i"], "label", types=["a", "b"], splice=False).count() == 0


def test_sessions(spark):
    df = spark.createDataFrame([("u", float(t)) for t in (306, 0, 2, 4, 304, 308, 368)], "u string, t double")
    found = sorted(tuple(r) for r in sessions.sessions(df, ["u"], F.col("t"), 60.0).select("t", "bout").collect())
    assert [b for _, b in found] == [0, 0, 0, 1, 1, 1, 1]
    with pytest.raises(ValueError, match="positive"):
        sessions.sessions(df, ["u"], F.col("t"), 0)


def test_suggested_gap_lies_between(spark):
    stamps = [(run * 640 + 2 * i,) for run in range(30) for i in range(20)]
    df = spark.createDataFrame([(float(t),) for (t,) in stamps], "t double").withColumn("u", F.lit(1))
    gap = sessions.suggested_gap(df, ["u"], F.col("t")).first()["gap_s"]
    assert 2 < gap < 600
    assert sessions.suggested_gap(df.limit(2), ["u"], F.col("t")).count() == 0


def test_runs_are_bridged_before_short_ones_go(spark):
    df = spark.createDataFrame([("f", 0.0, 0.015), ("f", 0.02, 0.04), ("f", 1.0, 1.01), ("f", 2.0, 2.5)], "f string, onset_s double, offset_s double")
    found = sorted((r["onset_s"], r["offset_s"]) for r in sessions.merged_runs(df, ["f"], 0.02, 0.02).collect())
    assert found == [(0.0, 0.04), (2.0, 2.5)]


def test_halves_are_disjoint_and_whole(spark):
    units = spark.createDataFrame([(k, f"b{i}") for k, n in ((1, 9), (2, 3)) for i in range(n)], "k int, bout string")
    rows = resampling.split_halves(units, ["k"], 30).collect()
    assert {r["k"] for r in rows} == {1}
    lefts = set()
    for d in range(1, 31):
        mine = [r for r in rows if r["draw"] == d]
        assert len(mine) == 9
        left = frozenset(r["bout"] for r in mine if r["is_left"])
        assert len(left) == 4
        lefts.add(left)
    assert len(lefts) > 20


def test_null_draws_equal_numpy(spark):
    rows = clustered(3, 1, bouts=9)
    m = moments.bout_moments(cloud(spark, rows), ["day"])
    chosen = resampling.split_halves(resampling.units_of(m, ["day"]), ["day"], 10)
    sides = {}
    for r in chosen.collect():
        sides.setdefault((r["draw"], r["is_left"]), set()).add(r["bout"])
    centroid = {r["draw"]: r["drift"] for r in resampling.centroid_draws(moments.bout_means(m), chosen, ["day"]).collect()}
    spread = {r["draw"]: r["log_ratio"] for r in resampling.dispersion_draws(m, chosen, ["day"]).collect()}
    for d in range(1, 11):
        left, right = ([r for r in rows if r[1] in sides[d, s]] for s in (True, False))
        assert centroid[d] == pytest.approx(unbiased(bout_means(left), bout_means(right)))
        tv = [np.array([r[2] for r in x]).var(0, ddof=1).sum() for x in (left, right)]
        assert spread[d] == pytest.approx(math.log(tv[1] / tv[0]))


def test_bootstrap_keeps_or_collapses_repeats(spark):
    rows = clustered(4, 1, bouts=10) + clustered(5, 2, bouts=10, shift=1.5)
    m = moments.bout_moments(cloud(spark, rows), ["day"])
    drawn = resampling.resamples(resampling.units_of(m, ["day"]), ["day"], 20)
    assert {r["n"] for r in drawn.groupBy("day", "draw").agg(F.sum("w").alias("n")).collect()} == {10}
    pairs = spark.createDataFrame([(1, 2)], "day_a int, day_b int")
    names = {}
    for r in drawn.collect():
        names.setdefault((r["day"], r["draw"]), []).extend([r["bout"]] * r["w"])
    for collapse in (True, False):
        found = {r["draw"]: r["drift"] for r in resampling.bootstrap_centroid(moments.bout_means(m), [], "day", pairs, 20, collapse=collapse).collect()}
        for d in range(1, 21):
            sides = []
            for day in (1, 2):
                chosen = sorted(set(names[day, d])) if collapse else names[day, d]
                sides.append(np.concatenate([bout_means([r for r in rows if r[1] == b]) for b in chosen]))
            assert found[d] == pytest.approx(unbiased(*sides))
    ci = resampling.interval(resampling.bootstrap_centroid(moments.bout_means(m), [], "day", pairs, 200), ["day_a", "day_b"], "drift").first()
    assert ci["low"] < ci["high"]


def test_both_ways_of_drawing_agree(spark, monkeypatch):
    """Groups as matrices, and draws joined with bouts: five dimensions, groups of unequal size, one of them too small."""
    rng = np.random.default_rng(9)
    rows = [(k, d, f"b{i}", (rng.normal(size=5) * (1 + k) + 10 * k).tolist()) for k in (1, 2) for d in (1, 2) for i in range(8 * k + d) for _ in range(3)]
    rows += [(3, 1, f"b{i}", [0.0] * 5) for i in range(3)]
    df = spark.createDataFrame(rows, "k int, d int, bout string, z array<double>")
    m = moments.bout_moments(df, ["k", "d"]).persist()
    means = moments.bout_means(m)
    pairs = spark.createDataFrame([(1, 1, 2), (2, 1, 2)], "k int, d_a int, d_b int")
    turns = [(1 + i % 2, 1, f"b{i % 15}", *random.Random(i).choices("abc", k=2)) for i in range(400)]
    sequence = spark.createDataFrame(turns, "k int, d int, bout string, first string, second string")
    by = ["k", "d"]

    def all_ways():
        found = [
            resampling.centroid_null(means, by, 20, 3), resampling.dispersion_null(m, by, 20, 3), resampling.dispersion_of_subsets(m, by, 3, 20, 3),
            power.directed_draws(means, by, 3, 20, 3), resampling.bootstrap_dispersion(m, ["k"], "d", pairs, 20, 3),
            resampling.syntax_null(sequence, by, 20, 3),
            *[resampling.bootstrap_centroid(means, ["k"], "d", pairs, 20, 3, collapse=c) for c in (True, False)],
        ]
        return [sorted(tuple(r) for r in x.collect()) for x in found]

    as_matrices = all_ways()
    assert all(as_matrices)
    monkeypatch.setattr(draws, "NUMBERS", 40)
    for a, b in zip(as_matrices, all_ways()):
        assert [x[:3] for x in a if isinstance(x[2], int)] == [x[:3] for x in b if isinstance(x[2], int)]
        assert np.array(a, float) == pytest.approx(np.array(b, float), abs=1e-9)


def test_power_grows_with_the_effect_and_null_means_unreachable(spark):
    rows = clustered(6, 1, bouts=40, each=4)
    m = moments.bout_moments(cloud(spark, rows), ["day"])
    curve = power.centroid_power(moments.bout_means(m), ["day"], 10, 4.0, (0.0001, 0.5, 5.0, 50.0), n_draws=100)
    by = {r["effect"]: r["power"] for r in curve.collect()}
    assert by[0.0001] < 0.3
    assert by[50.0] == 1.0
    assert [by[e] for e in sorted(by)] == sorted(by.values())
    assert power.least_detectable(curve, ["day"], "effect").first()["least"] in (0.5, 5.0, 50.0)
    assert power.least_detectable(curve.where("effect < 0.01"), ["day"], "effect").first()["least"] is None
    folds = {r["fold"]: r["power"] for r in power.dispersion_power(m, ["day"], 10, (1.0001, 8.0), n_draws=100).collect()}
    assert folds[8.0] > 0.9 > folds[1.0001]


def people(spark, treated, control):
    rows = [(i, "treated", x) for i, x in enumerate(treated)] + [(100 + i, "control", x) for i, x in enumerate(control)]
    return spark.createDataFrame(rows, "bird int, group string, x double")


def test_permutations(spark):
    t, c = [0.30, 0.28, 0.35, 0.31, 0.33, 0.29], [0.05, 0.04, 0.06, 0.05, 0.03, 0.05]
    found = groups.permutation_p(people(spark, t, c), "bird", "group", "x").first()
    assert (found["n_labelings"], found["n_extreme"]) == (924, 2)
    assert found["p_value"] == pytest.approx(3 / 925)
    few = groups.permutation_p(people(spark, t[:3], c[:3]), "bird", "group", "x", alternative="greater").first()
    assert few["p_value"] == pytest.approx(2 / 21)
    drawn = groups.permutation_p(people(spark, t, c), "bird", "group", "x", n_permutations=300).first()
    assert drawn["n_labelings"] == 300
    assert drawn["p_value"] < 0.05
    with pytest.raises(ValueError, match="alternative"):
        groups.permutation_p(people(spark, t, c), "bird", "group", "x", alternative="other")
    with pytest.raises(ValueError, match="2 individuals"):
        groups.permutation_p(people(spark, t[:1], c), "bird", "group", "x")


def test_comparison(spark):
    t, c = [0.30, 0.28, 0.35, 0.31], [0.05, 0.04, 0.06, 0.05, 0.03]
    r = groups.compare_groups(people(spark, t, c), "bird", "group", "x", within_sd=0.5, n_boot=200).first()
    assert r["observed_difference"] == pytest.approx(np.mean(t) - np.mean(c))
    assert r["ci_low"] < r["observed_difference"] < r["ci_high"]
    assert r["between_sd"] == pytest.approx(np.std(np.r_[t - np.mean(t), c - np.mean(c)], ddof=1))
    assert r["limiting_factor"] == "within-bird"


def test_sizes(spark):
    curve = groups.power_by_size(spark, 0.1, 0.05, max_n=8, n_simulations=100)
    assert 4 <= groups.birds_needed(curve).first()["n_needed"] <= 7
    assert groups.birds_needed(groups.power_by_size(spark, 0.001, 0.05, max_n=4, n_simulations=50)).first()["n_needed"] is None


def segments(spark, rows):
    return spark.createDataFrame([("f", float(a), float(b)) for a, b in rows], "f string, onset_s double, offset_s double")


def test_matches_are_one_to_one(spark):
    true = [(0, 0.1), (0.5, 0.7), (1, 1.4)]
    for pred, n in (([(0.005, 0.102), (0.497, 0.704), (1.0, 1.42)], 2), ([(0, 0.1), (0.001, 0.1)], 1), (true[::-1], 3), ([], 0)):
        counts = matching.segment_counts(segments(spark, true), segments(spark, pred), ["f"])
        assert matching.pooled(counts).first()["n_matched"] == n
    late = matching.boundary_counts(segments(spark, true), segments(spark, [(0, 0.2), (0.5, 0.9), (1, 1.5)]), ["f"], "onset_s")
    assert matching.pooled(late).first()["f1"] == 1.0
    nothing = matching.pooled(spark.createDataFrame([(0, 0, 0)], "n_true long, n_pred long, n_matched long")).first()
    assert (nothing["precision"], nothing["recall"], nothing["f1"]) == (1.0, 1.0, 1.0)


def edits(a, b):
    """The distance by its recurrence."""
    if not a or not b:
        return len(a) + len(b)
    if a[0] == b[0]:
        return edits(a[1:], b[1:])
    return 1 + min(edits(a[1:], b), edits(a, b[1:]), edits(a[1:], b[1:]))


def test_token_distance_equals_its_recurrence(spark):
    """Random sequences over tokens of one to three characters, some of them parts of others."""
    rng = random.Random(12)
    tokens = ["x", "xy", "yx", "xyz", "z", "é", "  "]
    rows = [(i, rng.choices(tokens, k=rng.randint(0, 6)), rng.choices(tokens, k=rng.randint(0, 6))) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    found = {r[0]: r[1] for r in df.select("i", scalars.token_distance(F.col("a"), F.col("b"))).collect()}
    assert found == {i: edits(a, b) for i, a, b in rows}
    rates = {r[0]: r[1] for r in df.where("size(a) > 0").select("i", scalars.token_error_rate(F.col("a"), F.col("b"))).collect()}
    assert rates == {i: pytest.approx(edits(a, b) / len(a)) for i, a, b in rows if a}
    with pytest.raises(Exception, match="empty"):
        df.select(scalars.token_error_rate(F.array().cast("array<string>"), F.col("b"))).collect()


def test_accuracy(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "t string, p string")
    assert matching.label_accuracy(df, "t", "p").first()[0] == 0.5
    assert matching.label_accuracy(df.limit(0), "t", "p").first()[0] == 1.0


def blobs(spark, spread=0.05):
    rng = np.random.default_rng(0)
    rows = [(i * 100 + k, i, (5 * np.eye(3)[i] + spread * rng.normal(size=3)).tolist()) for i in range(3) for k in range(30)]
    return rows, spark.createDataFrame(rows, "id int, label int, z array<double>")


def test_fidelity(spark):
    rows, df = blobs(spark)
    assert fidelity.purity(df).first()[0] == 1.0
    assert fidelity.silhouette(df).first()[0] > 0.9
    found = fidelity.knn_recovery(df.where("id % 3 <> 0"), df.where("id % 3 = 0"), 5)
    assert found.where("label <> predicted").count() == 0
    with pytest.raises(ValueError):
        fidelity.knn_recovery(df.limit(3), df, 5)
    with pytest.raises(ValueError):
        fidelity.silhouette(df.where("label = 0"))


def test_silhouette_equals_its_definition(spark):
    rows, df = blobs(spark, 4.0)
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(len(x)):
        a = d[i, y == y[i]].sum() / ((y == y[i]).sum() - 1)
        b = min(d[i, y == k].mean() for k in set(y) - {y[i]})
        s.append((b - a) / max(a, b))
    assert fidelity.silhouette(df).first()[0] == pytest.approx(np.mean(s))


def test_distances_within_labels(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 4))
    turn = np.linalg.qr(rng.normal(size=(4, 4)))[0]
    rows = [(i, i % 2, (x[i] @ turn).tolist(), x[i].tolist(), [1.0] * 4) for i in range(80)] + [(99, 7, [0.0] * 4, [1.0] * 4, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id int, label int, z array<double>, reference array<double>, flat array<double>")
    assert fidelity.pair_weighted(fidelity.within_label_correlation(df)).first()[0] == pytest.approx(1.0)
    flat = fidelity.within_label_correlation(df.drop("z").withColumnRenamed("flat", "z"))
    assert {r["rho"] for r in flat.collect()} == {0.0}
    assert {r["label"] for r in flat.collect()} == {0, 1}


def test_components_keep_drift(spark):
    rng = np.random.default_rng(2)
    rows = [("x", d, f"{d}:{b}", rng.normal(size=6).tolist()) for d in (1, 2) for b in range(8) for _ in range(3)]
    df = spark.createDataFrame(rows, "bird string, day int, bout string, features array<double>")
    full = drift.drift_of_points(df.withColumnRenamed("features", "z"), ["bird"], "day").first()["drift"]
    z = embedding.embedded(df, ["bird"], "day", 6)
    assert drift.drift_of_points(z, ["bird"], "day").first()["drift"] == pytest.approx(full)
    assert len(embedding.embedded(df, ["bird"], "day", 2).first()["z"]) == 2
    model = embedding.fitted_pca(df.where("day = 1"), 6, "features")
    assert embedding.explained_variance(model) == pytest.approx(1.0)
    centres = embedding.modes(df.withColumn("k", F.monotonically_increasing_id()), 2, "k", "features")
    assert embedding.assigned(df, centres, "features").select("mode").distinct().count() == 2


def test_clamping_counts(spark):
    df = spark.createDataFrame([(-1.0, 2.0), (1.0, 9.0), (6.0, 9.0), (1.0, 2.0)], "onset_s double, offset_s double")
    kept, counts = clean.repaired(df, 0.0, 5.0)
    assert sorted(map(tuple, kept.collect())) == [(0.0, 2.0), (1.0, 2.0), (1.0, 5.0)]
    assert tuple(counts.first()) == (1, 2, 1)


def test_filters_count_what_they_drop(spark):
    df = spark.createDataFrame([("a", 1)] * 5 + [("b", 1)] * 2, "label string, day int")
    kept, dropped = clean.rare_filter(df, ["label"], 3)
    assert kept.count() == 5
    assert dropped.first()["n"] == 2
    assert clean.stratified_cap(df.withColumn("k", F.monotonically_increasing_id()), ["label"], "k", 2).count() == 4
    assert clean.stratified_cap(df, ["label"], "day", 0).count() == 7
    with pytest.raises(ValueError, match="days"):
        clean.with_days(df.withColumn("bird", F.lit("x")))
    clean.has_groups(df, "label", ["a", "b"])
    with pytest.raises(ValueError):
        clean.has_groups(df, "label", ["a", "c"])


def test_split_is_by_label(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(40)], "id int, label int")
    n = clean.train_test(df, ["label"], "id").groupBy("label").agg(F.count_if("is_train").alias("n")).collect()
    assert {r["n"] for r in n} == {14}


def test_dates(spark):
    assert scalars.date_pattern("%Y_%m_%d_%H_%M_%S") == "yyyy_MM_dd_HH_mm_ss"
    assert scalars.date_pattern("%Y-%m-%dT%H%M") == "yyyy-MM-dd'T'HHmm"
    with pytest.raises(ValueError, match="unsupported"):
        scalars.date_pattern("%Q")
    row = spark.range(1).select(scalars.excel_day(F.lit(42370.9)), scalars.stamp(F.lit("2024-05-01T0830"), "%Y-%m-%dT%H%M"), scalars.stamp(F.lit("x"), "%Y")).first()
    assert tuple(row) == (dt.date(2016, 1, 1), dt.datetime(2024, 5, 1, 8, 30), None)


def test_portable_hashes_agree_with_python(spark):
    import hashlib

    row = spark.range(1).select(scalars.portable_hash(F.lit(3), F.lit("x")), scalars.portable_index(scalars.portable_hash(F.lit(3), F.lit("x")), F.lit(7))).first()
    digest = hashlib.md5(b"3:x").hexdigest()
    assert tuple(row) == (digest, int(digest[:8], 16) % 7)


def test_streamed_sessions_equal_batch(spark, tmp_path):
    stamps = [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s) for s in (0, 30, 90, 151, 400)]
    df = spark.createDataFrame([("u", t) for t in stamps], "u string, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = streaming.stream_sessions(stream, ["u"], "ts", 60)
    run = out.writeStream.format("memory").queryName("found").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    found = sorted(r["n"] for r in spark.table("found").collect())
    batch = sessions.sessions(df, ["u"], F.unix_seconds("ts"), 60).groupBy("bout").count().collect()
    assert found == sorted(r["count"] for r in batch) == [1, 1, 3]


def test_combinations_are_all_there(spark):
    found = {r["mask"] for r in groups.labelings(spark, 6, 3).collect()}
    assert found == {sum(1 << i for i in c) for c in itertools.combinations(range(6), 3)}
    assert groups.labelings(spark, 18, 2).count() == math.comb(18, 2)


def test_p_values_of_a_trend(spark):
    """Critical values as statistical tables print them; a rank correlation of 1 has p = 0."""
    for t, df, p in ((2.228, 10, 0.05), (12.706, 1, 0.05), (3.169, 10, 0.01), (1.0, 1, 0.5), (0.0, 5, 1.0), (2.0, 60, 0.050)):
        assert distributions.two_sided_p(t, df) == pytest.approx(p, abs=2e-4)
    rows = [(float(i), float(i**3)) for i in range(8)]
    found = distributions.trend(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    assert (found["n"], found["rho"], found["rho_p"]) == (8, pytest.approx(1.0), pytest.approx(0.0, abs=1e-6))
    slope, _ = np.polyfit([x for x, _ in rows], [y for _, y in rows], 1)
    assert found["slope"] == pytest.approx(slope)
    assert 0 < found["slope_p"] < 0.01
    assert distributions.trend(spark.createDataFrame(rows[:2], "x double, y double"), "x", "y").first()["rho_p"] is None


def test_what_no_query_calls(spark):
    labels = spark.createDataFrame([("a",)] * 3 + [("b",)], "label string")
    assert matching.majority_share(labels, "label").first()[0] == 0.75
    rows = spark.createDataFrame([(1, 5.0), (1, 3.0), (1, 9.0)], "k int, t double")
    left, right = (spark.createDataFrame([(1, i, x) for i, x in enumerate(s)], "k int, at int, label string") for s in ("abc", "abxd"))
    both = sorted(tuple(r) for r in matching.zipped(left, right, ["k"], "at", "label").select("place", "true_label", "predicted_label").collect())
    assert both == [(1, "a", "a"), (2, "b", "b"), (3, "c", "x")]
    assert rows.select(scalars.matlab_seconds("t")).first()[0] == 5.0 * 86_400


def test_a_set_of_renditions_and_its_summary(spark, tmp_path):
    from driftloom.plans import composites, report

    rows = spark.createDataFrame([(i, "abcd"[min(3, i // 10)], i % 3) for i in range(33)], "id int, label string, day int")
    kept, summary = composites.rendition_set(rows, "label", "day", "id", ["a"], 5, 2)
    assert {r["label"]: (r["n"], r["n_kept"], r["why"]) for r in summary.collect()} == {
        "a": (10, 0, "excluded"), "b": (10, 6, "kept"), "c": (10, 6, "kept"), "d": (3, 0, "rare"),
    }
    composites.write_set(kept, summary, str(tmp_path / "set"))
    assert spark.read.parquet(str(tmp_path / "set")).count() == 12
    assert {r["label"] for r in report.read_json(str(tmp_path / "set.summary.json"), spark)} == set("abcd")
