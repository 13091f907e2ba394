"""Signals, and the analysis end to end on generated recordings."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom import cli
from driftloom.operators import audio, drift
from driftloom.plans import analysis, report

RATE = 32_000


def tone(bursts, hertz=3000, seconds=2.0, rate=RATE):
    t = np.arange(int(seconds * rate)) / rate
    x = np.zeros_like(t)
    for a, b in bursts:
        x += np.where((t >= a) & (t < b), 0.5 * np.sin(2 * np.pi * hertz * t), 0)
    return x


def test_wav_round_trip():
    x = tone([(0.1, 0.2)], seconds=0.3)
    samples, rate = audio.decoded(audio.encoded(x))
    assert rate == RATE
    assert np.abs(samples[:, 0] - x).max() < 1e-3


def test_spectrogram_shape_and_pitch():
    spec = audio.Spectrogram(rows=32)
    x = spec.of(tone([(0.2, 0.3)]), RATE, 0.2, 0.3)
    assert x.shape == (32, 100)
    assert x.max() == 1.0
    assert x.min() >= 0
    low, high = (spec.of(tone([(0.2, 0.3)], h), RATE, 0.2, 0.3).mean(axis=1).argmax() for h in (2000, 6000))
    assert low < high
    assert spec.of(np.zeros(RATE), RATE, 0.1, 0.2).max() == 0
    with pytest.raises(ValueError):
        spec.of(np.zeros(RATE), RATE, 0.2, 0.1)
    with pytest.raises(ValueError):
        spec.of(np.zeros(RATE), RATE, 0.5, 1.5)


def test_spectrogram_spans_the_same_time_at_any_rate():
    spec = audio.Spectrogram()
    for rate in (32_000, 44_100):
        x = tone([(0.0, 0.18)], 2000, 0.2, rate) + tone([(0.18, 0.2)], 8000, 0.2, rate)
        late = spec.of(x, rate, 0.0, 0.2)
        assert late.shape == (32, 100)
        filled = np.flatnonzero(late.max(axis=0) > 0.5)
        assert late[:, filled[-1]].argmax() > late[:, 10].argmax()


def test_envelope_and_segments():
    bursts = [(0.2, 0.4), (0.8, 0.9), (1.5, 1.7)]
    found = audio.AmplitudeSegmenter(threshold=0.1).segments(tone(bursts), RATE)
    assert len(found) == 3
    assert np.abs(np.array(found) - np.array(bursts)).max() < 0.01
    assert audio.AmplitudeSegmenter().segments(np.zeros(RATE), RATE) == []
    assert audio.AmplitudeSegmenter().segments(np.zeros(0), RATE) == []
    loud = audio.AmplitudeSegmenter().envelope(tone(bursts), RATE)
    assert loud.max() == pytest.approx(1.0)
    outside = tone([(0.2, 1.0)], 100)
    inside = tone([(0.2, 1.0)], 3000)
    both = audio.AmplitudeSegmenter(smooth_ms=5)
    assert both.envelope(outside + 1e-3 * inside, RATE)[int(0.6 * RATE)] < 1.01
    assert np.abs(audio._filtered(outside, 500 / 16_000, 10_000 / 16_000)).max() < 0.05
    assert np.abs(audio._filtered(inside, 500 / 16_000, 10_000 / 16_000)[8000:]).max() == pytest.approx(0.5, abs=0.1)
    merged = audio.AmplitudeSegmenter(threshold=0.1, least_silence=0.5).segments(tone(bursts), RATE)
    assert len(merged) == 2


def test_threshold_tuning(spark):
    bursts = [(0.2, 0.4), (0.8, 0.9)]
    content = bytearray(audio.encoded(tone(bursts) + 0.01 * np.random.default_rng(0).normal(size=2 * RATE)))
    recordings = spark.createDataFrame([("f", content)], "audio_path string, content binary")
    truth = spark.createDataFrame([("f", a, b) for a, b in bursts], "audio_path string, onset_s double, offset_s double")
    best, f1 = audio.tuned_threshold(recordings, truth, (0.001, 0.2, 0.3))
    assert (best, f1) == (0.2, 1.0)
    assert audio.amplitude_segments(recordings, audio.AmplitudeSegmenter(threshold=0.2)).count() == 2


@pytest.fixture(scope="module")
def lab(tmp_path_factory):
    """Two individuals of two days, six bouts a day; the second one's 'a' rises on the later day."""
    root = tmp_path_factory.mktemp("lab")
    rng = np.random.default_rng(0)
    rows = ["bird,timestamp,audio_path,annot_path,group"]
    for bird, group in (("t1", "treated"), ("c1", "control")):
        for day, shift in (("2024-05-01", 0), ("2024-05-08", 900 if bird == "t1" else 0)):
            for k in range(6):
                x, notes = np.zeros(3 * RATE), ["onset_s,offset_s,label"]
                for i in range(8):
                    label = "ab"[i % 2]
                    a = 0.1 + 0.3 * i
                    hertz = (3000 + shift if label == "a" else 5000) + rng.normal(0, 20)
                    x += tone([(a, a + 0.12)], hertz, 3.0)
                    notes.append(f"{a},{a + 0.12},{label}")
                if k == 0:
                    notes.append("2.95,3.5,a")
                stem = root / f"{bird}_{day}_{k}.wav"
                stem.write_bytes(audio.encoded(x + 0.001 * rng.normal(size=len(x))))
                (root / f"{stem.name}.csv").write_text("\n".join(notes) + "\n")
                rows.append(f"{bird},{day}T0{k}:00:00,{stem},{stem}.csv,{group}")
    (root / "manifest.csv").write_text("\n".join(rows) + "\n")
    return root


def test_analysis_end_to_end(spark, lab, capsys):
    out, drift_csv = lab / "out/result.json", lab / "out/drift.csv"
    options = "--n-pca 6 --n-freq-bins 12 --min-renditions 10 --n-boot 30 --n-null 30".split()
    assert cli.main(["analyse", "--manifest", str(lab / "manifest.csv"), "--out", str(out), "--drift-out", str(drift_csv), *options]) == 0
    result = json.loads(out.read_text())
    assert set(result["birds"]) == {"t1", "c1"}
    (treated,), (control,) = (result["birds"][b]["day_pairs"] for b in ("t1", "c1"))
    assert treated["n_types_exceeding_centroid_floor"] >= 1
    assert treated["centroid_drift_standardised"] > 10 * abs(control["centroid_drift_standardised"])
    assert control["separation_days"] == 7
    assert control["syntax_divergence"] < 0.1
    assert result["birds"]["t1"]["n_syllables"] == 98
    assert result["birds"]["t1"]["reference_day"] == "2024-05-01"
    table = [x.split() for x in capsys.readouterr().out.splitlines()]
    assert ["t1", "98", "12", "2", "2"] in [x[:5] for x in table]
    lines = drift_csv.read_text().splitlines()
    assert lines[0] == "bird,drift"
    assert len(lines) == 3


def test_clamps_are_counted(spark, lab):
    table = spark.createDataFrame([("p", -0.1, 0.1), ("p", 0.1, 9.0), ("p", 4.0, 5.0), ("p", 0.2, 0.3)], "audio_path string, onset_s double, offset_s double")
    recordings = spark.createDataFrame([("p", bytearray(audio.encoded(tone([(0, 1)]))))], "audio_path string, content binary")
    found, counts = audio.spectrograms(table, recordings)
    assert found.count() == 3
    assert tuple(counts.first()) == (1, 2, 1)


def test_compare_and_plan(spark, tmp_path, capsys):
    good = tmp_path / "d.csv"
    good.write_text("bird,group,drift\n" + "".join(f"t{i},treated,{0.3 + 0.01 * i}\nc{i},control,{0.05 + 0.01 * i}\n" for i in range(6)))
    out = tmp_path / "c.json"
    assert cli.main(["compare", "--drift", str(good), "--out", str(out)]) == 0
    assert json.loads(out.read_text())["p_value"] < 0.01
    bad = tmp_path / "e.csv"
    bad.write_text("bird,drift\nx,1\n")
    assert cli.main(["compare", "--drift", str(bad), "--out", str(out)]) == 2
    assert cli.main(["compare", "--drift", str(tmp_path / "none.csv"), "--out", str(out)]) == 2
    assert cli.main(["compare", "--drift", str(good), "--treated", "other", "--out", str(out)]) == 2
    assert cli.main(["analyse", "--manifest", str(tmp_path / "none.csv"), "--out", str(out)]) == 2
    assert cli.main(["plan", "--effect", "0.1", "--between-bird-sd", "0.02", "--max-n", "6", "--n-simulations", "50"]) == 0
    assert "per group" in capsys.readouterr().out
    assert cli.main([]) == 1
    with pytest.raises(SystemExit) as stopped:
        cli.main(["--version"])
    assert stopped.value.code == 0


def small_points(spark):
    rng = np.random.default_rng(3)
    rows = [("x", f"2024-05-0{d}", lab, f"{d}:{b}", (rng.normal(size=2) + (3 * d if lab == "a" else 0)).tolist()) for d in (1, 2, 4) for lab in "ab" for b in range(6) for _ in range(4)]
    return spark.createDataFrame(rows, "bird string, d string, label string, bout string, z array<double>").withColumn("day", F.to_date("d"))


def test_analysis_of_points(spark):
    config = analysis.AnalysisConfig(n_boot=30, n_null=30, min_renditions=20)
    found = analysis.analyse_points(small_points(spark), config)
    pairs = {(str(r["day_a"]), str(r["day_b"])): r for r in found.pairs.collect()}
    assert len(pairs) == 3
    assert pairs["2024-05-01", "2024-05-04"]["n_types_exceeding_centroid_floor"] == 1
    first = drift.drift_of_points(small_points(spark).where("day < '2024-05-03'"), ["label"], "day").agg(F.avg("drift")).first()[0]
    assert pairs["2024-05-01", "2024-05-02"]["centroid_drift"] == pytest.approx(first)
    assert analysis.per_bird_drift(found).first()["drift"] == pytest.approx(max(r["centroid_drift_standardised"] for r in pairs.values()))
    assert analysis.by_separation(found.pairs).count() == 3
    assert analysis.day_matrix(found.pairs).columns == ["day_a", "2024-05-02", "2024-05-04"]
    again = analysis.analyse_points(small_points(spark), config)
    assert sorted(map(repr, again.pairs.collect())) == sorted(map(repr, found.pairs.collect()))
    with pytest.raises(ValueError, match="days"):
        analysis.analyse_points(small_points(spark).where("d = '2024-05-01'"), config)
    none = analysis.analyse_points(small_points(spark), analysis.AnalysisConfig(n_boot=10, n_null=10, min_renditions=20, min_bouts=99))
    assert none.birds.first()["centroid_floor"] is None
    assert none.pairs.agg(F.sum("n_types_exceeding_centroid_floor")).first()[0] == 0


class Panel:
    """Stands for one of matplotlib's axes, and writes down what is drawn."""

    def __init__(self):
        self.spans, self.bands, self.bars, self.title = [], [], {}, None

    def plot(self, x, y, style):
        self.spans.append((*x, y[0], style))

    def axhspan(self, low, high, **_):
        self.bands.append((low, high))

    def bar(self, x, heights):
        self.bars = dict(zip(x, heights))

    def set_title(self, title):
        self.title = title


def result_of(*values):
    pairs = [
        {"day_a": f"2024-05-0{i + 1}", "day_b": f"2024-05-0{i + 2}", "n_types": 2, "centroid_drift_standardised": v, "dispersion_drift": None,
         "syntax_divergence": 0.01, "n_types_exceeding_centroid_floor": 1, "n_types_exceeding_dispersion_floor": 0, "syntax_exceeds_floor": True}
        for i, v in enumerate(values)
    ]
    bird = {"n_syllables": 40, "n_bouts": 8, "n_days": 3, "types": ["a", "b"], "centroid_floor": 0.5, "within_type_variance": 2.0, "dispersion_floor": None, "syntax_floor": 0.004}
    return {"birds": {"x": {**bird, "day_pairs": pairs}, "another": {**bird, "centroid_floor": None, "day_pairs": []}}}


def test_a_panel_for_each_individual():
    made = []

    def panels(n):
        made.extend(Panel() for _ in range(n))
        return made

    # a distance is over its floor only if it is larger, so one of -0.3 is not over 0.25
    first, second = report.draw_drift(result_of(-0.3, 0.1, 0.3), "centroid", panels)
    assert first.bands == [(0, 0.25)]
    assert first.spans == [("2024-05-01", "2024-05-02", -0.3, ":"), ("2024-05-02", "2024-05-03", 0.1, ":"), ("2024-05-03", "2024-05-04", 0.3, "-")]
    assert second.spans == second.bands == []
    assert "another" in second.title
    either = result_of(0.1)
    either["birds"]["x"]["dispersion_floor"], either["birds"]["x"]["day_pairs"][0]["dispersion_drift"] = 0.2, -0.5
    drawn = report.draw_drift(either, "dispersion", lambda n: [Panel() for _ in range(n)])[0]
    assert drawn.bands == [(-0.2, 0.2)] and drawn.spans[0][2:] == (-0.5, "-")
    with pytest.raises(ValueError, match="no measure"):
        report.draw_drift(result_of(), "other", panels)
    power = report.draw_least({"centroid": {20: 0.1, 5: 0.5, 2: None}}, lambda n: [Panel() for _ in range(n)])
    assert power[0].bars == {"5": 0.5, "20": 0.1}
    with pytest.raises(ValueError, match="no effect"):
        report.draw_least({}, panels)


class CurvePanel:
    """What is drawn on a panel of curves or of a square."""

    def __init__(self):
        self.curves, self.square, self.title = [], None, ""

    def plot(self, x, y, form, label):
        self.curves.append((x, y, label))

    def imshow(self, square):
        self.square = square

    def set_title(self, title):
        self.title = title

    def set_xlabel(self, text):
        self.x = text

    def set_ylabel(self, text):
        self.y = text

    def set_xticks(self, at, names, rotation):
        self.columns = names

    def set_yticks(self, at, names):
        self.rows = names

    def legend(self):
        self.explained = True


def test_curves_of_a_study_and_squares_of_days():
    rows = [{"m": m, "n": n, "bouts": b, "least": e} for m, n, b, e in
            [("centroid", 2, 20, 0.1), ("centroid", 2, 5, 0.5), ("centroid", 1, 5, None), ("dispersion", 1, 10, 1.5)]]
    found = report.draw_curves(rows, "m", "n", "bouts", "least", lambda n: [CurvePanel() for _ in range(n)])
    assert [p.curves for p in found] == [[([5, 20], [0.5, 0.1], "2")], [([10], [1.5], "1")]]
    with pytest.raises(ValueError, match="no row"):
        report.draw_curves([{**r, "least": None} for r in rows], "m", "n", "bouts", "least")
    days, square = report.day_square(result_of(-0.3, 0.1)["birds"]["x"]["day_pairs"], "centroid_drift_standardised")
    assert days == ["2024-05-01", "2024-05-02", "2024-05-03"]
    assert square[0][1] == square[1][0] == -0.3 and square[1][2] == 0.1 and math.isnan(square[0][2]) and math.isnan(square[1][1])
    first, second = report.draw_matrices(result_of(-0.3, 0.1), "centroid", lambda n: [CurvePanel() for _ in range(n)])
    assert len(first.square) == 3 and "0.2500" in first.title
    assert second.square is None and second.title.endswith("floor -")
    with pytest.raises(ValueError, match="no measure"):
        report.draw_matrices(result_of(), "other")


def test_tables_of_text():
    lines = report.summary(result_of(-0.3, None)).splitlines()
    assert lines[0].split() == "individual renditions bouts days types centroid floor dispersion floor syntax floor".split()
    assert lines[1].split() == ["x", "40", "8", "3", "2", "0.2500", "-", "0.0040"]
    assert len({len(x) for x in lines[:3]}) == 1
    assert lines[5].split() == ["x", "2024-05-01", "2024-05-02", "2", "-0.3000", "1", "-", "0", "+0.0100", "1"]
    text = report.comparison_text({"n_treated": 3, "n_control": 4, "observed_difference": 0.5, "ci_low": -0.1, "ci_high": 1.0, "p_value": 0.25})
    assert text.splitlines()[1].split() == ["3", "4", "+0.5000", "-0.1000", "+1.0000", "0.2500", "-", "-", "-", "-"]


def test_results_are_read_again(spark, tmp_path):
    path = str(tmp_path / "new" / "study.json")
    rows = report.study_rows(spark.range(3).withColumn("d", F.lit("2024-01-01").cast("date")))
    report.write_json(rows, f"file://{path}", spark)
    assert report.read_json(path, spark) == [{"id": i, "d": "2024-01-01"} for i in range(3)]
    with pytest.raises(ValueError, match="over 2 rows"):
        report.study_rows(spark.range(3), 2)


def test_pairs_in_long_form(spark):
    pairs = spark.createDataFrame([("x", 1, 2, 0.5, -0.4, None)], "bird string, day_a int, day_b int, centroid_drift_standardised double, dispersion_drift double, syntax_divergence double")
    birds = spark.createDataFrame([("x", 2.0, 0.5, 0.3, 0.1)], "bird string, within_type_variance double, centroid_floor double, dispersion_floor double, syntax_floor double")
    found = {r["measure"]: (r["value"], r["floor"], r["over"]) for r in report.over_floor(pairs, birds).collect()}
    assert found == {"centroid": (0.5, 0.25, True), "dispersion": (-0.4, 0.3, True), "syntax": (None, 0.1, None)}
    below = pairs.withColumn("centroid_drift_standardised", F.lit(-0.5))
    found = {r["measure"]: r["over"] for r in report.over_floor(below, birds).collect()}
    assert found == {"centroid": False, "dispersion": True, "syntax": None}
