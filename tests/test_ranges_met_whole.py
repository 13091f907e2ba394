"""Ranged recordings: samples are never shuffled, few files lie on disk at a time, and files met whole are read once."""

import numpy as np
import pytest

from driftloom.operators import audio
from driftloom.plans import catalogue, recordings
from driftloom.plans import file_queries as FQ
from driftloom.sources import datasets, ranges

SF = "/root/testdata/sf0.001"
SEGMENTER = audio.AmplitudeSegmenter(threshold=0.1)


def song(seconds, rate, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * rate)) / rate
    loud = sum(((t >= k) & (t < k + rng.uniform(0.03, 0.14))) * rng.uniform(0.2, 1.0) for k in np.arange(0.1, seconds - 0.2, 0.15))
    return audio.encoded(0.6 * np.sin(2 * np.pi * 3000 * t) * loud + 0.003 * rng.normal(size=len(t)), rate)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("songs")
    for i in range(4):
        (root / f"{i}.wav").write_bytes(song(1.0 + i, (16_000, 22_050, 32_000, 16_000)[i], i))
    (root / "none.wav").write_bytes(audio.encoded(np.zeros(0)))
    (root / "silent.wav").write_bytes(audio.encoded(np.zeros(500)))
    return str(root)


@pytest.mark.parametrize("held", [0, 30_000, ranges.HELD])
def test_segments_do_not_depend_on_how_much_a_task_keeps(spark, folder, held):
    found = ranges.ranged_segments(spark, folder, SEGMENTER, bytes=5000, held=held)
    want = audio.amplitude_segments(datasets.wav_files(spark, folder), SEGMENTER)
    order = ["audio_path", "onset_s", "offset_s"]
    assert [tuple(r) for r in found.orderBy(order).collect()] == [tuple(r) for r in want.orderBy(order).collect()]
    plan = found._jdf.queryExecution().toString()
    assert "samples" not in plan  # no samples on their way from the first reading to the second


def test_only_files_that_a_task_has_not_met_whole_are_left(spark, folder):
    pieces = ranges.read_ranges(spark, folder, 5000, SEGMENTER.reach(192_000))
    of = {}
    for held in (0, 30_000, ranges.HELD):
        rows = ranges.ranged_levels(pieces, SEGMENTER, held).where("begin is null").collect()
        of[held] = {r["path"].rpartition("/")[2] for r in rows}
        assert all(r["peak"] is not None and r["first"] is not None for r in rows)
    assert of == {0: {"0.wav", "1.wav", "2.wav", "3.wav", "silent.wav"}, 30_000: {"1.wav", "2.wav", "3.wav"}, ranges.HELD: set()}


def test_ranges_that_begin_amid_a_file_are_left():
    x = np.ones(10, np.float32)
    rows = [("a", 10, x, 1000, 0, 10, 20), ("b", 0, x, 1000, 0, 10, 10), ("c", 0, x, 1000, 0, 10, 30), ("c", 20, x, 1000, 0, 10, 30)]
    found = list(ranges._met(iter(rows), audio.AmplitudeSegmenter(band=None), 100))
    assert [r[:3] for r in found if r[4] is None] == [("a", 1000, 10), ("c", 1000, 0), ("c", 1000, 20)]
    assert [r for r in found if r[4] is not None] == [("b", 1000, None, None, 0, 10)]


def test_recordings_in_parts_are_the_same_and_few_lie_in_files_at_a_time(spark, monkeypatch):
    whole = {r["audio_path"]: bytes(r["content"]) for r in recordings.recorded_turns(spark, SF)[0].collect()}
    most = sum(map(len, whole.values())) // 3
    parts = [p.collect() for p in recordings.recorded_parts(spark, SF, most)[0]]
    assert len(parts) >= 3 and sum(map(len, parts)) == len(whole)
    assert {r["audio_path"]: bytes(r["content"]) for p in parts for r in p} == whole
    want = sorted(map(tuple, catalogue.QUERIES["ranged_amplitude_segments"](spark, SF).collect()))
    written, before = [], FQ.sink.write_files
    monkeypatch.setattr(FQ.sink, "write_files", lambda files, folder: written.append(files.count()) or before(files, folder))
    monkeypatch.setattr(FQ, "ON_DISK", most)
    assert sorted(map(tuple, catalogue.QUERIES["ranged_amplitude_segments"](spark, SF).collect())) == want
    assert sum(written) == len(whole) and len(written) >= 3
