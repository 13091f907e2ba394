"""Recordings are made in time of their length, and only those with a chosen syllable are opened."""

import numpy as np
import pytest

from driftloom.operators import audio
from driftloom.plans import recordings, syllables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 40])
def test_tones_equal_those_worked_out_over_the_whole_recording(n):
    at = [{"onset_s": 0.05 + 0.25 * i, "offset_s": 0.05 + 0.25 * i + 0.1, "pitch": 1000 * (1 + i % 7)} for i in range(n)]
    t = np.arange(int((at[-1]["offset_s"] + 0.2) * recordings.RATE)) / recordings.RATE
    whole = sum(np.sin(2 * np.pi * s["pitch"] * t) * ((t >= s["onset_s"]) & (t < s["offset_s"])) for s in at)
    got = recordings._tones(at, t)
    assert np.allclose(got, whole, rtol=0, atol=1e-12)
    assert audio.encoded(0.5 * got, recordings.RATE) == audio.encoded(0.5 * whole, recordings.RATE)


def test_each_tone_is_worked_out_where_it_sounds_only(monkeypatch):
    at = [{"onset_s": 0.05 + 0.25 * i, "offset_s": 0.05 + 0.25 * i + 0.1, "pitch": 1000} for i in range(400)]
    t = np.arange(int((at[-1]["offset_s"] + 0.2) * recordings.RATE)) / recordings.RATE
    sine, seen = np.sin, []
    monkeypatch.setattr(np, "sin", lambda x: seen.append(len(x)) or sine(x))
    recordings._tones(at, t)
    assert sum(seen) < len(t)


def test_only_recordings_of_chosen_syllables_are_opened(spark, monkeypatch):
    sounds, truth = recordings.recorded_tones(spark, SF)
    table = truth.selectExpr("*", "'one' as bird", "cast(audio_path as int) % 2 as day")
    seen, before = [], syllables.spectrograms

    def spy(chosen, opened, spec):
        seen.append(({r[0] for r in chosen.select("audio_path").collect()}, [r[0] for r in opened.select("audio_path").collect()]))
        return before(chosen, opened, spec)

    monkeypatch.setattr(syllables, "spectrograms", spy)
    found, summary = syllables.syllable_set(table, sounds, "id", exclude=(), least=1, max_per_day=3)
    wanted, opened = seen[0]
    assert set(opened) == wanted and len(opened) == len(wanted) <= 6 < sounds.count()
    assert found.count() == 6 and summary.first()["n_empty"] == 0
    monkeypatch.setattr(syllables, "FEW_FILES", 0)  # joined, not broadcast
    again, _ = syllables.syllable_set(table, sounds, "id", exclude=(), least=1, max_per_day=3)
    assert sorted(r["id"] for r in again.collect()) == sorted(r["id"] for r in found.collect())
