"""Recordings are made and segmented in all tasks, and filtered by transforms no longer than they need."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftloom.operators import audio
from driftloom.plans import recordings

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("made", [recordings.recorded_turns, recordings.recorded_tones])
def test_recordings_of_few_rows_are_made_in_several_tasks(spark, made):
    found, _ = made(spark, SF)
    found = found.select("audio_path", F.spark_partition_id().alias("task")).collect()
    assert len({r["audio_path"] for r in found}) == len(found) > 50
    assert len({r["task"] for r in found}) == 4


def test_lengths_of_transforms_are_little_longer_than_needed():
    for least in [1, 2, 31, 33, 1000, 43_437, 65_536, 65_537, 10**6, 10**9]:
        n = audio._length(least)
        assert least <= n <= max(32, 1.2 * least)
        for p in (2, 3, 5):
            while n % p == 0:
                n //= p
        assert n == 1


@pytest.mark.parametrize("n", [1, 100, 5000])
def test_the_filter_is_a_convolution_with_its_answer_to_a_pulse(n):
    x = np.random.default_rng(n).normal(size=n)
    want = np.convolve(x, audio._impulse(0.0625, 0.999))[:n]
    for _ in range(2):  # the second time by the spectrum that is kept
        assert np.allclose(audio._filtered(x, 0.0625, 0.999), want, rtol=0, atol=1e-12)


class Frames:
    """Stands for a DataFrame of recordings: keeps what maps its frames."""

    dtypes = [("audio_path", "string"), ("content", "binary")]

    def select(self, *_):
        return self

    def mapInPandas(self, run, _):  # noqa: N802
        self.run = run
        return self


def test_the_segments_of_a_frame_of_recordings_are_passed_on_at_once():
    t = np.arange(8000) / 16_000
    content = audio.encoded(0.5 * np.sin(2 * np.pi * 3000 * t) * ((t > 0.1) & (t < 0.2)), 16_000)
    run = audio.amplitude_segments(Frames(), audio.AmplitudeSegmenter(threshold=0.2)).run
    (found,) = run(iter([pd.DataFrame({"audio_path": list("abc"), "content": [content] * 3})]))
    assert found["audio_path"].tolist() == list("abc")
