"""Signals: spectrograms of syllables, amplitude envelopes and segments. Numpy inside grouped tasks."""

from __future__ import annotations

import io
import wave
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REFERENCE_RATE = 32_000
#: Samples after which a band-pass filter's answer to a pulse no longer matters.
_TAPS = 1 << 14
#: Lengths of transforms are these parts of 32 of the next power of two; the longest of which the filter's spectrum is kept, and how many.
_PARTS, _KEPT, _SPECTRA = (18, 20, 24, 25, 27, 30, 32), 1 << 18, 8


def decoded(content: bytes) -> tuple[np.ndarray, int]:
    """Samples between -1 and 1 (frames x channels) and the rate of PCM WAV bytes."""
    with wave.open(io.BytesIO(content)) as w:
        return samples_of(w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels()), w.getframerate()


def samples_of(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Samples between -1 and 1 (frames x channels) of PCM frames of ``width`` bytes a sample."""
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels)


def encoded(samples: np.ndarray, rate: int = REFERENCE_RATE) -> bytes:
    """16-bit mono WAV bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def mono(samples: np.ndarray) -> np.ndarray:
    return samples.mean(axis=tuple(range(1, samples.ndim))) if samples.ndim > 1 else samples


@dataclass(frozen=True)
class Spectrogram:
    """A fixed-size picture of a syllable, whatever the recording's sample rate."""

    window: int = 512
    hop: int = 64
    band: tuple[float, float] = (500.0, 10_000.0)
    longest: float = 0.2
    rows: int = 32
    decibels: float = 60.0

    @property
    def columns(self) -> int:
        return round(self.longest * REFERENCE_RATE / self.hop)

    def of(self, audio: np.ndarray, rate: int, onset: float, offset: float) -> np.ndarray:
        """rows x columns values from 0 to 1, relative to the syllable's own peak; all 0 for silence."""
        if not 0 <= onset < offset:
            raise ValueError(f"no syllable between {onset} and {offset}")
        if int(offset * rate) > len(audio):
            raise ValueError(f"a syllable that ends at {offset} s runs past the audio")
        ratio = rate / REFERENCE_RATE
        window, hop = max(round(self.window * ratio), 16), max(round(self.hop * ratio), 1)
        begin = int(onset * rate)
        part = np.asarray(audio[begin : min(int(offset * rate), begin + int(self.longest * rate))], np.float64)
        part = np.pad(part, (0, max(0, window - len(part))))
        frames = np.lib.stride_tricks.sliding_window_view(part, window)[::hop]
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
        spectrum = np.abs(np.fft.rfft(frames * hann, axis=1)).T / hann.sum()
        hertz = np.arange(window // 2 + 1) * rate / window
        spectrum = spectrum[(hertz >= self.band[0]) & (hertz <= self.band[1])]
        edges = np.linspace(0, len(spectrum), self.rows + 1).astype(int)
        last = len(spectrum) - 1
        picture = np.stack([spectrum[a:max(b, a + 1)].mean(axis=0) if a <= last else spectrum[last] for a, b in zip(edges, edges[1:])])
        peak = picture.max()
        out = np.zeros((self.rows, self.columns))
        if peak > 0:
            level = 1 + 20 * np.log10(np.maximum(picture, 1e-12) / peak) / self.decibels
            level = np.clip(level, 0, 1)[:, : self.columns]
            out[:, : level.shape[1]] = level
        return out


def _band_sections(low: float, high: float) -> np.ndarray:
    """Second-order sections of the fourth-order Butterworth band-pass; edges as shares of half the rate."""
    order, rate = 4, 4.0
    w1, w2 = (rate * np.tan(np.pi * f / 2) for f in (low, high))
    wide, centre = w2 - w1, np.sqrt(w1 * w2)
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order)) * wide / 2
    poles = np.concatenate([poles + np.sqrt(poles**2 - centre**2), poles - np.sqrt(poles**2 - centre**2)])
    z_poles = (rate + poles) / (rate - poles)
    upper = z_poles[z_poles.imag > 0]
    sections = [[1.0, 0.0, -1.0, 1.0, -2 * p.real, abs(p) ** 2] for p in upper]
    out = np.array(sections)
    middle = np.exp(2j * np.arctan(centre / rate))
    for s in out:  # unit gain in the middle of the band
        gain = abs(np.polyval(s[:3], middle) / np.polyval(s[3:], middle))
        s[:3] /= gain
    return out


@cache
def _impulse(low: float, high: float) -> np.ndarray:
    """The band-pass filter's answer to a single pulse, as long as it matters."""
    x = np.zeros(_TAPS)
    x[0] = 1.0
    for b0, b1, b2, _, a1, a2 in _band_sections(low, high).tolist():
        y, x1, x2, y1, y2 = [], 0.0, 0.0, 0.0, 0.0
        for v in x.tolist():
            w = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
            x2, x1, y2, y1 = x1, v, y1, w
            y.append(w)
        x = np.array(y)
    return x


def _length(least: int) -> int:
    """A length of at least ``least`` whose transform is quick."""
    most = max(32, 1 << (least - 1).bit_length())
    return next(n for n in (most // 32 * p for p in _PARTS) if n >= least)


def _spectrum(low: float, high: float, n: int) -> np.ndarray:
    return np.fft.rfft(_impulse(low, high), n)


_kept_spectrum = lru_cache(_SPECTRA)(_spectrum)


def _filtered(x: np.ndarray, low: float, high: float) -> np.ndarray:
    n = _length(len(x) + _TAPS - 1)
    spectrum = (_kept_spectrum if n <= _KEPT else _spectrum)(low, high, n)
    return np.fft.irfft(np.fft.rfft(x, n) * spectrum, n)[: len(x)]


@dataclass(frozen=True)
class AmplitudeSegmenter:
    """Segments where the smoothed amplitude lies over a share of its peak."""

    threshold: float = 0.05
    least_syllable: float = 0.02
    least_silence: float = 0.02
    smooth_ms: float = 2.0
    band: tuple[float, float] | None = (500.0, 10_000.0)

    def levels(self, samples: np.ndarray, rate: int) -> np.ndarray:
        """The smoothed amplitude of the band, sample by sample."""
        x = mono(np.asarray(samples, np.float64))
        if not len(x):
            return x
        if self.band is not None and 0 < self.band[0] < min(self.band[1], 0.4995 * rate):
            edges = (self.band[0] / (rate / 2), min(self.band[1], 0.4995 * rate) / (rate / 2))
            pad = min(len(x) - 1, 27)
            x = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad else x
            x = _filtered(x, *edges)
            x = _filtered(x[::-1], *edges)[::-1]
            x = x[pad : len(x) - pad] if pad else x
        width = max(round(self.smooth_ms * 1e-3 * rate), 1)
        before = width // 2
        sums = np.cumsum(np.r_[0, np.pad(np.abs(x), (before, width - 1 - before), mode="edge")])
        return (sums[width:] - sums[:-width]) / width

    def reach(self, rate: int) -> int:
        """How many samples on either side of one its level depends on, at most."""
        return _TAPS + max(round(self.smooth_ms * 1e-3 * rate), 1)

    def envelope(self, samples: np.ndarray, rate: int) -> np.ndarray:
        level = self.levels(samples, rate)
        peak = level.max(initial=0)
        return level / peak if peak > 0 else level

    def runs(self, level: np.ndarray, peak: float) -> tuple[np.ndarray, np.ndarray]:
        """Where the runs of samples begin and end whose level is over the threshold's share of ``peak``."""
        level = level / peak if peak > 0 else level
        loud = np.r_[False, (level >= self.threshold) & (level > 0), False]
        return np.flatnonzero(loud[1:] & ~loud[:-1]), np.flatnonzero(~loud[1:] & loud[:-1])

    def segments(self, samples: np.ndarray, rate: int) -> list[tuple[float, float]]:
        level = self.levels(samples, rate)
        begin, end = (x / rate for x in self.runs(level, level.max(initial=0)))
        if not len(begin):
            return []
        new = np.r_[True, begin[1:] - end[:-1] >= self.least_silence]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(begin)] - 1
        return [(float(a), float(b)) for a, b in zip(begin[first], end[last]) if b - a >= self.least_syllable]


def spectrograms(table: DataFrame, recordings: DataFrame, spec: Spectrogram = Spectrogram()) -> tuple[DataFrame, DataFrame]:
    """(``table`` with features array<float>, one row of repair counts).

    ``recordings`` has audio_path and content. Each file is opened once. Onsets before the file and
    offsets past its end are clamped; syllables that are empty then are left out; all are counted.
    """
    keep = [c for c in table.columns if c != "audio_path"]
    kinds = dict(table.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ["audio_path", *keep]] + ["features array<float>", "was_low boolean", "was_high boolean"])

    def extract(key: tuple, rows: pd.DataFrame, audio: pd.DataFrame) -> pd.DataFrame:
        out = rows.iloc[:0] if audio.empty else rows
        out = out.assign(features=None, was_low=False, was_high=False)
        if len(out):
            samples, rate = decoded(audio["content"].iloc[0])
            samples, end = mono(samples), len(samples) / rate
            out["was_low"], out["was_high"] = out["onset_s"] < 0, out["offset_s"] > end
            out["onset_s"], out["offset_s"] = out["onset_s"].clip(lower=0), out["offset_s"].clip(upper=end)
            out["features"] = [spec.of(samples, rate, a, b).astype(np.float32).ravel() if b > a else None for a, b in zip(out["onset_s"], out["offset_s"])]
        return out[["audio_path", *keep, "features", "was_low", "was_high"]]

    pairs = table.groupBy("audio_path").cogroup(recordings.select(F.col("audio_path").alias("audio_path"), "content").groupBy("audio_path"))
    found = pairs.applyInPandas(extract, schema)
    counts = found.agg(
        F.count_if("was_low").alias("n_low"), F.count_if("was_high").alias("n_high"), F.count_if(F.col("features").isNull()).alias("n_empty")
    )
    return found.where("features is not null").drop("was_low", "was_high"), counts


def amplitude_segments(recordings: DataFrame, segmenter: AmplitudeSegmenter = AmplitudeSegmenter(), key: str = "audio_path") -> DataFrame:
    """key, onset_s, offset_s of every recording (columns key and content)."""

    def run(frames):  # noqa: ANN001, ANN202
        for frame in frames:
            found = [(name, a, b) for name, content in zip(frame[key], frame["content"]) for a, b in segmenter.segments(*decoded(content))]
            yield pd.DataFrame(found, columns=[key, "onset_s", "offset_s"])

    kind = dict(recordings.dtypes)[key]
    return recordings.select(key, "content").mapInPandas(run, f"{key} {kind}, onset_s double, offset_s double")


def tuned_threshold(recordings: DataFrame, truth: DataFrame, grid: Sequence[float], tolerance: float = 0.01, key: str = "audio_path", **settings: float) -> tuple[float, float]:
    """The threshold with the best pooled f1, the first of equals, and that f1. All are tried side by side."""
    from driftloom.operators.matching import pooled, segment_counts

    if not grid:
        raise ValueError("need a threshold to try")
    kind = dict(recordings.dtypes)[key]

    def run(frames):  # noqa: ANN001, ANN202
        for frame in frames:
            for name, content in zip(frame[key], frame["content"]):
                samples, rate = decoded(content)
                rows = [(i, name, a, b) for i, t in enumerate(grid) for a, b in AmplitudeSegmenter(threshold=t, **settings).segments(samples, rate)]
                yield pd.DataFrame(rows, columns=["trial", key, "onset_s", "offset_s"])

    found = recordings.select(key, "content").mapInPandas(run, f"trial int, {key} {kind}, onset_s double, offset_s double")
    wanted = truth.select(key, "onset_s", "offset_s").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))
    f1 = pooled(segment_counts(wanted, found, ["trial", key], tolerance), ["trial"])
    best = f1.orderBy(F.desc("f1"), "trial").first()
    return (grid[0], 0.0) if best is None else (grid[best["trial"]], best["f1"])
