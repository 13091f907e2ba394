"""Recordings of any length by ranges of samples: a Spark data source, and amplitude segments over ranges.

``spark.read.format("wav_ranges").load(folder)`` gives a row per range of a WAV file: its samples with
``overlap`` more on both sides where the file has them. Ranges are planned from the files' sizes alone;
a task opens the file, seeks to a range and reads no more than that; it holds one range at a time.
Samples are never shuffled: what needs them twice reads them twice.
"""

from __future__ import annotations

import itertools
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from driftloom.functions.lineage import cut
from driftloom.operators.audio import AmplitudeSegmenter, mono, samples_of
from driftloom.sources import store
from driftloom.sources.annotations import _local

RANGES = "path string, rate int, frames long, first long, count long, before long, samples array<float>"
#: Rows that a task finds before it passes them on; levels of a file's ranges that it keeps until it has met the file's peak.
ROWS, HELD = 4096, 1 << 22


class RangeSource(DataSource):
    """Options: bytes (of a range), overlap (samples on either side), share (bytes that a task reads, range by range), pattern (of file names, ``*.wav``)."""

    @classmethod
    def name(cls) -> str:
        return "wav_ranges"

    def schema(self) -> str:
        return RANGES

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RangeReader(self.options)


class RangeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*.wav")
        self.bytes, self.overlap = int(options.get("bytes", 8 << 20)), int(options.get("overlap", 0))
        self.share = int(options.get("share", max(self.bytes, store.SHARE // 8)))
        if self.bytes < 1 or self.overlap < 0:
            raise ValueError("a range has bytes, and an overlap is not negative")

    def partitions(self) -> list[store.Share]:
        found = [(path, k, min(size, self.bytes)) for path, size in store.files(self.path, self.pattern) for k in range(-(-size // self.bytes))]
        return store.shares(found, self.share)

    def read(self, partition: store.Share) -> Iterator[pa.RecordBatch]:
        for path, k in partition.items:
            found = _piece(path, self.bytes, self.overlap, lambda most: k * most)
            if found is None:
                continue
            *row, samples = (path, *found)
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array([v], t) for v, t in zip(row, kinds)]
            offsets = pa.array([0, len(samples)], pa.int32())
            columns.append(pa.ListArray.from_arrays(offsets, pa.array(samples.astype(np.float32))))
            yield pa.RecordBatch.from_arrays(columns, ["path", "rate", "frames", "first", "count", "before", "samples"])


def _piece(path: str, bytes: int, overlap: int, begin: Callable[[int], int]) -> tuple | None:  # noqa: A002
    """rate, frames, first, count, before and samples of a range, which begins at the sample ``begin`` tells for a range's length; None past the file's end."""
    with store.opened(path) as f, wave.open(f) as w:
        frames, width, channels = w.getnframes(), w.getsampwidth(), w.getnchannels()
        most = max(1, bytes // (width * channels))
        first = begin(most)
        if first >= frames:
            return None
        at, end = max(0, first - overlap), min(frames, first + most + overlap)
        w.setpos(at)
        samples = mono(samples_of(w.readframes(end - at), width, channels))
        return w.getframerate(), frames, first, min(most, frames - first), first - at, samples


def read_ranges(spark: SparkSession, root: str, bytes: int = 8 << 20, overlap: int = 0, pattern: str = "*.wav", share: int | None = None) -> DataFrame:  # noqa: A002
    """The ranges of all recordings below ``root``; see :class:`RangeSource`."""
    spark.dataSource.register(RangeSource)
    options = {"bytes": bytes, "overlap": overlap, "pattern": pattern, **({"share": share} if share else {})}
    return spark.read.format("wav_ranges").options(**options).load(root)


def ranged_levels(pieces: DataFrame, segmenter: AmplitudeSegmenter, held: int = HELD) -> DataFrame:
    """path, rate, first, peak, begin, end: a row per run of a file that a task has met whole, range after range; else one per range.

    A run (begin, end) is over the threshold's share of the file's peak. Of files with more than ``held``
    samples, or whose ranges lie in several tasks, there is each range's first sample and the largest level.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("path", "first", "samples", "rate", "before", "count", "frames")
        rows = (x for frame in frames for x in zip(*(frame[c] for c in names)))
        yield from _frames(_met(rows, segmenter, held), ["path", "rate", "first", "peak", "begin", "end"])

    return pieces.mapInPandas(run, "path string, rate int, first long, peak double, begin long, end long")


def _frames(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    while some := list(itertools.islice(rows, ROWS)):
        yield pd.DataFrame(some, columns=names, dtype=object)


def _met(rows: Iterator[tuple], segmenter: AmplitudeSegmenter, held: int) -> Iterator[tuple]:
    """The rows of :func:`ranged_levels` for ranges in order."""
    file, many = [], 0  # the ranges so far of a file met from its beginning

    def left() -> list[tuple]:
        return [(p, r, f, peak, None, None) for p, r, f, peak, _ in file]

    for path, first, samples, rate, before, count, frames in rows:
        level = _own(segmenter, samples, rate, before, count)
        follows = first == 0 or bool(file) and file[-1][0] == path and file[-1][2] + len(file[-1][4]) == first
        if first == 0 or not follows:
            yield from left()
            file, many = [], 0
        many += count
        file.append((path, rate, first, float(level.max(initial=0)), level))
        if not follows or many > held:
            yield from left()
            file = []
        elif first + count == frames:
            peak = max(x[3] for x in file)
            for p, r, f, _, own in file:
                for begin, end in zip(*segmenter.runs(own, peak)):
                    yield p, r, None, None, int(begin) + f, int(end) + f
            file = []
    yield from left()


def _own(segmenter: AmplitudeSegmenter, samples: np.ndarray, rate: int, before: int, count: int) -> np.ndarray:
    """The levels of a range's own samples."""
    return segmenter.levels(np.asarray(samples, np.float64), rate)[before : before + count]


def ranged_segments(spark: SparkSession, root: str, segmenter: AmplitudeSegmenter = AmplitudeSegmenter(), bytes: int = 8 << 20, pattern: str = "*.wav", held: int = HELD) -> DataFrame:  # noqa: A002
    """audio_path, onset_s, offset_s of all recordings below ``root``, as ``audio.amplitude_segments`` finds them in whole files.

    The band-pass filter runs over each range and as many samples around it as it looks at, so the
    pieces join without a seam. Recordings that a task meets whole are read once; others twice: for
    their peaks, then for what is over a share of the peak, by tasks that get the places of ranges,
    dealt out anew, and read them one by one. Segments that a range's end cuts are joined again, by a
    window per recording over its segments.
    """
    # a recording's rate is not known when ranges are planned: enough for the smoothing at 192 kHz
    overlap = segmenter.reach(192_000)
    met = cut(ranged_levels(read_ranges(spark, root, bytes, overlap, pattern), segmenter, held))
    places = met.where("begin is null").select("path", "first", F.max("peak").over(W.partitionBy("path")).alias("peak"))
    places = places.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("path", "first"))

    def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[tuple]:
            for path, first, peak in (x for frame in frames for x in zip(frame["path"], frame["first"], frame["peak"])):
                rate, _, _, count, before, samples = _piece(path, bytes, overlap, lambda _, at=first: at)
                for begin, end in zip(*segmenter.runs(_own(segmenter, samples, rate, before, count), peak)):
                    yield path, rate, int(begin) + first, int(end) + first

        yield from _frames(found(), ["path", "rate", "begin", "end"])

    runs = met.where("begin is not null").select("path", "rate", "begin", "end").unionAll(places.mapInPandas(again, "path string, rate int, begin long, end long"))
    by = W.partitionBy("path").orderBy("begin")
    before = F.lag("end").over(by)
    apart = F.col("begin") / F.col("rate") - before / F.col("rate") >= segmenter.least_silence
    runs = runs.withColumn("new", F.coalesce(apart & (F.col("begin") != before), F.lit(True)).cast("int"))
    runs = runs.withColumn("nth", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    whole = runs.groupBy("path", "nth").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.first("rate").alias("rate"))
    onset, offset = F.col("begin") / F.col("rate"), F.col("end") / F.col("rate")
    found = whole.select(_local(F.col("path")).alias("audio_path"), onset.alias("onset_s"), offset.alias("offset_s"))
    return found.where(F.col("offset_s") - F.col("onset_s") >= segmenter.least_syllable)
