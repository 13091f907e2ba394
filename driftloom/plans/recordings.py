"""Recordings made from table rows, for the queries on signals: what is in them is known from the table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.functions.lineage import cut
from driftloom.operators import audio
from driftloom.plans import tables as T

RATE = 16_000
#: Recordings that a task makes before it passes them on.
AT_ONCE = 64


def _dealt(sounds: DataFrame) -> DataFrame:
    """``sounds`` dealt out to all tasks: their rows are small, so that they may lie in one, but recordings made of them take time."""
    return sounds.repartition(int(sounds.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("audio_path"))


def _between(t: np.ndarray, begin: float, end: float) -> slice:
    """The samples at ``begin`` or after it and before ``end``, of the times ``t`` in order."""
    return slice(*np.searchsorted(t, (begin, end)))


def _tones(at: Sequence, t: np.ndarray) -> np.ndarray:
    """The sum of the tones ``at`` (onset_s, offset_s, pitch) at the times ``t``; each is worked out where it sounds only."""
    x = np.zeros(len(t))
    for s in at:
        where = _between(t, s["onset_s"], s["offset_s"])
        x[where] += np.sin(2 * np.pi * s["pitch"] * t[where])
    return x


def _bursts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(audio_path and the turns ``at`` of each conversation, the turns as segments)."""
    turns = T.read(spark, sf_dir, "conversations")
    onset = F.lit(0.2) + 0.3 * (F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1)
    length = 0.08 + 0.02 * F.pmod(F.length(F.coalesce("text", F.lit(""))), F.lit(6))
    truth = turns.select(F.col("conv_id").cast("string").alias("audio_path"), onset.alias("onset_s"), (onset + length).alias("offset_s"))
    return truth.groupBy("audio_path").agg(F.sort_array(F.collect_list(F.struct("onset_s", "offset_s"))).alias("at")), truth


def _recorded(sounds: DataFrame) -> DataFrame:
    """audio_path and content: a burst of 3 kHz for each turn."""

    def play(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in T.in_pieces(frames, AT_ONCE):
            out = []
            for name, at in zip(frame["audio_path"], frame["at"]):
                t = np.arange(int((at[-1]["offset_s"] + 0.3) * RATE)) / RATE
                loud = np.zeros(len(t), bool)
                for s in at:
                    loud[_between(t, s["onset_s"], s["offset_s"])] = True
                noise = np.random.default_rng(int(name)).normal(size=len(t))
                out.append((name, audio.encoded(0.5 * np.sin(2 * np.pi * 3000 * t) * loud + 0.002 * noise, RATE)))
            yield pd.DataFrame(out, columns=["audio_path", "content"])

    return _dealt(sounds).mapInPandas(play, "audio_path string, content binary")


def recorded_turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(a recording of each conversation: audio_path, content and day; its turns as segments): a burst of 3 kHz for each turn.

    Bursts begin 0.3 s apart and are longer for longer texts; faint noise lies under them.
    """
    sounds, truth = _bursts(spark, sf_dir)
    return _recorded(sounds).withColumn("day", F.pmod(F.col("audio_path").cast("int"), F.lit(5))), truth


def recorded_parts(spark: SparkSession, sf_dir: str, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The recordings of :func:`recorded_turns` (audio_path, content) in parts of some ``most`` bytes, each recording in one of them; and the turns."""
    sounds, truth = _bursts(spark, sf_dir)
    sounds = cut(sounds)
    whole = sounds.agg(F.sum(2 * RATE * (F.element_at("at", -1)["offset_s"] + 0.3))).first()[0]
    many = max(1, -(-int(whole or 0) // most))
    return [_recorded(sounds.where(F.pmod(F.xxhash64("audio_path", F.lit("part")), F.lit(many)) == k)) for k in range(many)], truth


def recorded_tones(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(a recording of each conversation, its turns as segments with their pitch in hertz): a tone of its own for each turn.

    Tones last 0.1 s and begin 0.25 s apart; pitches are 1 to 7 kHz, by the length of the text.
    """
    turns = T.read(spark, sf_dir, "conversations")
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    pitch = 1000 * (1 + F.pmod(F.length(F.coalesce("text", F.lit(""))), F.lit(7)))
    onset = F.lit(0.05) + 0.25 * (place - 1)
    truth = turns.select(
        F.col("conv_id").cast("string").alias("audio_path"), (F.col("conv_id") * 1000 + place).alias("id"), F.col("role").alias("label"),
        onset.alias("onset_s"), (onset + 0.1).alias("offset_s"), pitch.alias("pitch"),
    )
    sounds = truth.groupBy("audio_path").agg(F.sort_array(F.collect_list(F.struct("onset_s", "offset_s", "pitch"))).alias("at"))

    def play(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in T.in_pieces(frames, AT_ONCE):
            out = []
            for name, at in zip(frame["audio_path"], frame["at"]):
                t = np.arange(int((at[-1]["offset_s"] + 0.2) * RATE)) / RATE
                noise = np.random.default_rng(int(name)).normal(size=len(t))
                out.append((name, audio.encoded(0.5 * _tones(at, t) + 0.001 * noise, RATE)))
            yield pd.DataFrame(out, columns=["audio_path", "content"])

    return _dealt(sounds).mapInPandas(play, "audio_path string, content binary"), truth
