"""From sound to a p-value: `python examples/worked_example.py FOLDER`.

Individuals sing phrases of three notes on two days a week apart. In those of the altered group one
note rises by a third on the later day. Recordings, annotations and the manifest are written to the
folder (on any file system that Spark writes to), analysed against each individual's own noise floor,
and the groups are compared with one value per individual.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import audio, groups
from driftloom.plans import report
from driftloom.plans.analysis import Analysis, AnalysisConfig, analyse, per_bird_drift

RATE, NOTE, STEP = 16_000, 0.09, 0.16
PITCHES = {"low": 1800.0, "mid": 2900.0, "high": 4300.0}
DAYS = ("2031-03-01", "2031-03-08")


def plan(spark: SparkSession, per_group: int, bouts: int) -> DataFrame:
    """bird, group, day, bout: what is to be sung."""
    birds = spark.range(2 * per_group).select(
        F.format_string("s%02d", "id").alias("bird"), F.when(F.col("id") < per_group, "altered").otherwise("left_alone").alias("group"), F.col("id").alias("seed")
    )
    each = birds.withColumn("day", F.explode(F.array(*map(F.lit, DAYS)))).withColumn("bout", F.explode(F.sequence(F.lit(0), F.lit(bouts - 1))))
    return each.repartition(spark.sparkContext.defaultParallelism, "bird", "day", "bout")


def sung(songs: DataFrame, phrases: int = 6) -> DataFrame:
    """bird, group, day, audio_path, content, notes: each bout as a recording with its annotation."""

    def sing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for s in frame.itertuples():
                rng = np.random.default_rng([int(s.seed), DAYS.index(s.day), int(s.bout)])
                t = np.arange(int((0.2 + STEP * 3 * phrases) * RATE)) / RATE
                x, notes, pitch = 0.002 * rng.normal(size=len(t)), [], PITCHES.copy()
                if s.group == "altered" and s.day == DAYS[1]:
                    pitch["mid"] *= 4 / 3
                for i in range(3 * phrases):
                    name, at = list(pitch)[i % 3], 0.1 + STEP * i
                    inside = (t >= at) & (t < at + NOTE)
                    x += inside * 0.4 * np.sin(2 * np.pi * (pitch[name] + rng.normal(0, 25)) * t)
                    notes.append((float(at), float(at + NOTE), name))
                out.append((s.bird, s.group, s.day, f"{s.bird}_{s.day}_{s.bout}.wav", audio.encoded(x, RATE), notes))
            yield pd.DataFrame(out, columns=["bird", "group", "day", "audio_path", "content", "notes"])

    kind = "bird string, group string, day string, audio_path string, content binary, notes array<struct<onset_s:double,offset_s:double,label:string>>"
    return songs.mapInPandas(sing, kind)


def run(spark: SparkSession, folder: str, per_group: int = 4, bouts: int = 10) -> tuple[Analysis, dict]:
    """(the analysis, the comparison of the groups)."""
    sung(plan(spark, per_group, bouts)).write.mode("overwrite").parquet(f"{folder}/recordings")
    songs = spark.read.parquet(f"{folder}/recordings")
    notes = songs.select("bird", "group", F.to_date("day").alias("day"), "audio_path", F.col("audio_path").alias("audio_file"), F.explode("notes").alias("n"))
    table = notes.select("bird", "group", "day", "audio_path", "audio_file", "n.*")
    config = AnalysisConfig(n_pca=16, n_freq_bins=24, min_renditions=20, min_bouts=4, n_null=120, n_boot=120)
    found = analyse(table, songs.select("audio_path", "content"), config)
    drift = report.with_groups(per_bird_drift(found), table)
    comparison = groups.compare_groups(drift, "bird", "group", "drift", "altered", "left_alone").first().asDict()
    report.write_json({"individuals": report.collected(found, config), "comparison": comparison}, f"{folder}/result.json", spark)
    return found, comparison


if __name__ == "__main__":
    session = SparkSession.builder.appName("worked example").getOrCreate()
    analysis, groups_compared = run(session, sys.argv[1])
    print(report.summary(report.collected(analysis, AnalysisConfig())))
    print()
    print(report.comparison_text(groups_compared))
