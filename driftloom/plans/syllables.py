"""Sets of syllables with their spectrograms, runs from a flat file, and development with intervals."""

from __future__ import annotations

import io
import json
from collections.abc import Sequence
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.lineage import cut
from driftloom.operators import clean as C
from driftloom.operators import drift as D
from driftloom.operators import moments as M
from driftloom.operators import resampling as R
from driftloom.operators.audio import Spectrogram, spectrograms
from driftloom.plans import analysis, report
from driftloom.sources import annotations, datasets, names, sink
from driftloom.sources.files import write_text

# Labels of calls and of unclear sounds, which are no syllables of a song.
OFF_SCHEMA = ("0", "x", "y", "z", "@", "s", "u", "w")
#: Recordings up to which the names of those to open are broadcast.
FEW_FILES = 100_000
#: Syllables of one file of a set.
SHARE = 2000


def syllable_set(table: DataFrame, recordings: DataFrame, key: str, spec: Spectrogram = Spectrogram(), exclude: Sequence[str] = OFF_SCHEMA, least: int = 20, max_per_day: int | None = 2000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(bird, day, label, audio_path, key, onset_s, duration_s and features of the syllables kept, a summary of each bird's).

    Labels are taken out by name first, then those with fewer than ``least`` syllables on a day, from
    that day; of what is left ``max_per_day`` syllables of a day stay, by a hash of ``key``. Bounds
    beyond a recording are clamped, and syllables that are empty then are left out. The summary has
    bird, n_syllables, n_days, labels (a count each), n_excluded, n_rare, n_over_cap and n_empty.
    """
    rows = table.select("bird", "day", "label", "audio_path", key, "onset_s", "offset_s")
    named = C.exclude(rows, "label", exclude)
    counts = named.groupBy("bird", "day", "label").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    often = cut(named.join(counts, ["bird", "day", "label"], "left_semi"))
    chosen = cut(C.stratified_cap(often, ["bird", "day"], key, max_per_day, seed))
    # recordings that no chosen syllable lies in are not sent to be opened
    wanted = cut(chosen.select(F.col("audio_path").alias("_wanted")).distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= FEW_FILES else wanted
    found, _ = spectrograms(chosen, recordings.join(wanted, F.col("audio_path").eqNullSafe(F.col("_wanted")), "left_semi"), spec)
    found = cut(found.select("bird", "day", "label", "audio_path", key, "onset_s", (F.col("offset_s") - F.col("onset_s")).alias("duration_s"), "features"))
    steps = [df.groupBy("bird").agg(F.count(F.lit(1)).alias(name)) for df, name in ((rows, "_all"), (named, "_named"), (often, "_often"), (chosen, "_chosen"))]
    labels = found.groupBy("bird", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("bird")
    labels = labels.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("labels"))
    kept = found.groupBy("bird").agg(F.count(F.lit(1)).alias("n_syllables"), F.count_distinct("day").alias("n_days"))
    out = steps[0]
    for more in (*steps[1:], kept, labels):
        out = out.join(more, "bird", "left")
    n = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    less = [(n(a) - n(b)).alias(c) for a, b, c in (("_all", "_named", "n_excluded"), ("_named", "_often", "n_rare"), ("_often", "_chosen", "n_over_cap"), ("_chosen", "n_syllables", "n_empty"))]
    return found, out.select("bird", n("n_syllables").alias("n_syllables"), n("n_days").alias("n_days"), "labels", *less)


def write_syllables(found: DataFrame, summary: DataFrame, folder: str, key: str, spec: Spectrogram = Spectrogram(), share: int = SHARE) -> None:
    """The set as npz files of some ``share`` syllables below ``folder``, one folder for each bird, and summary.json.

    A file has the arrays spectrograms, labels, days, files, onsets and durations. Files come to their
    names only when all are written; see :mod:`driftloom.sources.sink`.
    """
    shape = (spec.rows, spec.columns)

    def lay_out(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values([key]), io.BytesIO()
        np.savez_compressed(
            out, spectrograms=np.stack([np.asarray(v, np.float32).reshape(shape) for v in rows["features"]]), labels=rows["label"].to_numpy().astype(str),
            days=rows["day"].astype(str).to_numpy().astype(str), files=rows["audio_path"].to_numpy().astype(str),
            onsets=rows["onset_s"].to_numpy(np.float32), durations=rows["duration_s"].to_numpy(np.float32),
        )
        return pd.DataFrame([(f"{group[0]}/{group[1]:05d}.npz", out.getvalue())], columns=["name", "content"])

    sizes = found.groupBy("bird").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("_parts"))
    dealt = found.join(sizes, "bird").withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int")).drop("_parts")
    sink.write_files(dealt.groupBy("bird", "_part").applyInPandas(lay_out, "name string, content binary"), folder)
    told = {"spectrogram_shape": list(shape), "spec_params": asdict(spec), "birds": report.study_rows(summary)}
    write_text(json.dumps(told, indent=1, default=str), f"{folder.rstrip('/')}/summary.json", found.sparkSession)


def flat_run(spark: SparkSession, annotation_csv: str, audio_root: str, bird: str, pattern: str, timestamp_format: str, config: analysis.AnalysisConfig = analysis.AnalysisConfig(), columns: dict[str, str] | None = None) -> tuple[analysis.Analysis, DataFrame, DataFrame]:
    """(the analysis, drift by separation, counts of what was left out) of one flat annotation file and the recordings below a folder.

    By separation: n_pairs, the means, ratio_to_floor (drift over the bird's centroid floor) and how
    many types lie over their floors. Recordings that are missing are counted.
    """
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(annotation_csv)
    audio = names.listing(spark, audio_root, ".wav").select(annotations._local(F.col("path")).alias("path"))
    table, counts = annotations.load_flat(rows, audio, bird, pattern, timestamp_format, columns, on_missing="skip")
    table = cut(table)
    found = analysis.analyse(table, datasets.wav_files(spark, audio_root), config)
    floor = found.birds.where(F.col("bird") == bird).select((F.col("centroid_floor") / F.nullif("within_type_variance", F.lit(0.0))).alias("_floor"))
    by_gap = analysis.by_separation(found.pairs).crossJoin(F.broadcast(floor))  # one row
    return found, by_gap.withColumn("ratio_to_floor", F.col("centroid") / F.nullif("_floor", F.lit(0.0))).drop("_floor"), counts


def development_intervals(points: DataFrame, endpoint: Column, n_boot: int = 300, seed: int = 0) -> DataFrame:
    """measure, label, day_a, day_b, drift, low, high: of days that follow each other, and of each day and the ``endpoint`` days.

    ``points`` has label, day (a date), bout and z. The endpoint is one side: the bouts of all its days,
    each by itself; its day_b is null. Intervals are of bouts drawn with replacement, those drawn twice
    counting twice.
    """
    pool = F.lit("1900-01-01").cast("date")  # sorts before all days
    bout = F.concat_ws("|", F.col("day").cast("string"), F.col("bout").cast("string"))
    rows = points.select("label", "day", bout.alias("bout"), "z", endpoint.alias("_end"))
    sides = rows.drop("_end").unionByName(rows.where("_end").withColumn("day", pool).drop("_end"))
    means = cut(M.bout_means(M.bout_moments(sides, ["label", "day"])))
    ends = rows.where("_end").select(F.min("day")).first()[0]
    follows = F.when(F.col("day_a") == pool, (F.col("day_b") < F.lit(ends)) if ends else F.lit(False)).otherwise(F.datediff("day_b", "day_a") == 1)
    drift = cut(D.centroid_drift(M.unit_moments(means, ["label", "day"]), ["label"], "day").where(follows))
    keys = ["label", "day_a", "day_b"]
    found = drift.select(*keys, "drift").join(R.centroid_interval(means, ["label"], "day", drift.select(*keys), n_boot, seed, collapse=False), keys, "left")
    whole = F.col("day_a") == pool
    return found.select(
        F.when(whole, "endpoint").otherwise("consecutive").alias("measure"), "label", F.when(whole, F.col("day_b")).otherwise(F.col("day_a")).alias("day_a"),
        F.when(~whole, F.col("day_b")).alias("day_b"), "drift", "low", "high",
    )


def newest_evaluation(spark: SparkSession, root: str, pattern: str = "eval_*.csv") -> DataFrame:
    """file, measure, value: the numbers in the first row of the last file, by path, that fits ``pattern`` below ``root``.

    Columns that are no number are left out; without a file, or a row, there is no row.
    """
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    path = rows.text(root, wholetext=True).select(F.max(F.col("_metadata.file_path"))).first()[0]
    if path is None:
        return spark.createDataFrame([], "file string, measure string, value double")
    first = spark.read.csv(path, header=True).limit(1)
    if not first.columns:
        return spark.createDataFrame([], "file string, measure string, value double")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"`{c}`").try_cast("double").alias("value")) for c in first.columns]))
    return first.select(each.alias("e")).select(F.lit(path.rpartition("/")[2]).alias("file"), "e.*").where("value is not null")
