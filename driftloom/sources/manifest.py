"""Manifests: one row per recording, read from CSV or built from a directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.scalars import base_name, named_groups, stamp
from driftloom.schema import require
from driftloom.sources.names import listing

COLUMNS = ("bird", "timestamp", "audio_path", "annot_path")
# The layouts that a manifest's timestamps may have, tried in order.
STAMPS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HHmm",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd HH:mm",
    "yyyy-MM-dd",
)


def any_stamp(column: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(column, F.lit(p)) for p in STAMPS]).cast("timestamp_ntz")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest CSV at ``path`` with its timestamps parsed; all other columns are strings.

    A ValueError names missing columns, or the first five rows (from 0) whose timestamp can't be read.
    """
    rows = require(spark.read.csv(path, header=True), COLUMNS, f"manifest {path}")
    parsed = rows.withColumn("_text", F.col("timestamp")).withColumn("timestamp", any_stamp("timestamp"))
    bad = parsed.where("timestamp is null").select("_text", "audio_path").limit(5).collect()
    if bad:
        shown = [f"{r['_text']!r} ({r['audio_path']})" for r in bad]
        raise ValueError(f"unreadable timestamp(s) in {path}: {', '.join(shown)}")
    return parsed.drop("_text")


def build_manifest(spark: SparkSession, root: str, pattern: str, timestamp_format: str, audio_suffix: str = ".wav", annot_suffix: str = ".wav.csv", out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the manifest of the audio files below ``root``, the names that ``pattern`` does not match).

    ``pattern`` needs the named groups bird and timestamp; further groups become columns.
    """
    files = listing(spark, root, audio_suffix).select(F.col("path").alias("audio_path"))
    return manifest_of(files, pattern, timestamp_format, audio_suffix, annot_suffix, out)


def manifest_of(files: DataFrame, pattern: str, timestamp_format: str, audio_suffix: str = ".wav", annot_suffix: str = ".wav.csv", out: str | None = None) -> tuple[DataFrame, DataFrame]:
    name = base_name("audio_path")
    fields = named_groups(name, pattern)
    missing = {"bird", "timestamp"} - set(fields)
    if missing:
        raise ValueError(f"the pattern lacks the named group(s) {sorted(missing)}")
    rows = files.where(~name.endswith(annot_suffix)) if annot_suffix != audio_suffix else files
    annot = F.concat(F.substring("audio_path", F.lit(1), F.length("audio_path") - len(audio_suffix)), F.lit(annot_suffix))
    fields["timestamp"] = stamp(fields["timestamp"], timestamp_format)
    rows = rows.select("audio_path", annot.alias("annot_path"), *[c.alias(k) for k, c in fields.items()])
    good = rows.where("bird is not null and timestamp is not null")
    columns = [*COLUMNS, *[c for c in fields if c not in COLUMNS]]
    manifest = good.select(*columns)
    unmatched = rows.where("bird is null or timestamp is null").select(base_name("audio_path").alias("name"))
    if out:
        manifest.coalesce(1).write.csv(out, header=True, mode="overwrite")
    return manifest, unmatched
