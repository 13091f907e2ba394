"""Annotation files: formats by name, per-recording files through a manifest, one file for many recordings."""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.functions.scalars import base_name, named_groups, stamp
from driftloom.schema import canonical, require
from driftloom.sources.matlab import notmat
from driftloom.sources.names import listing

SEGMENTS = "path string, onset_s double, offset_s double, label string"
POLICIES = ("raise", "skip")
#: Intervals that a task passes on at once, about.
AT_ONCE = 10_000
#: From whole files (path, value) to their intervals.
Reader = Callable[[DataFrame], DataFrame]


def texts(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """path and value: the whole text of each file below ``root`` whose name ends in ``suffix``."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}")
    return files.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def contents(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """path and value: the bytes of each file below ``root`` whose name ends in ``suffix``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}")
    return files.load(root).select("path", F.col("content").alias("value"))


def _delimited(onset: str, offset: str, label: str, sep: str = ",") -> Reader:
    """A reader of files with a header, all columns as strings, whose columns may be in any order."""

    def one(text: str) -> list[tuple[float, float, str]]:
        rows = csv.reader(io.StringIO(text), delimiter=sep, strict=True)
        names, out = None, []
        while True:
            try:
                row = next(rows, None)
            except csv.Error as e:
                raise ValueError(f"row {rows.line_num}: {e}") from e
            if row is None:
                return out
            if not any(c.strip() for c in row):
                continue
            if names is None:
                names = [c.strip() for c in row]
                lacking = [c for c in (onset, offset, label) if c not in names]
                if lacking:
                    raise ValueError(f"missing required column(s) {lacking}")
                continue
            try:
                a, b, c = (row[names.index(n)].strip() for n in (onset, offset, label))
                out.append((float(a), float(b), c))
            except (ValueError, IndexError) as e:
                raise ValueError(f"row {rows.line_num}: {e if isinstance(e, ValueError) else 'too few columns'}") from e

    return _parsed(one)


def _parsed(one: Callable[..., list[tuple[float, float, str]]]) -> Reader:
    """A reader of whole files, each turned into intervals by ``one``; what is wrong with a file is told with its path."""

    def read(files: DataFrame) -> DataFrame:
        def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for path, value in zip(frame["path"], frame["value"]):
                    try:
                        out += [(path, *x) for x in one(value)]
                    except (ValueError, ET.ParseError) as e:
                        raise ValueError(f"{path}: {e}") from e
                    if len(out) >= AT_ONCE:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                yield pd.DataFrame(out, columns=names)

        names = ["path", "onset_s", "offset_s", "label"]

        return files.select("path", "value").mapInPandas(parse, SEGMENTS)

    return read


def audacity(text: str) -> list[tuple[float, float, str]]:
    """Label tracks: onset, offset and label by tabs; lines that begin with a backslash hold frequencies."""
    rows = [r.split("\t") for r in text.splitlines() if r.strip() and not r.startswith("\\")]
    return [(float(r[0]), float(r[1]), r[2] if len(r) > 2 else "") for r in rows]


def textgrid(text: str) -> list[tuple[float, float, str]]:
    """The labelled intervals of the first interval tier of a Praat TextGrid, in its long or short form."""
    tier = text.split('"IntervalTier"', 1)[-1]
    tier = re.split(r'"(?:IntervalTier|TextTier)"', tier)[0]
    long = re.findall(r'xmin\s*=\s*([-\d.eE]+)\s*xmax\s*=\s*([-\d.eE]+)\s*text\s*=\s*"((?:[^"]|"")*)"', tier)
    found = long or re.findall(r'^\s*([-\d.eE]+)\s*\n\s*([-\d.eE]+)\s*\n\s*"((?:[^"]|"")*)"', tier, re.M)
    return [(float(a), float(b), c.replace('""', '"')) for a, b, c in found if c.strip()]


def song_xml(text: str) -> list[tuple[float, float, str]]:
    """Notes of an annotation in XML, in samples at 32 kHz within sequences."""
    out = []
    for sequence in ET.fromstring(text).iter("Sequence"):
        start = float(sequence.findtext("Position", "0"))
        for note in sequence.iter("Note"):
            begin = start + float(note.findtext("Position", "0"))
            out.append((begin / 32_000, (begin + float(note.findtext("Length", "0"))) / 32_000, note.findtext("Label", "")))
    return out


READERS: dict[str, Reader] = {
    "simple-seq": _delimited("onset_s", "offset_s", "label"),
    "generic-seq": _delimited("onset_s", "offset_s", "label"),
    "raven": _delimited("Begin Time (s)", "End Time (s)", "Annotation", "\t"),
    "aud-seq": _parsed(audacity),
    "textgrid": _parsed(textgrid),
    "birdsong-recognition-dataset": _parsed(song_xml),
    "notmat": _parsed(notmat),
}
#: Formats whose readers take bytes.
BINARY = {"notmat"}


def reader(name: str) -> Reader:
    if name not in READERS:
        raise ValueError(f"unknown annotation format {name!r}; known: {', '.join(sorted(READERS))}")
    return READERS[name]


def _local(path: Column) -> Column:
    """A path without its scheme, so that names from a listing and from a manifest meet."""
    return F.regexp_replace(F.regexp_replace(path, r"^[a-z]+:(//)?", ""), "%20", " ")


def _checked(rows: DataFrame, where: str = "path") -> DataFrame:
    """``rows``, where reading one whose offset does not follow its onset fails and names its file."""
    message = F.concat(F.lit("offset does not follow onset in "), F.col(where))
    return rows.withColumn("offset_s", F.when(F.col("offset_s") > F.col("onset_s"), F.col("offset_s")).otherwise(F.raise_error(message).cast("double")))


def _policy(on_missing: str) -> None:
    if on_missing not in POLICIES:
        raise ValueError(f"on_missing must be one of {POLICIES}, not {on_missing!r}")


def load_from_manifest(spark: SparkSession, manifest: DataFrame, annot_root: str, annot_format: str = "simple-seq", source: str = "lab", on_missing: str = "raise") -> tuple[DataFrame, DataFrame]:
    """(the canonical table of the manifest's annotations, one row with n_missing).

    The annotation files below ``annot_root`` are read in one scan and joined to the manifest by path.
    A recording without its file raises, or is counted.
    """
    _policy(on_missing)
    read = reader(annot_format)
    wanted = manifest.withColumn("_path", _local(F.col("annot_path")))
    suffix = wanted.agg(F.max(F.regexp_extract("annot_path", r"(\.[^./]+)$", 1))).first()[0] or ""
    there = listing(spark, annot_root, suffix).select(_local(F.col("path")).alias("_path"))
    missing = wanted.join(there, "_path", "left_anti")
    count = missing.agg(F.count(F.lit(1)).alias("n_missing"))
    if on_missing == "raise":
        first = [r[0] for r in missing.select("annot_path").limit(5).collect()]
        if first:
            raise FileNotFoundError(f"annotation file(s) missing: {', '.join(first)}")
    files = (contents if annot_format in BINARY else texts)(spark, annot_root, suffix).withColumn("_path", _local(F.col("path")))
    files = files.join(wanted.select("_path"), "_path", "left_semi")
    rows = _checked(read(files)).withColumn("_path", _local(F.col("path"))).drop("path")
    joined = rows.join(wanted, "_path").withColumns(
        {
            "audio_file": base_name("audio_path"), "day": F.to_date("timestamp"), "duration_s": F.col("offset_s") - F.col("onset_s"),
            "source": F.lit(source),
        }
    )
    return canonical(joined), count


def load_flat(annotations: DataFrame, audio: DataFrame, bird: str, pattern: str, timestamp_format: str, columns: dict[str, str] | None = None, source: str = "lab", on_missing: str = "raise", group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(the canonical table, one row with n_missing_audio, n_unparsed and n_invalid).

    ``annotations`` names a recording, an onset, an offset and a label in each row; ``columns`` maps
    these names (audio_file, onset_s, offset_s, label) to its own. ``audio`` has the paths of the
    recordings; of equal names the first path counts. Rows whose offset does not follow their onset
    are left out and counted.
    """
    _policy(on_missing)
    names = {c: (columns or {}).get(c, c) for c in ("audio_file", "onset_s", "offset_s", "label")}
    require(annotations, names.values(), "annotation file")
    kinds = {"onset_s": "double", "offset_s": "double"}
    rows = annotations.select(*[F.col(v).cast(kinds.get(k, "string")).alias(k) for k, v in names.items()])
    rows = rows.withColumn("audio_file", base_name("audio_file"))
    index = audio.groupBy(base_name("path").alias("audio_file")).agg(F.min("path").alias("audio_path"))
    joined = rows.join(index, "audio_file", "left")
    fields = named_groups("audio_file", pattern)
    if "timestamp" not in fields:
        raise ValueError("the pattern lacks the named group timestamp")
    joined = joined.withColumn("timestamp", stamp(fields["timestamp"], timestamp_format))
    missing = F.count_distinct(F.when(F.col("audio_path").isNull(), F.col("audio_file")))
    invalid = ~F.coalesce(F.col("offset_s") > F.col("onset_s"), F.lit(False))
    counts = joined.agg(
        missing.alias("n_missing_audio"), F.count_distinct(F.when(F.col("timestamp").isNull(), F.col("audio_file"))).alias("n_unparsed"),
        F.count_if(invalid).alias("n_invalid"),
    )
    if on_missing == "raise":
        n = counts.first()["n_missing_audio"]
        if n:
            raise FileNotFoundError(f"{n} recording(s) of the annotations have no audio file")
    good = joined.where("audio_path is not null and timestamp is not null").where(~invalid).withColumns(
        {"bird": F.lit(bird), "day": F.to_date("timestamp"), "duration_s": F.col("offset_s") - F.col("onset_s"), "source": F.lit(source)}
    )
    return canonical(good.withColumn("group", F.lit(group)) if group is not None else good), counts


def first_of_each(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")
