"""Dataset trees, text segments, wide tables and audio files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.scalars import base_name
from driftloom.schema import canonical
from driftloom.sources.annotations import READERS, _checked, _local, texts
from driftloom.sources.names import directory_day, listing, parent, recording


def _parsed(files: DataFrame) -> DataFrame:
    fields = recording("path")
    return files.withColumns({**fields, "dir_day": directory_day(parent("path")), "day": F.to_date(fields["timestamp"])})


def load_dataset(spark: SparkSession, root: str, source: str = "tree", on_date_mismatch: str = "raise") -> tuple[DataFrame, DataFrame]:
    """(the canonical table of a tree {bird}/{MMDDYY}/*.wav with *.wav.csv beside, its coverage).

    One scan of the whole tree. Coverage has, for each day directory, n_audio, n_annotated,
    n_unannotated and n_date_mismatch; a name whose date differs from its directory's raises, or is
    left out and counted.
    """
    if on_date_mismatch not in ("raise", "skip"):
        raise ValueError(f"on_date_mismatch must be raise or skip, not {on_date_mismatch!r}")
    audio = _parsed(listing(spark, root, ".wav"))
    notes = _parsed(listing(spark, root, ".wav.csv"))
    wrong = notes.where(F.col("day").isNull() | ~F.col("day").eqNullSafe(F.col("dir_day")))
    if on_date_mismatch == "raise":
        bad = [base for (base,) in wrong.select(base_name("path")).limit(5).collect()]
        if bad:
            raise ValueError(f"date in the name differs from the directory's: {', '.join(bad)}")
    good = notes.where(F.col("day").eqNullSafe(F.col("dir_day")))
    counts = [
        audio.groupBy("dir_day").agg(F.count(F.lit(1)).alias("n_audio")),
        good.groupBy("dir_day").agg(F.count(F.lit(1)).alias("n_annotated")),
        wrong.groupBy("dir_day").agg(F.count(F.lit(1)).alias("n_date_mismatch")),
    ]
    cover = counts[0].join(counts[1], "dir_day", "full").join(counts[2], "dir_day", "full").na.fill(0)
    cover = cover.withColumn("n_unannotated", F.greatest(F.col("n_audio") - F.col("n_annotated"), F.lit(0).cast("long")))
    fields = good.withColumn("_path", _local(F.col("path"))).drop("path")
    files = texts(spark, root, ".wav.csv").withColumn("_path", _local(F.col("path"))).join(fields.select("_path"), "_path", "left_semi")
    rows = _checked(READERS["simple-seq"](files)).withColumn("_path", _local(F.col("path"))).drop("path")
    table = rows.join(fields, "_path").withColumns(
        {
            "audio_path": F.regexp_replace("_path", r"\.csv$", ""), "audio_file": base_name(F.regexp_replace("_path", r"\.csv$", "")),
            "duration_s": F.col("offset_s") - F.col("onset_s"), "source": F.lit(source),
        }
    )
    return canonical(table), cover


def text_segments(lines: DataFrame, line: str = "value") -> DataFrame:
    """``lines`` with onset_s and offset_s; comments, and lines that are not two numbers, are left out."""
    parts = F.split(F.trim(line), r"\s+")
    rows = lines.where(~F.col(line).rlike(r"^\s*(#|$)"))
    number = {k: F.get(parts, i).try_cast("double") for i, k in enumerate(("onset_s", "offset_s"))}
    return rows.withColumns(number).where("onset_s is not null and offset_s is not null")


def inventory(files: DataFrame) -> DataFrame:
    """Files, sounds and seconds per bird and day, with subtotals; ``files`` has bird, day, sounds, seconds."""
    return files.rollup("bird", "day").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("sounds").alias("n_sounds"), F.sum("seconds").alias("seconds"),
        F.grouping_id().alias("level"),
    )


def wide_table(spark: SparkSession, path: str, prefix: str, width: int, age: str = "dph") -> tuple[DataFrame, DataFrame]:
    """(rows with z and the age's digits, one row with n_rows, n_no_age and n_null): a CSV with ``prefix``1 to ``width``."""
    columns = [f"{prefix}{i}" for i in range(1, width + 1)]
    rows = spark.read.csv(path, header=True)
    rows = rows.withColumn("age", F.regexp_extract(age, r"(\d+)", 1).try_cast("int"))
    rows = rows.withColumn("z", F.array(*[F.col(c).try_cast("double") for c in columns])).drop(*columns)
    whole = F.forall("z", lambda x: x.isNotNull())
    counts = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("age").isNull()).alias("n_no_age"), F.count_if(~whole).alias("n_null"))
    return rows.where(whole & F.col("age").isNotNull()), counts


def marked(measurements: DataFrame, notes: str, markers: list[str]) -> DataFrame:
    """``measurements`` with t0: the earliest stamp of a note (array of text, timestamp) whose text is one of ``markers``."""
    kept = F.filter(notes, lambda a: F.lower(F.trim(a["text"])).isin(*[m.lower() for m in markers]))
    return measurements.withColumn("t0", F.array_min(F.transform(kept, lambda a: a["timestamp"])))


def wav_files(spark: SparkSession, root: str) -> DataFrame:
    """audio_path and content of the WAV files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(root)
    return files.select(_local(F.col("path")).alias("audio_path"), "content")


def newest_metrics(files: DataFrame, pattern: str) -> Column:
    """The last path, by name, that matches ``pattern``; an aggregate over ``path``."""
    return F.max(F.when(F.col("path").rlike(pattern), F.col("path")))
