"""What file and directory names say: recording names, day directories, patterns with named groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.scalars import base_name

#: The end of a recording's name: DDMMYY, HHMM, a serial that may be negative, and the file's suffix.
RECORDING = r"^(.+)_(\d{6})_(\d{4})\.(-?\d+)\.wav(?:\.csv)?$"


def recording(path: str | Column) -> dict[str, Column]:
    """bird, template, timestamp and serial of names like bird[_template]_DDMMYY_HHMM.serial.wav; null where they don't fit."""
    name = base_name(path)
    fits = name.rlike(RECORDING)
    head = F.regexp_extract(name, RECORDING, 1)
    stem = F.concat(F.regexp_extract(name, RECORDING, 2), F.lit("_"), F.regexp_extract(name, RECORDING, 3))
    template = F.rtrim(F.regexp_extract(head, "^[^_]+_+(.+?)_*$", 1))
    return {
        "bird": F.when(fits, F.regexp_extract(head, "^([^_]+)", 1)),
        "template": F.when(fits & (template != ""), template),
        "timestamp": F.when(fits, F.try_to_timestamp(stem, F.lit("ddMMyy_HHmm")).cast("timestamp_ntz")),
        "serial": F.when(fits, F.regexp_extract(name, RECORDING, 4).cast("int")),
    }


def directory_day(name: str | Column) -> Column:
    """The date of a day directory named MMDDYY, or null."""
    name = F.col(name) if isinstance(name, str) else name
    return F.when(name.rlike(r"^\d{6}$"), F.to_date(F.try_to_timestamp(name, F.lit("MMddyy"))))


def parent(path: str | Column, level: int = 1) -> Column:
    return F.element_at(F.split(path, "/"), -1 - level)


def listing(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """path of every file below ``root`` with a suffix, empty ones too: Spark's own file index, no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}")
    return spark.createDataFrame([(f,) for f in files.load(root).inputFiles()], "path string")


def sizes(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """path and length of the files below ``root`` that are not empty; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}")
    return files.load(root).select("path", "length")


def largest(files: DataFrame, least: int = 1000) -> str:
    """The path of the largest file over ``least`` bytes."""
    found = files.where(F.col("length") > least).orderBy(F.desc("length"), "path").first()
    if found is None:
        raise ValueError(f"no file of over {least} bytes")
    return found["path"]
