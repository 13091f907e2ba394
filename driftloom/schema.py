"""The canonical event table and the checks on column names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("bird", T.StringType()),
        T.StructField("day", T.DateType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("audio_file", T.StringType()),
        T.StructField("audio_path", T.StringType()),
        T.StructField("template", T.StringType()),
        T.StructField("onset_s", T.DoubleType()),
        T.StructField("offset_s", T.DoubleType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("label", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)
#: A table is ordered by these; the last two only make the order of equal rows definite.
ORDER = ("bird", "timestamp", "onset_s", "audio_path", "label")


def empty_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENTS)


def require(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """``df``, or a ValueError that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required column(s) {missing}")
    return df


def canonical(df: DataFrame) -> DataFrame:
    """The canonical columns (and ``group``, if there is one) with their types, in order."""
    fields = [*EVENTS.fields, *([T.StructField("group", T.StringType())] if "group" in df.columns else [])]
    have = {f.name: F.col(f.name) if f.name in df.columns else F.lit(None) for f in fields}
    return df.select(*[have[f.name].cast(f.dataType).alias(f.name) for f in fields])


def validated(df: DataFrame) -> DataFrame:
    """``df`` with all canonical columns; reading a row whose offset does not follow its onset fails."""
    require(df, EVENTS.names)
    ordered = F.col("offset_s") > F.col("onset_s")
    checked = F.when(ordered, F.col("offset_s")).otherwise(
        F.raise_error(F.concat(F.lit("offset does not follow onset in "), F.coalesce("audio_file", F.lit("?")))).cast("double")
    )
    return df.withColumn("offset_s", checked)
