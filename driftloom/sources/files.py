"""Single small text files on any file system that Spark reads: reports, manifests, configurations."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(path: str, spark: SparkSession | None):  # noqa: ANN202
    spark = spark or SparkSession.builder.getOrCreate()
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def exists(path: str, spark: SparkSession | None = None) -> bool:
    where, system, _ = _path(path, spark)
    return system.exists(where)


def is_folder(path: str, spark: SparkSession | None = None) -> bool:
    where, system, _ = _path(path, spark)
    return system.exists(where) and system.getFileStatus(where).isDirectory()


def write_text(text: str, path: str, spark: SparkSession | None = None) -> None:
    """``text`` as one file, in place of what is there; folders are made as needed."""
    where, system, _ = _path(path, spark)
    out = system.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(path: str, spark: SparkSession | None = None) -> str:
    where, system, jvm = _path(path, spark)
    stream = system.open(where)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
