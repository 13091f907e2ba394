"""Files are made in all tasks, however few bytes their rows have, and read a frame at a time."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftloom.plans import file_queries as FQ
from driftloom.sources import annotations


def test_rows_of_few_bytes_become_files_in_several_tasks(spark):
    rows = spark.range(200).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    files = FQ.packed(rows, F.format_string("%s.txt", F.col("id").cast("string")), lambda x: b"x").withColumn("task", F.spark_partition_id())
    found = files.collect()
    assert len({r["name"] for r in found}) == 200 and len({r["task"] for r in found}) == 4


class Frames:
    """Stands for a DataFrame of files: keeps what maps its frames."""

    def select(self, *_):
        return self

    def mapInPandas(self, run, _):  # noqa: N802
        self.run = run
        return self


def test_a_frame_of_files_is_passed_on_at_once_and_errors_name_the_file():
    run = annotations.READERS["aud-seq"](Frames()).run
    frame = pd.DataFrame({"path": [f"f{i}" for i in range(50)], "value": ["1\t2\ta\n3\t4\tb\n"] * 49 + [""]})
    (out,) = run(iter([frame]))
    assert len(out) == 98 and out.iloc[2].tolist() == ["f1", 1.0, 2.0, "a"]
    with pytest.raises(ValueError, match="f50: "):
        list(run(iter([pd.DataFrame({"path": ["f50"], "value": ["x\ty\tz"]})])))
