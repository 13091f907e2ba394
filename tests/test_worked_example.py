from pyspark.sql import functions as F

from driftloom.plans import report
from examples import worked_example


def test_altered_individuals_stand_out(spark, tmp_path):
    found, comparison = worked_example.run(spark, str(tmp_path / "example"), per_group=3, bouts=5)
    over = {r["bird"]: r["n"] for r in found.pairs.select("bird", F.col("n_types_exceeding_centroid_floor").alias("n")).collect()}
    assert all(over[f"s0{i}"] >= 1 for i in range(3))
    assert comparison["observed_difference"] > 0
    assert comparison["p_value"] <= 3 / 21  # two of twenty ways to deal the groups are as extreme
    again = report.read_json(str(tmp_path / "example" / "result.json"), spark)
    assert len(again["individuals"]["birds"]) == 6
