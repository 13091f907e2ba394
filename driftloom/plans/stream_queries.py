"""Queries on streams: the tables' rows come file by file, in no order, and the result is that of the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions.lineage import cut, shared_folder
from driftloom.functions.scalars import rounded
from driftloom.operators import drift as D
from driftloom.operators import moments as M
from driftloom.plans import tables as T
from driftloom.plans.registering import registry
from driftloom.plans.tables import sql_round
from driftloom.sources import store
from driftloom.streaming import drift as SD

QUERIES, ORACLES, query = registry()
FILES, AT_ONCE = 6, 2
#: Longer than the table's span: files come in no order, so none may be left out as late.
LATE = "3650 days"


@query(f"""with bm as (select event_type, ts::date as day, user_id as bout, avg(value) as m from events where value is not null and ts is not null and user_id is not null and event_type is not null group by all),
    s as (select event_type, day, avg(m) as mu, var_samp(m) as v, count(*) as units from bm group by all having count(*) >= 2)
    select a.event_type, a.day as day_a, b.day as day_b, {sql_round("(a.mu - b.mu) * (a.mu - b.mu) - a.v / a.units - b.v / b.units")} as drift
    from s a join s b on a.event_type = b.event_type and a.day < b.day""")
def streamed_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroid drift of all day pairs from bouts' moments that a stream of event files has kept up to date."""
    folder = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    events = T.events(spark, sf_dir).where("value is not null and ts is not null and user_id is not null and event_type is not null")
    points = events.select(
        F.lit("all").alias("bird"), F.col("event_type").alias("label"), "day", F.col("user_id").cast("string").alias("bout"),
        F.col("ts").cast("timestamp").alias("ts"), F.array(F.col("value").cast("double")).alias("z"),
    )
    try:
        points.repartition(FILES, F.xxhash64("bout", "ts")).write.parquet(f"{folder}/in")
        stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", AT_ONCE).parquet(f"{folder}/in")
        running = SD.keep_up(stream, f"{folder}/table", f"{folder}/checkpoint", LATE)
        running.awaitTermination()
        if running.exception() is not None:
            raise running.exception()
        moments = cut(SD.moments(spark, f"{folder}/table", ["label", "day"]))
    finally:
        system, path = store.located(folder)
        system.delete_dir(path)
    drift = D.centroid_drift(M.unit_moments(M.bout_means(moments), ["label", "day"]), ["label"], "day")
    return drift.select(F.col("label").alias("event_type"), "day_a", "day_b", rounded("drift").alias("drift"))
