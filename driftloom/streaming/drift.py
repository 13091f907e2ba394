"""Drift kept up to date: bouts' moments as state, a log of their latest values, and drift from it at any time.

A stream of points (bird, label, day, bout, ts, z) is summed up per bout and task first. The state of
an individual, type and day is the moments of its bouts, in ``PARTS`` parts by a hash of the bout; a part
is read and written once for each micro-batch, not bout by bout. Sums can be taken in any order, so late and
shuffled points give what sorted ones give. Each micro-batch passes on the bouts that it has changed,
and writes them to a folder of its own; a batch that is run again after a failure writes the same
folder again. The latest values of all bouts are what ``operators.moments`` has for the whole table,
so drift, floors and intervals are computed from them as ever. When the watermark has passed the end
of a day its bouts are passed on once more, as closed, and its state is dropped.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SUMS = "n long, sx array<double>, sxx array<double>"
KEYS = ("bird", "label", "day")
_DAY_MS = 86_400_000
#: Parts of the state of an individual, type and day, and what one holds.
PARTS = 16
HELD = "bout array<string>, n array<bigint>, sx array<array<double>>, sxx array<array<double>>"


def partial_moments(points: DataFrame) -> DataFrame:
    """bird, label, day, bout, ts (the latest) and sums of the points of each batch of each task: few rows leave a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.dropna(subset=[*KEYS, "bout"]).reset_index(drop=True)
            for _, own in frame.groupby(frame["z"].map(len)):  # vectors of one width at once
                groups = own.groupby([*KEYS, "bout"], sort=False)
                code = groups.ngroup().to_numpy()
                order = np.argsort(code, kind="stable")
                begins = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])
                z = np.stack([np.asarray(v, np.float64) for v in own["z"]])[order]
                out = own.iloc[order[begins]][[*KEYS, "bout"]].reset_index(drop=True)
                out["ts"], out["n"] = groups["ts"].max().to_numpy(), np.diff(np.r_[begins, len(code)])
                out["sx"], out["sxx"] = (list(np.add.reduceat(v, begins, axis=0)) for v in (z, z * z))
                yield out

    return points.select(*[F.col(c).cast("string") for c in ("bird", "label")], "day", F.col("bout").cast("string"), F.col("ts").cast("timestamp"), "z").mapInPandas(
        run, f"bird string, label string, day date, bout string, ts timestamp, {SUMS}"
    )


class BoutMoments(StatefulProcessor):
    """The moments of the bouts of one part of an individual, type and day."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bouts = handle.getValueState("bouts", HELD)

    def _held(self) -> dict:
        return {bout: sums for bout, *sums in zip(*self.bouts.get())} if self.bouts.exists() else {}

    def _rows(self, key: tuple, found: dict, closed: bool) -> pd.DataFrame:
        rows = [(*key[:3], bout, *sums, closed) for bout, sums in found.items()]
        return pd.DataFrame(rows, columns=[*KEYS, "bout", "n", "sx", "sxx", "closed"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, changed = self._held(), {}
        for frame in rows:
            for bout, n, sx, sxx in zip(*(frame[c] for c in ("bout", "n", "sx", "sxx"))):
                m, x, xx = changed.get(bout) or held.get(bout) or (0, 0.0, 0.0)
                changed[bout] = (m + int(n), np.asarray(x) + sx, np.asarray(xx) + sxx)
        changed = {bout: (n, x.tolist(), xx.tolist()) for bout, (n, x, xx) in changed.items()}
        held.update(changed)
        self.bouts.update((list(held), *(list(v) for v in zip(*held.values()))))
        end = (key[2] - dt.date(1970, 1, 1)).days * _DAY_MS + _DAY_MS
        self.handle.registerTimer(end)
        yield self._rows(key, changed, False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        self.bouts.clear()
        yield self._rows(key, held, True)

    def close(self) -> None:
        pass


def changed_bouts(points: DataFrame, late: str = "1 day") -> DataFrame:
    """The bouts that each micro-batch of a stream of points has changed, with all of their moments; and those of days that close."""
    partial = partial_moments(points).withWatermark("ts", late).withColumn("part", F.pmod(F.xxhash64("bout"), F.lit(PARTS)).cast("int"))
    schema = f"bird string, label string, day date, bout string, {SUMS}, closed boolean"
    return partial.groupBy(*KEYS, "part").transformWithStateInPandas(BoutMoments(), schema, outputMode="Update", timeMode="EventTime")


def keep_up(points: DataFrame, table: str, checkpoint: str, late: str = "1 day", available: bool = True) -> StreamingQuery:
    """Starts the stream that keeps ``table`` (a folder) up to date; with ``available`` it ends when all that is there has been read.

    ``checkpoint`` has its progress and state: started anew with the same two folders, it goes on where
    it was. Points that come more than ``late`` after the latest may be left out.
    """
    spark = points.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    stream = changed_bouts(points, late).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available else stream).start()


def latest(spark: SparkSession, table: str) -> DataFrame:
    """bird, label, day, bout, n, sx, sxx, closed of every bout: as the last batch that has it says."""
    rows = spark.read.parquet(table)
    last = F.max_by(F.struct("n", "sx", "sxx", "closed"), F.struct("batch", "closed"))
    return rows.groupBy(*KEYS, "bout").agg(last.alias("_v")).select(*KEYS, "bout", "_v.*")


def compacted(spark: SparkSession, table: str, to: str) -> None:
    """The latest values in a folder ``to``, as one batch that later ones come after; ``table`` is left as it is."""
    number = spark.read.parquet(table).agg(F.max("batch")).first()[0]
    latest(spark, table).write.mode("overwrite").parquet(f"{to}/batch={number}")


def moments(spark: SparkSession, table: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, bout, dim, n, sx, sxx: what ``operators.moments.bout_moments`` has for all points so far."""
    rows = latest(spark, table).select(*keys, "bout", "n", F.posexplode(F.arrays_zip("sx", "sxx")).alias("dim", "s"))
    return rows.select(*keys, "bout", "dim", "n", F.col("s.sx").alias("sx"), F.col("s.sxx").alias("sxx"))
