"""Extensions for unbounded input: sessions by gaps, and daily moments that can be merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(events: DataFrame, by: Sequence[str], ts: str, gap_seconds: float, late: str = "1 hour") -> DataFrame:
    """by, start, end, n: sessions as in ``operators.sessions``; events later than ``late`` are left out."""
    if gap_seconds <= 0:
        raise ValueError(f"the gap must be positive, not {gap_seconds}")
    marked = events.withWatermark(ts, late)
    window = F.session_window(ts, F.lit(f"{gap_seconds} seconds"))
    found = marked.groupBy(*by, window.alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("end"))
    return found.select(*by, F.col("_w.start").alias("start"), "end", "n")


def daily_moments(points: DataFrame, by: Sequence[str], ts: str, late: str = "1 day") -> DataFrame:
    """by, day, n, sx, sxx of ``value`` per day: what centroid and dispersion drift need, kept up to date."""
    window = F.window(ts, "1 day")
    found = points.withWatermark(ts, late).groupBy(*by, window.alias("_w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("sx"), F.sum(F.col("value") * F.col("value")).alias("sxx")
    )
    return found.select(*by, F.to_date("_w.start").alias("day"), "n", "sx", "sxx")
