"""Studies with one result each: floors beside drift, development towards an endpoint, the build of a set of renditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.lineage import cut
from driftloom.operators import audio as A
from driftloom.operators import clean as C
from driftloom.operators import drift as D
from driftloom.operators import matching as MT
from driftloom.operators import moments as M
from driftloom.operators import resampling as R
from driftloom.plans import report, studies
from driftloom.sources.files import write_text

SECTIONS = "section string, separation int, n long, mean double, p95 double, share double"


def _sections(null: DataFrame, pairs: DataFrame, value: Column) -> DataFrame:
    """section, separation, n, mean, p95, share: the null draws, and the day pairs by how many days lie between.

    ``share`` is that of negative values among the draws, and that over the floor (the draws' 95th
    percentile) among the pairs.
    """
    null, pairs = null.select(value.alias("x")), pairs.select(F.datediff("day_b", "day_a").alias("separation"), value.alias("x"))
    p95 = F.percentile("x", F.lit(0.95)).alias("p95")
    n, mean = F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean")
    first = null.agg(n, mean, p95, F.avg((F.col("x") < 0).cast("double")).alias("share"))
    first = first.select(F.lit("null").alias("section"), F.lit(None).cast("int").alias("separation"), "n", "mean", "p95", "share")
    first = cut(first)
    floor = first.select(F.col("p95").alias("floor"))  # one row
    over = F.avg((F.col("x") > F.col("floor")).cast("double")).alias("share")
    rest = pairs.crossJoin(F.broadcast(floor)).groupBy("separation").agg(n, mean, p95, over)
    return first.unionByName(rest.select(F.lit("pairs").alias("section"), "separation", "n", "mean", "p95", "share"))


def centroid_study(moments: DataFrame, by: Sequence[str], n_draws: int = 200, seed: int = 0) -> DataFrame:
    """The noise floor of centroid drift, pooled over groups and days, beside the drift of all day pairs."""
    means = M.bout_means(moments)
    drift = D.centroid_drift(M.unit_moments(means, [*by, "day"]), by, "day")
    return _sections(R.centroid_null(means, [*by, "day"], n_draws, seed), drift, F.col("drift"))


def dispersion_study(moments: DataFrame, by: Sequence[str], n_draws: int = 200, seed: int = 0) -> DataFrame:
    """The noise floor of the variances' log ratio, either way, beside that of all day pairs."""
    ratios = D.dispersion_drift(M.total_variance(moments, [*by, "day"]), by, "day")
    return _sections(R.dispersion_null(moments, [*by, "day"], n_draws, seed), ratios, F.abs("log_ratio"))


def development(points: DataFrame, endpoint: Column) -> DataFrame:
    """measure, n, value: consecutive days, days a week or more apart, and the way to the ``endpoint`` days.

    Drift is the mean over labels and day pairs; convergence is the rank correlation, and the slope by
    day, of the other days' distances to the endpoint's pooled bouts.
    """
    units = M.unit_moments(M.bout_means(M.bout_moments(points, ["label", "day"])), ["label", "day"])
    drift = D.centroid_drift(units, ["label"], "day").withColumn("gap", F.datediff("day_b", "day_a"))
    rows = []
    for name, which in (("consecutive", F.col("gap") == 1), ("week_or_more", F.col("gap") >= 7)):
        rows.append(drift.where(which).agg(F.count(F.lit(1)).alias("n"), F.avg("drift").alias("value")).select(F.lit(name).alias("measure"), "n", "value"))
    found = cut(studies.convergence(studies.distances_to_reference(points.where(~endpoint), points.where(endpoint))))
    rows += [found.select(F.lit(name).alias("measure"), "n", F.col(name).alias("value")) for name in ("rho", "slope")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def windows_over_floors(points: DataFrame, early: tuple, late: tuple, least: int, n_draws: int = 200, seed: int = 0) -> DataFrame:
    """label, n_early, n_late, log_ratio, floor, over: whether a label's variance changed by more than halves of its days differ."""
    ratios = studies.window_ratios(points, early, late, least)
    usable = M.bout_moments(D.supported_sides(points, ["label", "day"]), ["label", "day"])
    null = R.dispersion_null(usable, ["label", "day"], n_draws, seed)
    floors = R.floor_of(null, ["label"], "log_ratio", absolute=True).select("label", "floor")
    return ratios.join(floors, "label", "left").withColumn("over", F.abs("log_ratio") > F.col("floor"))


def segmentation_evaluation(recordings: DataFrame, truth: DataFrame, grid: Sequence[float], tolerance: float = 0.01, margin: float = 0.05, **settings: float) -> DataFrame:
    """day, threshold, n_true, n_pred, n_matched, precision, recall, f1 of each day but the first, on which the threshold is tuned.

    ``recordings`` has audio_path, content and day; ``truth`` audio_path, onset_s and offset_s. What is
    found outside the annotated span of a recording, give or take the margin, does not count.
    """
    first = recordings.agg(F.min("day")).first()[0]
    tuning, rest = recordings.where(F.col("day") == F.lit(first)), recordings.where(F.col("day") > F.lit(first))
    of_first, of_rest = (truth.join(r.select("audio_path"), "audio_path", "left_semi") for r in (tuning, rest))
    threshold, _ = A.tuned_threshold(tuning, of_first, grid, tolerance, **settings)
    found = A.amplitude_segments(rest, A.AmplitudeSegmenter(threshold=threshold, **settings))
    counts = MT.segment_counts(of_rest, C.within_span(found, of_rest, ["audio_path"], margin), ["audio_path"], tolerance)
    by_day = MT.pooled(counts.join(rest.select("audio_path", "day"), "audio_path"), ["day"])
    return by_day.withColumn("threshold", F.lit(float(threshold)))


def rendition_set(rows: DataFrame, label: str, day: str, key: str, exclude: Sequence[str] = (), min_count: int = 1, max_per_day: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(the rows kept, a summary by label): labels taken out by name, then rare ones, then a cap on each label and day, by hash.

    The summary has every label: n (in the table), n_kept, n_days and why (excluded, rare or kept).
    """
    named = C.exclude(rows, label, exclude)
    counts = named.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    often = counts.where(F.col("_n") >= min_count).select(label)
    kept = named.join(F.broadcast(often) if often.limit(10_001).count() <= 10_000 else often, label, "left_semi")
    if max_per_day is not None:
        kept = C.stratified_cap(kept, [day, label], key, max_per_day, seed)
    all_counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    kept_counts = kept.groupBy(label).agg(F.count(F.lit(1)).alias("n_kept"), F.count_distinct(day).alias("n_days"))
    why = F.when(F.col(label).isin(list(exclude)) if exclude else F.lit(False), "excluded").when(F.col("n_kept").isNull(), "rare").otherwise("kept")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_kept", "n_days")]
    return kept, all_counts.join(kept_counts, label, "left").select(label, "n", *zero, why.alias("why"))


def write_set(kept: DataFrame, summary: DataFrame, path: str) -> None:
    """The rows as Parquet at ``path`` and the summary as JSON beside it."""
    import json

    kept.write.mode("overwrite").parquet(path)
    write_text(json.dumps(report.study_rows(summary), indent=1, default=str), f"{path.rstrip('/')}.summary.json", kept.sparkSession)
