"""The whole analysis: features, embedding, noise floors, and drift of every day pair against them."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.lineage import cut
from driftloom.operators import clean as C
from driftloom.operators import drift as D
from driftloom.operators import moments as M
from driftloom.operators import resampling as R
from driftloom.operators import sessions as S
from driftloom.operators.audio import Spectrogram, spectrograms
from driftloom.operators.embedding import embedded

SYNTAX_DRAWS, SYNTAX_SEED = 100, 0
BIRD, TYPE, SIDE = ["bird"], ["bird", "label"], ["bird", "label", "day"]


@dataclass(frozen=True)
class AnalysisConfig:
    n_pca: int = 64
    n_freq_bins: int = 32
    max_duration_s: float = 0.2
    hop_length: int = 64
    n_fft: int = 512
    freq_range_hz: tuple[float, float] = (500.0, 10_000.0)
    dynamic_range_db: float = 60.0
    max_per_day: int | None = 2000
    exclude_labels: tuple[str, ...] = ()
    min_renditions: int = 20
    min_bouts: int = 4
    n_boot: int = 400
    n_null: int = 300
    seed: int = 0
    #: Leave excluded labels out before pairs of neighbours are formed; else leave out the pairs.
    splice: bool = True

    def spectrogram(self) -> Spectrogram:
        return Spectrogram(self.n_fft, self.hop_length, self.freq_range_hz, self.max_duration_s, self.n_freq_bins, self.dynamic_range_db)

    def to_dict(self) -> dict:
        return asdict(self)


class Analysis(NamedTuple):
    """One row per individual, and one per individual and day pair."""

    birds: DataFrame
    pairs: DataFrame


def sampled(table: DataFrame, config: AnalysisConfig) -> DataFrame:
    """Rows of the labels wanted, at most ``max_per_day`` of each individual and day, chosen by hash."""
    rows = C.exclude(table, "label", config.exclude_labels)
    key = F.concat_ws("|", "audio_path", F.format_number("onset_s", 9), F.format_number("offset_s", 9), "label")
    return C.stratified_cap(rows.withColumn("_key", key), ["bird", "day"], "_key", config.max_per_day, config.seed).drop("_key")


def points_of(table: DataFrame, recordings: DataFrame, config: AnalysisConfig) -> tuple[DataFrame, DataFrame]:
    """(bird, day, label, bout, z of every syllable sampled; the repair counts)."""
    rows = sampled(table, config).select("audio_path", "audio_file", "bird", "day", "label", "onset_s", "offset_s")
    features, repairs = spectrograms(rows, recordings, config.spectrogram())
    z = embedded(features.select("bird", "day", "label", F.col("audio_file").alias("bout"), "features"), BIRD, "day", config.n_pca)
    return z, repairs


def analyse_points(points: DataFrame, config: AnalysisConfig = AnalysisConfig(), table: DataFrame | None = None) -> Analysis:
    """The analysis from embedded points (bird, day, label, bout, z); with ``table``, syntax as well.

    All draws join bouts' moments, which are aggregated once. A floor pools the draws of all days and
    types of an individual; where there is none, floors and comparisons with them are null or 0.
    """
    points = cut(C.with_days(points, "bird", "day").select("bird", "day", "label", "bout", "z"))
    moments = cut(M.bout_moments(centred_points(points), SIDE))
    support = moments.where("dim = 0").groupBy(*SIDE).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_bouts"))
    rows_ok = F.col("n_rows") >= config.min_renditions
    for_null = support.where(rows_ok & (F.col("n_bouts") >= config.min_bouts)).select(*SIDE)
    for_pairs = support.where(rows_ok & (F.col("n_bouts") >= 2)).select(*SIDE)

    variances = M.total_variance(moments, SIDE)
    scale = cut(D.within_type_scale(variances, BIRD, "day"))
    null_moments = cut(moments.join(for_null, SIDE, "left_semi"))
    centroid = R.centroid_null(M.bout_means(null_moments), SIDE, config.n_null, config.seed)
    spread = R.dispersion_null(null_moments, SIDE, config.n_null, config.seed)
    floors = cut(
        scale.join(R.floor_of(centroid, BIRD, "drift").select("bird", F.col("floor").alias("centroid_floor")), BIRD, "left")
        .join(R.floor_of(spread, BIRD, "log_ratio", absolute=True).select("bird", F.col("floor").alias("dispersion_floor")), BIRD, "left")
    )

    pair_moments = cut(moments.join(for_pairs, SIDE, "left_semi"))
    pair_means = M.bout_means(pair_moments)
    keys = [*TYPE, "day_a", "day_b"]
    drift = cut(D.centroid_drift(M.unit_moments(pair_means, SIDE), TYPE, "day").select(*keys, "drift"))
    days = drift.select(*keys)
    boot = cut(R.centroid_interval(pair_means, TYPE, "day", days, config.n_boot, config.seed))
    ratio = D.dispersion_drift(M.total_variance(pair_moments, SIDE), TYPE, "day")
    boot_ratio = cut(R.dispersion_interval(pair_moments, TYPE, "day", days, config.n_boot, config.seed))
    typed = (
        drift.join(boot.select(*keys, F.col("low").alias("c_low")), keys)
        .join(ratio, keys).join(boot_ratio.select(*keys, F.col("low").alias("d_low"), F.col("high").alias("d_high")), keys)
        .join(floors, BIRD)
    )
    over_d = (F.col("d_low") > F.col("dispersion_floor")) | (F.col("d_high") < -F.col("dispersion_floor"))
    pairs = typed.groupBy("bird", "day_a", "day_b").agg(
        F.datediff("day_b", "day_a").alias("separation_days"), F.count(F.lit(1)).alias("n_types"),
        F.avg("drift").alias("centroid_drift"), (F.avg("drift") / F.first("scale")).alias("centroid_drift_standardised"),
        F.avg("log_ratio").alias("dispersion_drift"), F.avg(F.abs("log_ratio")).alias("dispersion_drift_abs"),
        F.count_if(F.col("c_low") > F.col("centroid_floor")).alias("n_types_exceeding_centroid_floor"),
        F.count_if(over_d).alias("n_types_exceeding_dispersion_floor"),
    )
    if table is None:
        pairs = pairs.withColumns({"syntax_divergence": F.lit(None).cast("double"), "syntax_exceeds_floor": F.lit(False)})
        floors = floors.withColumn("syntax_floor", F.lit(None).cast("double"))
    else:
        divergence, syntax_floor = syntax(table, points.select("bird", "label").distinct(), config)
        floors = floors.join(syntax_floor, BIRD, "left")
        pairs = pairs.join(divergence, ["bird", "day_a", "day_b"], "left").join(syntax_floor, BIRD, "left")
        exceeds = F.coalesce(F.col("syntax_divergence") > F.col("syntax_floor"), F.lit(False))
        pairs = pairs.withColumn("syntax_exceeds_floor", exceeds).drop("syntax_floor")
    summary = points.groupBy("bird").agg(
        F.count(F.lit(1)).alias("n_syllables"), F.count_distinct("bout").alias("n_bouts"), F.count_distinct("day").alias("n_days"),
        F.min("day").alias("reference_day"), F.array_sort(F.collect_set("day")).alias("days"), F.array_sort(F.collect_set("label")).alias("types"),
    )
    return Analysis(cut(summary.join(floors, BIRD).withColumnRenamed("scale", "within_type_variance")), cut(pairs))


def centred_points(points: DataFrame) -> DataFrame:
    """Points with their individual's mean taken off, which leaves drift and variance as they are."""
    return M.centred(points, BIRD)


def syntax(table: DataFrame, types: DataFrame, config: AnalysisConfig) -> tuple[DataFrame, DataFrame]:
    """(bird, day_a, day_b, syntax_divergence; bird, syntax_floor), from the whole table, never from the sample."""
    keys = ["bird", "day"]
    bout, order = ["bird", "audio_file"], ["onset_s", "offset_s"]
    wanted = table.join(types, ["bird", "label"], "left_semi") if config.splice else table
    pairs = S.bigrams(wanted, bout, order, "label", keys).withColumnRenamed("audio_file", "bout")
    if not config.splice:
        for place in ("first", "second"):
            pairs = pairs.join(types.withColumnRenamed("label", place), ["bird", place], "left_semi")
    pairs = cut(pairs)
    divergence = D.syntax_drift(D.transition_shares(pairs, keys), "day", BIRD).withColumnRenamed("jsd", "syntax_divergence")
    floor = R.floor_of(R.syntax_null(pairs, keys, SYNTAX_DRAWS, SYNTAX_SEED), BIRD, "jsd")
    return cut(divergence), cut(floor.select("bird", F.col("floor").alias("syntax_floor")))


def analyse(table: DataFrame, recordings: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> Analysis:
    """From the canonical table and the recordings (audio_path, content) to drift against noise floors."""
    points, _ = points_of(table, recordings, config)
    return analyse_points(points, config, table)


def per_bird_drift(analysis: Analysis, standardised: bool = True) -> DataFrame:
    """bird, drift (the largest of its day pairs) and median_drift; individuals without pairs have nulls."""
    value = "centroid_drift_standardised" if standardised else "centroid_drift"
    found = analysis.pairs.groupBy("bird").agg(F.max(value).alias("drift"), F.median(value).alias("median_drift"))
    return analysis.birds.select("bird").join(found, "bird", "left")


def by_separation(pairs: DataFrame) -> DataFrame:
    """Means over the day pairs of equal distance, and how many types exceed their floors."""
    return pairs.groupBy("separation_days").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("centroid_drift_standardised").alias("centroid"), F.avg("dispersion_drift_abs").alias("dispersion"),
        F.avg("syntax_divergence").alias("syntax"), F.sum("n_types").alias("n_types"),
        F.sum("n_types_exceeding_centroid_floor").alias("over_centroid"), F.sum("n_types_exceeding_dispersion_floor").alias("over_dispersion"),
    )


def day_matrix(pairs: DataFrame, value: str = "centroid_drift_standardised") -> DataFrame:
    """One row per earlier day, one column per later day."""
    return pairs.groupBy("day_a").pivot("day_b").agg(F.avg(value))
