"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from the whole text: lengths, character classes, entropy, repetition of words,
neighbours and lines, and how far the text compresses. Trees are grown level by level on binned
statistics (a histogram of gradients per node, statistic and bin), and flattened into arrays that
numpy walks for all rows of a batch at once. The model is fitted on at most ``SAMPLE`` labelled
documents, which are taken by a hash of their id, so that the fit takes the driver the same few
seconds at any size; the statistics and scores cover every row.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import boxed, table

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS = 80, 4, 0.15, 64
LEAST_WEIGHT, RIDGE = 2.0, 1.0
KEEP = 0.7
HELD_OUT = 2

STATISTICS = (
    "chars", "words", "word_length", "word_length_sd", "short_words", "long_words", "distinct_words", "top_word",
    "repeated_next", "lines", "line_length", "distinct_lines", "full_stops", "commas", "sentence_words", "upper",
    "digits", "symbols", "exclamations", "bars", "beyond_ascii", "white", "entropy", "compressed", "ends_well",
)
_SYMBOLS = [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'-"]


def statistics(text: str) -> list[float]:
    """The values of STATISTICS for one text."""
    data = text.encode()
    n = len(data)
    if not n:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    k = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    tally = Counter(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    share = count[count > 0] / n
    stops = int(count[46] + count[33] + count[63])
    return [
        np.log1p(n), np.log1p(len(words)), sizes.mean(), sizes.std(), (sizes <= 3).sum() / k, (sizes > 12).sum() / k,
        len(tally) / k, (max(tally.values()) if tally else 0) / k, same / k, np.log1p(len(lines)), n / m,
        len(set(lines)) / m, int(count[46]) / k, int(count[44]) / k, len(words) / max(1, stops),
        count[65:91].sum() / n, count[48:58].sum() / n, count[_SYMBOLS].sum() / n, int(count[33]) / k,
        int(count[124]) / k, count[128:].sum() / n, (count[32] + count[9:14].sum()) / n,
        float(-(share * np.log2(share)).sum()), len(zlib.compress(data, 1)) / n,
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / m,
    ]


@dataclass(frozen=True)
class Model:
    """Boosted trees of equal depth as arrays: inner nodes by level, then leaves."""

    base: float
    statistic: np.ndarray
    above: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for statistic, above, leaf in zip(self.statistic, self.above, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, statistic[node]] > above[node])
            total += leaf[node - (leaf.size - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Model:
    """Trees on the logistic loss. With labels of one kind only, or without any, the score is constant; without any it is 1."""
    inner, n_stats = 2**depth - 1, x.shape[1]
    if len(set(y.tolist())) < 2:
        base = 30.0 if not len(y) or y[0] == 1 else -30.0
        return Model(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(n_stats)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    slot = binned + np.arange(n_stats) * BINS
    base = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), base)
    all_stats, all_above, all_leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        stats, above = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            flat = ((node - first)[:, None] * (n_stats * BINS) + slot).ravel()
            shape = (width, n_stats, BINS)
            hist_g, hist_h = (
                np.bincount(flat, np.repeat(v, n_stats), minlength=width * n_stats * BINS).reshape(shape).cumsum(axis=2)
                for v in (g, h)
            )
            all_g, all_h = hist_g[:, :1, -1:], hist_h[:, :1, -1:]
            gain = hist_g**2 / (hist_h + RIDGE) + (all_g - hist_g) ** 2 / (all_h - hist_h + RIDGE)
            gain = gain - all_g**2 / (all_h + RIDGE)
            gain[(hist_h < LEAST_WEIGHT) | (all_h - hist_h < LEAST_WEIGHT)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for i, at in enumerate(best):
                f, b = divmod(int(at), BINS)
                if gain[i, f, b] > 1e-9 and b < len(edges[f]):
                    stats[first + i], above[first + i] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), stats[node]] > above[node])
        sums = [np.bincount(node - inner, v, minlength=inner + 1) for v in (g, h)]
        leaf = rate * sums[0] / (sums[1] + RIDGE)
        total += leaf[node - inner]
        all_stats.append(stats)
        all_above.append(above)
        all_leaf.append(leaf)
    return Model(base, np.array(all_stats), np.array(all_above), np.array(all_leaf))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the labels of a row are kept from the model: crc32 of the id as text, mod 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the labelled documents that are not held out, ``sample`` of them at most."""
    known = labels.where(~held_out()).where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality")
    known = known.orderBy(F.xxhash64("doc_id"), "quality").limit(sample)
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # ``sample`` rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("quality"), pa.array(rows, pa.list_(pa.float64()))], ["h", "quality", "x"]
            )

    rows = chosen.select(F.xxhash64("doc_id", "text").alias("h"), F.col("quality").cast("int").alias("quality"), "text")
    rows = rows.mapInArrow(run, "h long, quality int, x array<double>").orderBy("h", "quality").limit(sample).collect()
    x = np.array([r["x"] for r in rows], np.float64).reshape(-1, len(STATISTICS))
    return fit(x, np.array([r["quality"] for r in rows], np.float64))


def score_of(model: Model) -> Callable[[Column], Column]:
    """The scores of a text column; a null text is scored as an empty one."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t or "") for t in texts], np.float64).reshape(-1, len(STATISTICS))
        return pd.Series(model.scores(x))

    return score


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``keep`` or more; see ``quality_scores``."""
    score = score_of(fitted(docs, labels, sample))
    return boxed(docs, score(F.col("text")).alias("_score")).where(F.col("_score") >= keep).select("_row.*")


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Labels of held-out rows, of null ids and other than 0 and 1 are not learnt from; an id that is
    labelled twice counts twice; without labels every score is near 1. Null texts are empty, and
    empty texts are scored like any other, and so are texts of any length; repeated rows get equal scores; a null doc_id is not held
    out; an empty table gives an empty result; only doc_id and text are read.
    """
    score = score_of(fitted(docs, labels, sample))
    rows = docs.select("doc_id", held_out().alias("held_out"), score(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= keep).cast("int"))


def op6_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the whole ``documents`` table, learnt from ``labels``."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
