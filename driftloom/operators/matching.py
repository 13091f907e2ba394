"""Agreement of segments, boundaries and labels with a truth."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftloom.functions.lineage import cut


def scores(n_true: Column, n_pred: Column, n_matched: Column) -> dict[str, Column]:
    """precision, recall and f1; with nothing to find and nothing found all are 1."""
    nothing = (n_true == 0) & (n_pred == 0)
    precision = F.when(n_pred > 0, n_matched / n_pred).otherwise(0.0)
    recall = F.when(n_true > 0, n_matched / n_true).otherwise(0.0)
    both = precision + recall
    f1 = F.when(both > 0, 2 * precision * recall / both).otherwise(0.0)
    return {k: F.when(nothing, 1.0).otherwise(v) for k, v in (("precision", precision), ("recall", recall), ("f1", f1))}


def _greedy(true: np.ndarray, pred: np.ndarray, tolerance: float) -> int:
    """One-to-one matches of two sorted arrays of boundaries (rows of one or two numbers).

    Predictions whose first boundary lies too early are passed over for good. The next one is the
    only candidate of a truth; if it fails, it stays for the truths that follow.
    """
    true, pred = true.tolist(), pred.tolist()  # plain numbers: an array's call for each truth costs more than the comparison
    at, matched, end = 0, 0, len(pred)
    for t in true:
        least = t[0] - tolerance
        while at < end and pred[at][0] < least:
            at += 1
        if at == end:
            break
        if all(abs(p - x) <= tolerance for p, x in zip(pred[at], t)):
            matched, at = matched + 1, at + 1
    return matched


def _swept(rows: pd.DataFrame, file: Sequence[str], columns: Sequence[str], tolerance: float) -> pd.DataFrame:
    """``file``, n_true, n_pred, n_matched of every stretch of a file among ``rows``."""
    code = rows.groupby(list(file), sort=False, dropna=False).ngroup().to_numpy()
    values = rows[list(columns)].to_numpy()
    order = np.lexsort((*values.T[::-1], code))
    code, values, is_true = code[order], values[order], rows["_true"].to_numpy()[order]
    begins = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    found = rows[list(file)].iloc[order[begins]].reset_index(drop=True)
    many = []
    for begin, end in zip(begins, np.r_[begins[1:], len(code)]):
        part, side = values[begin:end], is_true[begin:end]
        true, pred = part[side], part[~side]
        many.append((len(true), len(pred), _greedy(true, pred, tolerance)))
    return pd.concat([found, pd.DataFrame(many, columns=["n_true", "n_pred", "n_matched"])], axis=1)


#: Segments of a file that one group of the sweep has, about, as long as there are gaps.
MANY = 5000
#: Segments, of many files where they are short, that one call of the sweep has, about.
TOGETHER = 50_000


def islands(rows: DataFrame, by: Sequence[str], start: str, tolerance: float, many: int = MANY) -> DataFrame:
    """``rows`` with ``_island``: a number that is the same within each stretch of a file and never changes between starts that may match.

    A file of over ``many`` rows is cut into stretches of equal length, some ``many`` rows each, so that it
    is many tasks. Where the last start of a
    stretch and the first of the next one are within the tolerance of each other, what hangs together
    across the edge belongs to the earlier one. Only stretches are looked at one after the other.
    """
    # a little more than the tolerance, so that rounding never parts what matches
    wide = F.lit(tolerance * (1 + 1e-9) + 1e-9)
    size = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / many).alias("_cells"), F.min(start).alias("_begin"), F.max(start).alias("_end"))
    rows = rows.join(cut(size), list(by))
    place = F.floor((F.col(start) - F.col("_begin")) / (F.col("_end") - F.col("_begin")) * F.col("_cells"))
    cell = F.when((F.col("_cells") == 1) | (F.col("_begin") == F.col("_end")), 0).otherwise(F.least(place, F.col("_cells") - 1))
    rows = rows.withColumn("_cell", F.coalesce(cell, F.lit(-1)).cast("long")).drop("_cells", "_begin", "_end")
    cell = [*by, "_cell"]
    before = F.lag(start).over(W.partitionBy(*cell).orderBy(start))
    gap = F.coalesce((F.col(start) - before > wide).cast("int"), F.lit(0))
    rows = rows.withColumn("_gap", gap)
    rows = rows.withColumn("_part", F.sum("_gap").over(W.partitionBy(*cell).orderBy(start).rowsBetween(W.unboundedPreceding, 0)))
    cells = rows.groupBy(*cell).agg(F.max("_part").alias("_parts"), F.min(start).alias("_first"), F.max(start).alias("_last"))
    order = W.partitionBy(*by).orderBy("_cell")
    joined = F.coalesce(F.col("_first") - F.lag("_last").over(order) <= wide, F.lit(False))
    cells = cells.withColumn("_joined", joined)
    # the last earlier stretch in which an island begins that may reach up to here
    begins = F.when(~F.col("_joined") | (F.col("_parts") > 0), F.col("_cell"))
    cells = cells.withColumn("_from", F.when(F.col("_joined"), F.last(begins, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))).otherwise(F.col("_cell")))
    found = rows.join(cells.select(*cell, "_from"), cell)
    return found.withColumn("_island", F.when(F.col("_part") == 0, F.col("_from")).otherwise(F.col("_cell"))).drop("_cell", "_gap", "_part", "_from")


def _counts(true: DataFrame, pred: DataFrame, by: Sequence[str], tolerance: float, boundary: str | None, many: int = MANY) -> DataFrame:
    """by, n_true, n_pred, n_matched per file: both boundaries, or one of them, within the tolerance.

    The sweep is stateful, but nothing that it has passed matters beyond a gap of more than the
    tolerance: a file's segments are handed to it in stretches that end at such gaps, in the order of
    their onsets, and of equal ones by their offsets. A call has the stretches of many short files.
    """
    columns = ["onset_s", "offset_s"] if boundary is None else [boundary]
    names = ["n_true", "n_pred", "n_matched"]
    file = [*by, "_island"]

    def sweep(rows: pd.DataFrame) -> pd.DataFrame:
        return _swept(rows, file, columns, tolerance)[[*by, *names]]

    kinds = dict(true.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + [f"{n} long" for n in names])
    both = [df.select(*[F.col(c).alias(c) for c in (*by, *columns)], F.lit(t).alias("_true")) for df, t in ((true, True), (pred, False))]
    both = cut(both[0].unionByName(both[1]))
    calls = max(1, -(-both.count() // TOGETHER))
    parts = islands(both, by, columns[0], tolerance, many).withColumn("_call", F.pmod(F.xxhash64(*file), F.lit(calls)))
    return parts.groupBy("_call").applyInPandas(sweep, schema).groupBy(*by).agg(*[F.sum(c).alias(c) for c in names])


def pooled(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts summed first, then scored."""
    sums = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n_true", "n_pred", "n_matched")])
    return sums.withColumns(scores(F.col("n_true"), F.col("n_pred"), F.col("n_matched")))


def segment_counts(true: DataFrame, pred: DataFrame, by: Sequence[str], tolerance: float = 0.01, many: int = MANY) -> DataFrame:
    return _counts(true, pred, by, tolerance, None, many)


def boundary_counts(true: DataFrame, pred: DataFrame, by: Sequence[str], boundary: str, tolerance: float = 0.01, many: int = MANY) -> DataFrame:
    return _counts(true, pred, by, tolerance, boundary, many)


def zipped(true: DataFrame, pred: DataFrame, by: Sequence[str], order: str, label: str) -> DataFrame:
    """by, place, true_label, predicted_label: two sequences side by side in their ``order``, as far as the shorter goes."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(order))
    sides = [df.select(*by, place.alias("place"), F.col(label).alias(name)) for df, name in ((true, "true_label"), (pred, "predicted_label"))]
    return sides[0].join(sides[1], [*by, "place"])


def label_accuracy(pairs: DataFrame, true: str, predicted: str) -> DataFrame:
    """One row, accuracy: the share of equal labels; 1 without any."""
    return pairs.agg(F.coalesce(F.avg((F.col(true) == F.col(predicted)).cast("double")), F.lit(1.0)).alias("accuracy"))


def confusion(pairs: DataFrame, true: str, predicted: str) -> DataFrame:
    return pairs.groupBy(F.col(true).alias("true_label"), F.col(predicted).alias("predicted_label")).agg(F.count(F.lit(1)).alias("n"))


def majority_share(labels: DataFrame, label: str) -> DataFrame:
    counts = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg((F.max("n") / F.sum("n")).alias("majority_share"))
