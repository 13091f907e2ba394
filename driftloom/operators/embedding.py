"""Embeddings: principal components fitted once on a reference, and modes by k-means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.functions.scalars import squared_distance


#: Numbers of sums that a task holds before it passes them on.
HELD = 8_000_000


def fitted_pca(reference: DataFrame, components: int, column: str = "z") -> PCAModel:
    """Principal components of the reference rows only; their number is cut to the rows and features there are.

    Scores are not centred, which changes no difference and no variance.
    """
    rows = reference.select(array_to_vector(column).alias("_v"))
    n, width = reference.agg(F.count(F.lit(1)), F.max(F.size(column))).first()
    if not n:
        raise ValueError("no reference rows to fit on")
    return PCA(k=max(1, min(components, n, width)), inputCol="_v", outputCol="_p").fit(rows)


def projected(model: PCAModel, df: DataFrame, column: str = "z") -> DataFrame:
    """``df`` with the vector replaced by its scores."""
    found = model.transform(df.withColumn("_v", array_to_vector(column)))
    return found.withColumn(column, vector_to_array("_p")).drop("_v", "_p")


def explained_variance(model: PCAModel) -> float:
    return float(model.explainedVariance.toArray().sum())


def modes(endpoint: DataFrame, k: int, key: str, column: str = "z", sample: int = 60_000, seed: int = 0) -> list[list[float]]:
    """The centres of ``k`` modes, fitted on at most ``sample`` rows taken by hash."""
    rows = endpoint.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(sample).select(array_to_vector(column).alias("features"))
    return [c.tolist() for c in KMeans(k=k, seed=seed).fit(rows).clusterCenters()]


def assigned(df: DataFrame, centres: list[list[float]], column: str = "z") -> DataFrame:
    """``df`` with mode (the nearest centre, ties to the first) and distance."""
    choices = [F.struct(squared_distance(column, F.array(*map(F.lit, c))).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]
    best = F.array_min(F.array(*choices))
    return df.withColumn("_b", best).withColumns({"mode": F.col("_b.i"), "distance": F.sqrt("_b.d")}).drop("_b")


def embedded(features: DataFrame, by: list[str], side: str, components: int, column: str = "features") -> DataFrame:
    """``features`` with z: principal components of each individual, fitted on its first ``side`` only.

    A fit needs no more than an individual's sums of features and of their products, which are added
    up where its reference rows lie, batch by batch. The models, one row for each individual, are then
    joined with the rows, and rows are projected in batches: no task holds an individual.
    """
    kinds = dict(features.dtypes)
    keys = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    first = features.groupBy(*by).agg(F.min(side).alias("_first"))
    reference = features.join(first, by).where(F.col(side) == F.col("_first")).select(*by, column)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[int, np.ndarray]] = {}

        def passed() -> pd.DataFrame:
            found = [(*key, i, n, line) for key, (n, whole) in held.items() for i, line in enumerate(whole)]
            held.clear()
            return pd.DataFrame(found, columns=[*by, "_line", "_n", "_s"])

        for batch in batches:
            for key, rows in batch.groupby(by, sort=False, dropna=False):
                x = np.stack([np.asarray(v, np.float64) for v in rows[column]])
                n, whole = held.get(key, (0, 0.0))
                held[key] = n + len(x), whole + np.vstack([x.sum(axis=0), x.T @ x])
                if sum(w.size for _, w in held.values()) > HELD:
                    yield passed()
        yield passed()

    def added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.asarray(v) for v in rows["_s"]], axis=0)
        return pd.DataFrame([(*key, int(rows["_n"].sum()), total)], columns=[*by, "_line", "_n", "_s"])

    kind = f"{keys}, _line int, _n long, _s array<double>"
    lines = reference.mapInPandas(sums, kind).groupBy(*by, "_line").applyInPandas(added, kind)

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_line")
        n, moments = int(rows["_n"].iloc[0]), np.stack([np.asarray(v) for v in rows["_s"]])
        mean = moments[0] / n
        values, vectors = np.linalg.eigh(moments[1:] - n * np.outer(mean, mean))
        k = max(1, min(components, n, len(mean)))
        axes = vectors[:, np.argsort(-values, kind="stable")[:k]].T
        return pd.DataFrame([(*key, mean, axes.ravel())], columns=[*by, "_mean", "_axes"])

    models = lines.groupBy(*by).applyInPandas(fit, f"{keys}, _mean array<double>, _axes array<double>")
    rest = [c for c in features.columns if c != column]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", z array<double>"

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z: list = [None] * len(batch)
            for at in batch.groupby(by, sort=False, dropna=False).indices.values():
                mean = np.asarray(batch["_mean"].iloc[at[0]])
                axes = np.asarray(batch["_axes"].iloc[at[0]]).reshape(-1, len(mean))
                x = np.stack([np.asarray(v, np.float64) for v in batch[column].iloc[at]])
                for i, row in zip(at, (x - mean) @ axes.T):
                    z[i] = row
            yield batch[rest].assign(z=z)

    return features.join(models, by).mapInPandas(project, schema)
