"""Every registered query of the library with its SQL oracle."""

from __future__ import annotations

from driftloom.plans import (
    composite_queries,
    drift_queries,
    file_queries,
    metric_queries,
    resampling_queries,
    stream_queries,
    study_queries,
    syllable_queries,
    vector_queries,
)

MODULES = (
    drift_queries, resampling_queries, metric_queries, study_queries, vector_queries, composite_queries, file_queries, syllable_queries,
    stream_queries,
)
QUERIES: dict = {}
ORACLES: dict = {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
