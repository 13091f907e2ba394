"""Every query of the library runs, and equals its SQL where it has one."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as entry
from driftloom.plans import catalogue

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def shown(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, float):
        return f"{x:.5f}"
    return x.isoformat() if isinstance(x, dt.date) else str(x)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sql, name):
    found = catalogue.QUERIES[name](spark, SF)
    rows = sorted(tuple(map(shown, r)) for r in found.collect())
    if name not in catalogue.ORACLES:
        return
    result = sql.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    at = [columns.index(c) for c in found.columns]
    want = sorted(tuple(shown(r[i]) for i in at) for r in result.fetchall())
    assert len(rows) == len(want)
    for a, b in zip(rows, want):
        for x, y in zip(a, b):
            assert x == y or abs(float(x) - float(y)) < 1e-4


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["label_a", "label_b", "drift"]
    assert found.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
