"""Every query with SQL against DuckDB over the smallest tables."""

import importlib
import os

import duckdb
import pytest

from passagemill import source_queries  # noqa: F401  adds its queries
from passagemill.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(frame, columns):
    return sorted(tuple(repr(x) for x in r) for r in frame[columns].itertuples(index=False))


def compare(spark, duck, query, sql):
    want, got = duck.sql(sql).df(), query(spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert rows(want.astype(object), columns) == rows(got.astype(object), columns)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    compare(spark, duck, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(ORACLES) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
