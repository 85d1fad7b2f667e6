"""Registered queries against their SQL. ATLAS_ALL_QUERIES=1 runs every one of them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FEW = ["coverage", "py_endpoints", "java_endpoints", "ts_endpoints", "spec_endpoints", "render_schema", "provenance", "changed_artifacts"]
NAMES = list(entry.oracle_sql()) if os.environ.get("ATLAS_ALL_QUERIES") else FEW


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def test_every_query_is_known():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    found = entry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    result = duck.execute(entry.oracle_sql()[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    expected = [tuple(row[order.index(c)] for c in columns) for row in result.fetchall()]
    text = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted([tuple(r[c] for c in columns) for r in found.collect()], key=text) == sorted(expected, key=text)
