"""Every registered query against its DuckDB oracle, value by value."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from riskmart.oracle import ORACLES
from riskmart.queries import QUERIES

ROOT = "/root/testdata"
SCALE = os.environ.get("ORACLE_SF", "0.01")
TABLES = ["region", "nation", "customer", "part", "events"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{ROOT}/sf{SCALE}/{table}.parquet'")
    return con


def as_rows(names, rows):
    """Rows with columns sorted by name, then sorted as a whole."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([names[i] for i in order] and [tuple(row[i] for i in order) for row in rows],
                  key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    frame = entry_point.queries()[name](spark, f"{ROOT}/sf{SCALE}")
    found = as_rows(frame.columns, [tuple(row) for row in frame.collect()])
    result = duck.execute(entry_point.oracle_sql()[name])
    names = [column[0] for column in result.description]
    expected = as_rows(names, result.fetchall())
    assert sorted(frame.columns) == sorted(names)
    assert found
    assert len(found) == len(expected)
    assert found == expected


def test_entry(spark):
    frame = entry_point.entry(spark)
    assert frame.count() > 0
    assert "total_risk_score" in frame.columns
