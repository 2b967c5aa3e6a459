from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
plans = {k for k in entry.queries() if not k.startswith("op") and k != "pipeline"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str(tuple(r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(plans))
def test_query_against_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    found = rows(got.columns, map(tuple, got.collect()))
    assert found
    if name in entry.oracle_sql():
        want = duck.sql(entry.oracle_sql()[name])
        assert sorted(got.columns) == sorted(want.columns) and found == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
