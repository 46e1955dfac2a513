"""Every query with SQL gives the same rows in DuckDB."""

import pytest

import __spark_entry__ as entry
from packetloom.catalog import QUERIES, SQL
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert compare(spark, name, QUERIES[name], SQL[name], sf_dir) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert sum(r["count"] for r in rows) == 1000
    assert abs(sum(r["percent"] for r in rows) - 100) < 1e-9
    assert set(entry.oracle_sql()) <= set(entry.queries())
