"""Every query over the smallest tables, against its SQL in another engine where it has one."""

import os

import pytest

from dispatchlake.plans import registry

from .comparing import duckdb_rows, spark_rows

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    columns, rows = spark_rows(registry.QUERIES[name](spark, DATA))
    want_columns, want = duckdb_rows(registry.ORACLE_SQL[name], DATA)
    assert columns == want_columns
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
