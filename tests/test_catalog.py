"""Every registered query with SQL gives the rows DuckDB gives on the smallest data set."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from duelframe.catalog import ORACLES
from duelframe.catalog.checks import TABLES, compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    result, _ = compare(spark, con, SF_DIR, name)
    assert result.startswith("ok") and "types" not in result, result


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
