"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from verification.compare import rows_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    before = spark.conf.getAll
    frame = entry.queries()[name](spark, FOLDER)
    got = [tuple(r) for r in frame.collect()]
    assert spark.conf.getAll == before, "a query leaves the session as it was"
    if name not in entry.oracle_sql():
        assert got
        return
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of(frame.columns, got) == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 12


def test_forest_rows_are_dealt_over_all_tasks(spark):
    """The other partitions of the invariants are as many as a shuffle has, so that no task reads a fixed share of the table."""
    frame = entry.queries()["isolation_forest_invariants"](spark, FOLDER)
    assert "REPARTITION_BY_NUM" not in frame._jdf.queryExecution().executedPlan().toString()
