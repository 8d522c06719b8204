"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import rows_of
from wattshift.plans.oracle import ORACLE
from wattshift.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
SLOW = ("stream_", "e2e_", "src_", "late_")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 4


@pytest.mark.parametrize("key", [k for k in QUERIES if not k.startswith(SLOW)])
def test_query_equals_sql(spark, con, key):
    df = QUERIES[key](spark, SF)
    mine = rows_of(df.columns, df.collect())
    cursor = con.execute(ORACLE[key])
    assert mine == rows_of([d[0] for d in cursor.description], cursor.fetchall())
