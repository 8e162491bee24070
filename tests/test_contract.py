import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from sluice.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(rows):
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = oracle.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({ORACLE_SQL[name]})").fetchall()
    assert plain(df.select(columns).collect()) == plain(want)


def test_entry(spark):
    assert driver.entry(spark).count() == 5
    assert set(driver.oracle_sql()) <= set(driver.queries())
