"""Every query with an SQL twin gives the same rows on DuckDB; the others give rows."""

import glob
import os

import duckdb
import pytest

from demandara.queries import QUERIES
from tools.check_oracle import rows

# Fits of ensembles of a hundred trees take minutes; tests of the models use small ones.
SLOW = {"m06_random_forest", "m07_gradient_boosting", "m08_boosted_regularised",
        "m06_forest_test_metrics", "m16_forest_importance", "e15_auto_select"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("key", [k for k, q in QUERIES.items() if q.sql])
def test_same_as_sql(spark, sf, duck, key):
    df = QUERIES[key].run(spark, sf)
    got = rows(df.columns, df.collect())
    cur = duck.execute(QUERIES[key].sql)
    assert got == rows([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("key", [k for k, q in QUERIES.items() if not q.sql and k not in SLOW])
def test_gives_rows(spark, sf, key):
    df = QUERIES[key].run(spark, sf)
    df.collect()
    assert df.columns


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
