"""Every query against its SQL on the smallest given tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from photolake.plans import registry
from photolake.plans.catalog import BASE, TABLES, Catalog, oracle

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in BASE:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def text(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return "null"
    if isinstance(v, (int, float, np.number)) and not isinstance(v, bool):
        return f"{v:.9g}"
    return str(v)[:10] if hasattr(v, "isoformat") else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    found = QUERIES[name](spark, FOLDER)
    if name not in SQL:
        found.collect()
        return
    want = con.sql(SQL[name]).df()
    got = found.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(TABLES) - {"vector"}))
def test_catalogue_is_the_same_in_both(spark, con, name):
    assert rows(getattr(Catalog(spark, FOLDER), name).toPandas()) == rows(con.sql(oracle(f"SELECT * FROM {name}")).df())
