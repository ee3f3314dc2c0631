"""Every registered query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from dispensa.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for n in TABLES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{SF}/{n}.parquet')")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else v


def rows(df):
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
