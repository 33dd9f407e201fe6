"""Registered queries against their SQL, on the tables that the driver compares."""

import math
import os

import duckdb
import pytest

from tessella import plans

SF = os.environ.get("PLANS_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def cell(v):
    v = v.tolist() if hasattr(v, "tolist") else v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str([cell(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def rows(df):
    names = sorted(df.columns)
    df = df.astype({c: "float64" for c in names if str(df[c].dtype) == "Int64"})  # whole numbers with nulls, as toPandas has them
    return names, sorted(tuple(map(cell, r)) for r in df[names].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_sql(spark, duck, name):
    assert rows(plans.queries()[name](spark, SF).toPandas()) == rows(duck.sql(plans.oracle_sql()[name]).df())
