"""Every query with SQL gives the rows of that SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from fleetlens.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, str | bool) or hasattr(v, "isoformat"):
        return str(v)
    return float(f"{float(v):.9g}")


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_says_the_same(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0
