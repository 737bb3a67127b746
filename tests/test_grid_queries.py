"""Every query that has SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from latticework.plans import queries as grids

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        return None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else v

    found = [tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)]
    return sorted(found, key=lambda r: [(x is not None, x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(grids.SQL))
def test_same_as_sql(spark, duck, name):
    got = grids.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(grids.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(grids.QUERIES) - set(grids.SQL)))
def test_without_sql_has_rows(spark, name):
    assert grids.QUERIES[name](spark, DATA).count() > 0
