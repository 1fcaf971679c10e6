"""Every catalogue query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from millrace.plans import stored as catalogue

DATA = "/root/testdata/sf0.001"
TOLERANT = {name: 6 for name in ("search_bm25",)}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(frame):
    out = []
    for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False):
        out.append(tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
