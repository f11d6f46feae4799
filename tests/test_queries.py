"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import pytest

from quillspark.plans import catalog as registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    want = duck.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=str)
    b = sorted((tuple(plain(dict(zip(want.columns, r, strict=True))[c]) for c in order) for r in want.fetchall()), key=str)
    assert a == b
