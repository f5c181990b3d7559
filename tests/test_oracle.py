"""Each query against its SQL on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

from lattica.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir)
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=str)
    b = sorted((tuple(map(plain, r)) for r in want.fetchall()), key=str)
    assert a == b
