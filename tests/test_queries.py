"""Every query that has an oracle gives the oracle's rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 8) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, name):
    got = entry.queries()[name](spark, DIR)
    want = duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in columns]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
