"""Every registered query with SQL against it on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from factweave.plans import registry
from tools.check import norm

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{ROOT}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150
    assert set(registry.oracles()) == set(registry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the shared tables")
@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_sql(spark, con, name):
    same_as_sql(spark, con, name)


def same_as_sql(spark, con, name):
    df = entry.queries()[name](spark, ROOT)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted(tuple(norm(v) for v in r) for r in cur.fetchall())
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert sorted(df.columns) == sorted(cols) and got == want
