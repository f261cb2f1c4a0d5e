"""Every query with an SQL twin gives the same rows as DuckDB on the smallest tables."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
LLM = re.compile(r"op\d+_|pipeline$")
PLAIN = sorted(k for k in __spark_entry__.oracle_sql() if not LLM.match(k))
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", PLAIN)
def test_same_rows(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    got = [tuple(r) for r in df.select(sorted(df.columns)).collect()]
    cur = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=names.__getitem__)
    want = [tuple(r[i] for i in order) for r in cur.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_queries_without_a_twin_run(spark):
    found = __spark_entry__.queries()
    for name in sorted(set(found) - set(__spark_entry__.oracle_sql())):
        if not LLM.match(name):
            assert found[name](spark, DATA).count() > 0, name


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0
