"""Every query against its SQL, over whole tables of the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
#: The corpus operators have tests of their own beside them; they can be absent.
OWN = sorted(n for n in QUERIES if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def normal(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False, name=None))


def compare(spark, duck, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, duck, name):
    compare(spark, duck, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)
