"""The operators' queries against their SQL, over whole tables of the smallest scale."""

import os

import duckdb
import pytest

from plumbline.llm import queries

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def normal(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DIR).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)
