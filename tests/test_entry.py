"""The registered queries against their SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from quern.plans import catalogue

DATA = os.environ.get("QUERN_SMOKE_DIR", "/root/testdata/sf0.001")
TABLES = ("embeddings", "lineitem", "nation")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def rows(frame, columns):
    plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
    return Counter(repr(tuple(map(plain, r))) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got, want = catalogue.queries()[name](spark, DATA).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
