"""The core queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from simloom.plans import vector_queries

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(vector_queries.oracle_sql()))
def test_query(spark, db, name):
    got = vector_queries.queries()[name](spark, SF).toPandas()
    want = db.sql(vector_queries.oracle_sql()[name]).df()
    rows = lambda d: sorted(map(repr, (tuple(v.item() if hasattr(v, "item") else v for v in r) for r in d[sorted(d.columns)].itertuples(index=False, name=None))))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
