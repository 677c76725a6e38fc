"""Registered queries against their SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from hypergraph_spark import oracle, queries

DIR = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(values):
    return sorted(repr(tuple(0.0 if isinstance(x, float) and x == 0 else round(x, 6) if isinstance(x, float) else x for x in v)) for v in values)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = queries.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    q = db.execute(oracle.ORACLE_SQL[name])
    at = [x[0] for x in q.description]
    assert sorted(at) == cols
    assert rows([r[c] for c in cols] for r in df.collect()) == rows([r[at.index(c)] for c in cols] for r in q.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert queries.QUERIES[name](spark, DIR).count() > 0


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables")
def test_pq_search_finds_nine_tenths_of_the_nearest(spark):
    """Recall at 10 of all rows whose id is divisible by 50, against brute force."""
    nearest = {(r["source"], r["target"]) for r in queries.ann_brute(spark, LARGER).collect()}
    found = {(r["source"], r["target"]) for r in queries.pq_search(spark, LARGER).collect()}
    assert len(found) == len(nearest) and len(found & nearest) >= 0.9 * len(nearest)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(oracle.ORACLE_SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
