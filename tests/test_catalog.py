"""Every query of the catalog against DuckDB on the smallest tables, types included."""

import os

import duckdb
import pytest

from corvane.plans import catalog

DIR = os.environ.get("CORVANE_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def _plain(rows):
    return sorted((tuple("" if v is None or v != v else str(v) for v in r) for r in rows))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in catalog.oracle_sql():
        assert got
        return
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    types = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: KINDS[t] for c, t in df.dtypes} == types
    places = [want.columns.index(c) for c in columns]
    assert _plain(got) == _plain(tuple(r[i] for i in places) for r in want.fetchall())


def test_sql_and_queries_have_the_same_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
