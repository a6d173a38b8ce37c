"""Every query that has SQL, against DuckDB on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from labelflow.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    return "~" if v is None or v != v else f"{float(v):.6f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    want = duck.sql(ORACLES[name])
    assert set(df.columns) == set(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert sorted([text(v) for v in r] for r in rows) == sorted([text(r[i]) for i in order] for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
