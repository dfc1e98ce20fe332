"""Registered queries against their SQL on the smallest data, where it is there."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from skein.plans import corpus, graph

DATA = Path("/root/testdata/sf0.001")
NAMES = [*corpus.ORACLE, *graph.ORACLE]


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no data")
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for p in DATA.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(cols, rows):
    at = [cols.index(c) for c in sorted(cols)]
    return sorted((tuple(r[i] for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    df = entry.queries()[name](spark, str(DATA))
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert plain(df.columns, [tuple(r) for r in df.collect()]) == plain(rel.columns, rel.fetchall())


def test_entry(spark):
    if DATA.exists():
        assert entry.entry(spark).columns
