"""Every query with SQL gives what DuckDB gives; every other runs."""

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()
REST = [name for name in entry.queries() if name not in SQL and name != "pipeline" and not (name.startswith("op") and name[2].isdigit())]


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    ours = entry.queries()[name](spark, DATA)
    theirs = duck.sql(SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    at = [theirs.columns.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in theirs.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in ours.collect()), key=repr)
    assert got == expected


@pytest.mark.parametrize("name", REST)
def test_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
