"""Every registered query runs on the smallest tables; those with SQL match it row by row."""

from collections import Counter

import duckdb
import pytest

from corpuloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    v = float(v)
    return "nan" if v != v else float(f"{v:.9g}")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    want = duck.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    places = [list(want.columns).index(c) for c in columns]
    left = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    right = Counter(tuple(plain(r[i]) for i in places) for r in want.fetchall())
    assert left == right and left


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
