"""Every query of the slate against its SQL, at the smallest scale."""

import math

import duckdb
import pytest

from cairnframe.plans import slate

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "asDict") or isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(slate.queries()))
def test_query(spark, sf, duck, name):
    df = slate.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = [tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    if name not in slate.oracle_sql():
        assert rows
        return
    found = duck.sql(slate.oracle_sql()[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in at) for r in found.fetchall()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_entry_points():
    import __spark_entry__ as e

    assert set(slate.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark, sf):
    df = slate.flagship(spark, sf)
    assert df.count() == 1500 and "o_orderpriority" in df.columns
