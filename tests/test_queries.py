"""Every registered query of the engine against its SQL on the small tables."""

import math

import duckdb
import pytest

from proofline.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    try:
        x = float(v)
    except (TypeError, ValueError):
        return str(v)
    return None if math.isnan(x) else float(f"{x:.6g}") + 0.0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, sf, name):
    assert QUERIES[name](spark, sf).columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
