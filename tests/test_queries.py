"""Every registered query of the engine runs, and agrees with its SQL where there is one."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from termloom import catalog

NAMES = sorted(catalog.queries())
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def norm(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, float):
            return f"{v + 0.0:.5g}"
        return str(v)

    return [columns[i] for i in at], sorted(tuple(cell(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, sf, name):
    df = catalog.queries()[name](spark, sf)
    got = norm([tuple(r) for r in df.collect()], df.columns)
    if name in catalog.oracle_sql():
        cur = duck.execute(catalog.oracle_sql()[name])
        assert got == norm(cur.fetchall(), [c[0] for c in cur.description])
    else:
        assert got[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
