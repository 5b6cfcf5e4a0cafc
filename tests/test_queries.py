"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from ledgerloom.plans import evidence, registers, statements

QUERIES, SQL = registers.queries() | statements.queries() | evidence.queries(), registers.oracle_sql() | statements.oracle_sql() | evidence.oracle_sql()
NAMES = sorted(SQL)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, int | float | decimal.Decimal):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf, duck, name):
    d = QUERIES[name](spark, sf)
    got = sorted((tuple(plain(r[c]) for c in sorted(d.columns)) for r in d.collect()), key=repr)
    r = duck.execute(SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(d.columns)
    want = sorted((tuple(plain(x[names.index(c)]) for c in sorted(names)) for x in r.fetchall()), key=repr)
    assert got == want


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
