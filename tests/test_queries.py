"""Every registered query of the engine itself against its DuckDB text, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from memloom.plans import queries


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    return tuple(map(plain, v)) if hasattr(v, "__len__") and not isinstance(v, str) else round(float(v), 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_oracle(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf)
    want = duck.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted((repr(tuple(plain(r[c]) for c in columns)) for r in got.collect()))
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert a == sorted(repr(tuple(plain(r[c]) for c in columns)) for r in rows)


def test_every_query_has_its_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)
