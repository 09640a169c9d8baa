"""Every registered query of the library against its SQL on DuckDB."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from sparkloom import registry

DATA = os.environ.get("LOOM_TEST_DATA", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, int) and not isinstance(v, bool):
        return float(f"{v:.15g}")
    if v.__class__.__name__ == "Decimal":
        return float(v)
    return list(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{DATA}/{t}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    sql = registry.oracles().get(name)
    if sql is None:
        assert got
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == columns
    places = [rel.columns.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in places]) for r in rel.fetchall())
