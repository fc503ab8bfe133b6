"""Every query of the engine that SQL states gives the same rows in DuckDB."""

import math
import os

import duckdb
import pytest

from corpuscle.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    cursor = duck.execute(registry.oracle_sql()[name])
    have = [d[0] for d in cursor.description]
    assert sorted(have) == names
    want = sorted((tuple(plain(r[have.index(c)]) for c in names) for r in cursor.fetchall()), key=repr)
    assert got == want
