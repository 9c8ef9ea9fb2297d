"""Every registered query of the engine's own operators against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from lodestone.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = [f[:-8] for f in sorted(os.listdir(SF))] if os.path.isdir(SF) else []


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="module")
def base():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not TABLES, reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, base, name):
    got = QUERIES[name](spark, SF)
    rows = base.execute(ORACLE[name])
    columns = [d[0] for d in rows.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
    want = sorted((tuple(plain(v) for v in r) for r in rows.fetchall()), key=key)
    have = sorted((tuple(plain(v) for v in r) for r in got.select(*columns).collect()), key=key)
    assert have == want
