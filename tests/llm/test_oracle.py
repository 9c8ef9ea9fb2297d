"""Queries that have SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lodestone.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    base = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = base.execute(oracle_sql()[name])
    columns = [d[0] for d in rows.description]
    got = queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, rows.fetchall()))


def test_the_ten_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries() if n.startswith("op")} == set(range(1, 11))
