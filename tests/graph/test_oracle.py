"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

from tessella.plans.oracle import ORACLE_SQL
from tessella.plans.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(repr(r[i]) for i in order) for r in data), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def test_all_have_both():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    got = rows(df.columns, df.collect())
    found = duck.execute(ORACLE_SQL[name])
    expected = rows([d[0] for d in found.description], found.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in found.description)
    assert got == expected, (len(got), len(expected), got[:3], expected[:3])
