"""Every query with SQL returns what DuckDB returns for that SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from lawloom.plans import oracles, queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_names():
    assert set(oracles.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, str(DATA))
    cursor = duck.execute(oracles.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    order = sorted(columns)
    assert sorted(got.columns) == order
    ours = sorted(repr(tuple(r[c] for c in order)) for r in got.collect())
    theirs = sorted(repr(tuple(dict(zip(columns, row, strict=True))[c] for c in order)) for row in cursor.fetchall())
    assert ours == theirs
