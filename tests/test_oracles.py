"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from ledgerlens import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for path in sorted(Path(FOLDER).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """Numbers of both engines as one kind, to nine digits."""
    if value is None:
        return ""
    if isinstance(value, bool | str):
        return str(value)
    if isinstance(value, int | float) or hasattr(value, "as_tuple"):
        number = float(value)
        return "nan" if math.isnan(number) else f"{number + 0.0:.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, database, name):
    found = catalog.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    result = database.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    got = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    assert len(got) == len(want)
    assert got == want
