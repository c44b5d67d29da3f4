"""Every registered mobility query against its SQL, on the smallest shared tables."""

import math
from pathlib import Path

import duckdb
import pytest

from citywright.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the shared test tables are not here")


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool | str):
        return str(value)
    return f"{float(value) + 0.0:.6g}"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, base, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    found = base.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(dict(zip(names, row, strict=True))[c]) for c in columns) for row in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
