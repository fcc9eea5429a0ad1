"""Each query of the audit against its SQL in DuckDB, on the smallest data."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from lumenaudit.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple("null" if r[k] is None else repr(r[k]) if isinstance(r[k], float) else str(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, str(DATA))
    found = got.collect()
    if name in registry.ORACLES:
        want = duck.execute(registry.ORACLES[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert rows(got.columns, found) == rows(columns, want.fetchall())
    else:
        assert found


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
