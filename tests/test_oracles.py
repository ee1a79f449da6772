"""Every registered query of the intake engine against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from draftmill.plans import queries as catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def shown(v):
    return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(shown(v) for v in r) for r in df.select(*columns).collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(shown(r[i]) for i in at)) for r in want.fetchall())
