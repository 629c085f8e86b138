"""Every registered query of the engine that SQL can express, against DuckDB at the smallest scale."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from quarry.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")


def plain(v):
    """Equal values of both engines compare equal: floats by nine digits, whole ones as integers."""
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, float) or hasattr(v, "quantize"):
        v = float(v)
        return None if math.isnan(v) else int(v) if math.isfinite(v) and v == int(v) and abs(v) < 1e15 else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_equals_its_sql(spark, con, name):
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    rows = lambda found: sorted((tuple(map(plain, r)) for r in found), key=repr)
    assert rows(got.select(*[f"`{c}`" for c in columns]).collect()) == rows(want.fetchall())
    spark.catalog.clearCache()
