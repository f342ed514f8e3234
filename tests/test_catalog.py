"""Every catalogued query against its SQL on the small tables."""

import math
import os

import pytest

from pagemill.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def canonical(rows):
    return sorted(tuple("null" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("pages", "documents", "events"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    rows = [tuple(r[c] for c in sorted(got.columns)) for r in got.collect()]
    assert rows or name in catalog.ORACLE  # a search may find nothing here
    if name in catalog.ORACLE:
        want = duck.sql(f"select {', '.join(sorted(got.columns))} from ({catalog.ORACLE[name]}) q").fetchall()
        assert canonical(rows) == canonical(want)
