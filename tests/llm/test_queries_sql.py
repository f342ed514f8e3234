"""Every query of the subpackage that has SQL, against it, on the two small scales."""

import os

import pytest

from pagemill.llm import queries
from tests.test_catalog import canonical

SCALES = [f"/root/testdata/{s}" for s in ("sf0.001", "sf0.01") if os.path.isdir(f"/root/testdata/{s}")]


@pytest.mark.parametrize("sf_dir", SCALES)
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    rows = [tuple(r[c] for c in sorted(got.columns)) for r in got.collect()]
    want = con.sql(f"select {', '.join(sorted(got.columns))} from ({queries.ORACLE_SQL[name]}) q").fetchall()
    assert rows and canonical(rows) == canonical(want)
