"""Structure section, previews and the error log."""

import math

from pyspark.sql import functions as F

from pagemill.operators import export, graph
from pagemill.operators.errors import ErrorLog, lines
from tests.test_audit import URL, fetches, page


def crawled(spark, n):
    from pagemill.plans.audit import audit

    a = audit(fetches(spark, [(i, f"{URL}{i}", page(f"Title of page {i}"), 200, None, {}) for i in range(n)]))
    i = F.col("id")
    spider = F.struct((i % 3).cast("int").alias("depth"), (i % 2 == 0).alias("is_orphan"), (i % 4 == 1).alias("is_dead_end"), (i * 2).cast("int").alias("inbound_internal"), i.cast("int").alias("outbound_internal"))
    return a.withColumn("spider", spider)


def test_structure_section(spark, monkeypatch):
    monkeypatch.setattr(export, "REPORT_ROWS", 5)
    monkeypatch.setattr(export, "LIST_ROWS", 2)
    a = crawled(spark, 8)
    assert [(r.depth, r.url) for r in export.structure_rows(a).orderBy("position").collect()] == [(d, f"{URL}{i}") for d, i in [(0, 0), (0, 3), (0, 6), (1, 1), (1, 4)]]
    assert export.structure_lists(a) == {"Orphan pages": (4, [f"{URL}0", f"{URL}2"]), "Dead ends": (2, [f"{URL}1", f"{URL}5"])}
    text = export.build_report(a)
    assert "Orphan pages (4)" in text and "Dead ends (2)" in text and "in:12 out:6" in text and "Showing first 5 of 8 URLs." in text
    assert "Site Structure" not in export.build_report(a.drop("spider"))


def test_preview_shares_rings_out(spark):
    rows = [(0, "r", 0, "page"), *[(i, f"a{i}", 1, "page") for i in range(1, 5)], *[(i, f"b{i}", 2, "page") for i in range(5, 8)], (8, "deep", 3, "page"), (9, "x", -1, "external")]
    nodes = spark.createDataFrame(rows, "id long, url string, depth int, type string")
    got = {r.url: (r.x, r.y) for r in graph.preview(nodes).collect()}
    assert set(got) == {"r", "a1", "a2", "a3", "a4", "b5", "b6", "b7"} and got["r"] == (150, 100)
    for k, u in enumerate(["a1", "a2", "a3", "a4"]):
        assert math.dist(got[u], (150 + 55 * math.cos(math.pi * k / 2), 100 + 55 * math.sin(math.pi * k / 2))) < 1e-9
    assert set(graph.preview(nodes, k=3).select("url").toPandas().url) == {"r", "a1", "a2"}
    edges = spark.createDataFrame([("r", "a1", "internal"), ("a1", "deep", "internal")], "source string, target string, type string")
    assert [(r.source, r.x1, r.x2) for r in graph.preview_edges(graph.preview(nodes), edges).collect()] == [("r", 150.0, 205.0)]


def test_error_log(spark, tmp_path):
    log = ErrorLog(spark, str(tmp_path))
    assert log.rows().count() == 0
    assert log.save(str(tmp_path / "ok"), lambda p: spark.range(3).write.parquet(p)) == {"saved": True, "path": str(tmp_path / "ok")}
    again = log.save(str(tmp_path / "ok"), lambda p: spark.range(3).write.parquet(p))
    assert not again["saved"] and "exist" in again["error"].lower()
    log.add("spider", "Invalid start URL", 0.0625)
    assert sorted(r.kind for r in log.rows().collect()) == ["export", "spider"]
    assert [r.line for r in lines(log.rows().where("kind = 'spider'")).collect()][0].endswith("spider: Invalid start URL")
    broken = ErrorLog(spark, "nowhere:///x")
    broken.add("a", "b")  # never raises
    assert broken.rows().count() == 0
