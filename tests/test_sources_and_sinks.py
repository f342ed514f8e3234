import csv
import datetime
import gzip
import io
import json
import pathlib
import random
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from pagemill.operators import crawl, export, graph, ordering, sitemap_gen, tree
from pagemill.sources import robots, sitemap
from pagemill.sources.fetch_log import fetch_rows, redirect_summary, status_text
from pagemill.sources.html import with_dom
from pagemill.streaming import live
from tests.test_audit import RICH, URL, fetches, page

URLSET = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://a.com/1 </loc></url><url><loc></loc></url><url><loc>https://a.com/2?x=1&amp;y=2</loc></url></urlset>'


def index(*urls):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"


def test_sitemap_documents(spark, tmp_path):
    (tmp_path / "a.xml").write_text(URLSET)
    (tmp_path / "b.xml.gz").write_bytes(gzip.compress(index("https://a.com/s.xml").encode()))
    (tmp_path / "c.xml").write_bytes(gzip.compress(URLSET.encode()))
    (tmp_path / "d.xml").write_text("<?xml version='1.0'?><other/>")
    got = {r.name.rpartition("/")[2]: r for r in sitemap.parse_documents(sitemap.read_documents(spark, str(tmp_path))).collect()}
    assert got["a.xml"].urls == got["c.xml"].urls == ["https://a.com/1", "https://a.com/2?x=1&y=2"]
    assert got["b.xml.gz"].nested == ["https://a.com/s.xml"] and got["d.xml"].urls == []


def test_sitemap_tree(spark):
    docs = {"i": index("s1", "i2"), "i2": index("i", "s1", "s2"), "s1": URLSET, "s2": URLSET.replace("/1", "/3")}
    got = sitemap.resolve(spark, "i", docs.__getitem__)
    assert got == {"urls": ["https://a.com/1", "https://a.com/2?x=1&y=2", "https://a.com/3"], "sitemap_count": 4, "error": None}
    broken = sitemap.resolve(spark, "i", {k: v for k, v in docs.items() if k != "s2"}.__getitem__)
    assert broken["urls"] == [] and broken["sitemap_count"] == 0 and broken["error"]


def test_sitemap_file(spark, tmp_path):
    (tmp_path / "x.txt").write_text("plain")
    assert sitemap.read_file(spark, str(tmp_path / "x.txt"))["error"] == sitemap.INVALID


@pytest.mark.parametrize("agent, path, want", [("auditor", "/private/x", False), ("auditor", "/private/ok", True), ("auditor", "/a.pdf", False), ("auditor", "/a.pdf?x", True), ("BadBot/2.0", "/", False), ("auditor", "/", True), ("auditor", "/tie", True)])
def test_robots(spark, agent, path, want):
    text = "# c\nUser-agent: badbot\nDisallow: /\n\nUser-agent: *\nCrawl-delay: 1.5\nDisallow: /private\nAllow: /private/ok\nDisallow: /*.pdf$\nDisallow: /tie\nAllow: /tie\nDisallow:\nSitemap: https://a.com/s.xml\n"
    parsed = robots.parse_robots(text, agent)
    assert parsed["sitemaps"] == ["https://a.com/s.xml"] and parsed["crawl_delay_ms"] == (0 if agent == "BadBot/2.0" else 1500)
    assert robots.decide(spark.createDataFrame([(path,)], "path string"), parsed["rules"]).first().allowed is want


def test_fetch_rows(spark):
    schema = "id long, url string, status_code int, status_text string, error string, redirect_chain array<struct<url:string,status:int>>, ttfb_ms int, total_download_ms int, redirect_time_ms int, content_type string, http_version string, headers map<string,string>, html string"
    rows = [(1, "u", 200, "", None, [], 1, 2, 0, "Text/HTML; charset=x", "1.1", {"Content-Encoding": "gzip", "ETag": "e", "X-Other": "o"}, "<p>"), (2, "u", 200, None, None, [("a", 302), ("b", 200)], 1, 2, 0, "image/png", "1.1", {}, "bytes"), (3, "u", 200, None, "Timeout", [], 1, 2, 0, None, None, {}, None)]
    got = {r.id: r for r in fetch_rows(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].html == "<p>" and got[1].http.status_text == "OK" and got[1].http.headers == {"etag": "e"} and got[1].http.compressed and not got[2].http.compressed
    assert got[2].html is None and got[3].http.status_code is None and got[3].http.status_text == "Error"
    summary = fetch_rows(spark.createDataFrame(rows, schema)).where("id = 2").select(redirect_summary(F.col("http")).alias("r")).first().r
    assert (summary.status, summary.target) == (302, "b")
    assert spark.range(1).select(status_text(F.lit(418)).alias("v")).first().v == ""


# ---------------------------------------------------------------- crawl

def test_crawl_order_cap_and_gates(spark):
    links = [("s", 0, "b"), ("s", 1, "a"), ("b", 0, "c"), ("a", 0, "c"), ("a", 1, "d"), ("c", 0, "e"), ("s", 2, "s")]
    df = spark.createDataFrame([(f"https://x.com/{a}", i, f"https://x.com/{b}") for a, i, b in links], "source string, link_idx int, target string")
    full = crawl.crawl(df, "https://x.com/s", max_depth=2).orderBy("seq").collect()
    assert [(r.url[-1], r.depth, r.discovered_from[-1:]) for r in full] == [("s", 0, ""), ("b", 1, "s"), ("a", 1, "s"), ("c", 2, "b"), ("d", 2, "a")]
    assert [r.url[-1] for r in crawl.crawl(df, "https://x.com/s", max_pages=4).orderBy("seq").collect()] == list("sbac")
    gated = {r.url[-1]: r.crawled for r in crawl.crawl(df, "https://x.com/s", exclude=["/s", "/a"]).collect()}
    assert gated == {"s": True, "b": True, "a": False, "c": True, "e": True}
    forbidden = spark.createDataFrame([("https://x.com/b",)], "url string")
    got = {r.url[-1]: r.crawled for r in crawl.crawl(df, "https://x.com/s", rejected=forbidden, include=["/a", "/b", "/c"]).collect()}
    assert got == {"s": True, "b": False, "a": True, "c": True, "d": False, "e": False}
    assert crawl.crawl(df.limit(0), "https://x.com/s").count() == 1


# ---------------------------------------------------------------- graph and tree

def test_graph(spark, tmp_path):
    rows = [(0, "a", 0, 200, 90, "A", 0, ["b", "b2", "a", "gone"], ["x"], 4, "/"), (1, "b", 1, 301, 40, "B", 0, ["a"], ["x", "y"], 1, "/b"), (2, "b2", 1, None, 0, None, 0, [], [], 0, "/b"), (3, "lone", 2, 200, 70, "L", 1, ["a"], [], 1, "/l")]
    r = spark.createDataFrame(rows, "id long, url string, depth int, status int, health_score int, title string, chain_length int, internal_links array<string>, external_links array<string>, outbound_internal int, path_group string")
    e = graph.build_edges(r, True)
    assert sorted((x.source, x.target) for x in e.where("type = 'internal'").collect()) == [("a", "b"), ("a", "b2"), ("b", "a"), ("lone", "a")]
    n = {x.url: x for x in graph.build_nodes(r, e, True).collect()}
    assert (n["a"].in_degree, n["a"].out_degree, n["b"].type, n["b2"].type, n["lone"].type) == (2, 4, "redirect", "error", "redirect")
    assert n["lone"].is_orphan and not n["a"].is_orphan and n["b2"].is_dead_end and (n["x"].depth, n["x"].type, n["x"].in_degree) == (-1, "external", 0)
    m = graph.metadata(graph.build_nodes(r, e, True), e, "a").first()
    assert (m.total_nodes, m.total_edges, m.max_depth, m.avg_depth, m.external_count, m.most_linked_url, m.orphans, m.dead_ends) == (6, 7, 2, 1.0, 2, "a", 1, 1)
    assert sum(x.in_degree for x in n.values()) == 4
    assert {x.url: x.parents for x in graph.parents(e, r).collect()}["a"] == ["b", "lone"]
    nodes, edges = graph.view(graph.build_nodes(r, e, True), e, depth_max=1, health_min=50)
    assert {x.url for x in nodes.collect()} == {"a", "x", "y"} and {(x.source, x.target) for x in edges.collect()} == {("a", "x")}
    joined = lambda lines, name: "\n".join(f.read_text() for f in sorted(pathlib.Path(export.write_graph(lines, str(tmp_path / name))).glob("part-*")))
    whole = ElementTree.fromstring(joined(export.gexf_lines(graph.build_nodes(r, e), e.where("type = 'internal'"), 'a&"b"'), "gexf"))
    found = whole.findall(".//{http://gexf.net/1.3}edge")
    assert [x.get("id") for x in found] == ["0", "1", "2", "3"] and [(x.get("source"), x.get("target")) for x in found] == sorted((x.get("source"), x.get("target")) for x in found)
    nodes = graph.build_nodes(r, e, True)
    doc = json.loads(joined(export.graph_json_lines(nodes, e, graph.metadata(nodes, e, "a")), "json"))
    assert doc["metadata"]["total_nodes"] == 6 == len(doc["nodes"]) and len(doc["edges"]) == e.count()


def test_tree(spark):
    urls = ["https://x.com/", "https://x.com/a/b", "https://x.com/a/c?q=1", "https://x.com/a/c?q=2", "https://x.com/z", "https://other.com/a", "https://x.com/a/b/#frag"]
    r = spark.createDataFrame([(i, u, [200, 404, 301, 200, None, 200, 200][i], 50 + i, f"t{i}") for i, u in enumerate(urls)], "id long, url string, status int, health_score int, title string")
    t = tree.build_tree(r, "https://x.com/")
    n = {x.path: x for x in t.collect()}
    assert set(n) == {"/", "/a", "/a/b", "/a/c", "/z"} and not n["/a"].is_discovered and n["/a/b"].result_id == 6 and n["/a/c"].result_id == 2
    assert (n["/"].child_count, n["/"].ok, n["/"].warn, n["/"].err) == (4, 1, 1, 2) and n["/"].child_count == len(n) - 1 and n["/a"].parent_path == "/"
    assert [x.path for x in tree.ancestors(t, "https://x.com", "/a/b").collect()] == ["/", "/a", "/a/b"]
    assert [x.path for x in tree.sort_path(t).orderBy("order").collect()] == ["/", "/a", "/a/b", "/a/c", "/z"]
    assert {x.path for x in tree.search_tree(t, "T2").collect()} == {"/a/c"} and tree.search_tree(t, " ").count() == 0
    assert {x.path for x in tree.visible(t, tree.expanded_to(t, 1)).collect()} == {"/", "/a", "/z"}
    assert [r.line for r in tree.indented_lines(t).orderBy("origin", "left").collect()] == ["x.com [200] (Score: 50)", "├── /a (not crawled)", "│   ├── /b [200] (Score: 56)", "│   └── /c [301] (Score: 52)", "└── /z (Score: 54)"]
    below = {x.path: x.child_count for x in tree.build_tree(r, "https://x.com/a").collect()}
    assert below == {"/a": 2, "/a/b": 0, "/a/c": 0}


def test_tree_looks(spark):
    rows = [(True, 200, 90, 2, "a" * 30), (True, 404, 50, 1, "b"), (True, 200, 25, 0, "c"), (False, None, 0, 1, "d")]
    t = spark.createDataFrame(rows, "is_discovered boolean, status int, health_score int, depth int, label string")
    no = F.lit(False)
    got = t.select(tree.color().alias("h"), tree.color("status").alias("s"), tree.color("depth", 2).alias("d"), tree.border(no).alias("b"), tree.bar("depth", 2).alias("bar"), tree.short_label(no).alias("l"), tree.status_dot(F.col("status")).alias("dot")).collect()
    assert [r.h for r in got] == ["#1cb454", "#eab308", "#ed7c26", "#9ca3af"] and [r.s for r in got] == ["#22c55e", "#f97316", "#22c55e", "#9ca3af"]
    assert got[0].d == "#1e3a8a" and got[2].d == "#dbeafe" and got[1].b.color == "#ef4444" and got[3].b.dashed and got[2].b.color == "#f97316"
    assert got[0].l == "/" + "a" * 22 + "…" and got[1].l == "/b" and (got[1].bar.fraction, got[1].bar.label) == (0.5, "d1") and got[3].dot == "#9ca3af"


# ---------------------------------------------------------------- sitemaps out

def inputs(spark, n=7):
    rows = [(i, f"https://x.com/en/p{i}", [200, 200, 404, None, 301, 200, 200][i % 7], i % 2, True, i == 6, i % 5, i * 7, "Tue, 02 Jan 2024 03:04:05 GMT" if i == 0 else "bad", f"T<{i}>", [("en", "h&")], ["i1", "i2"]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, url string, status int, chain_length int, is_html boolean, is_external boolean, depth int, inbound int, last_modified string, title string, hreflang_links array<struct<lang:string,href:string>>, image_urls array<string>")


def test_sitemap_entries(spark):
    cfg = sitemap_gen.SitemapConfig(lastmod="header", lastmod_format="datetime", hreflang="manual-mapping", hreflang_mappings=(("en", "/en/"), ("de", "/de/")), x_default="de", images=True, max_images=1, news_patterns=("/en/p0",), publication="P&Q", priority_overrides=(("/en/p1", 7.0),))
    got = {r.id: r for r in sitemap_gen.entries(inputs(spark), cfg).collect()}
    assert set(got) == {0, 1, 5} and got[0].lastmod == "2024-01-02T03:04:05+00:00" and got[1].lastmod == "2024-01-01T00:00:00+00:00"
    assert (got[0].priority, got[1].priority, got[5].priority) == ("1.0", "1.0", "1.0") and (got[0].changefreq, got[1].changefreq) == ("daily", "weekly")
    for part in ('hreflang="de" href="https://x.com/de/p0"', 'hreflang="x-default" href="https://x.com/de/p0"', "<image:loc>i1<", "P&amp;Q", "T&lt;0&gt;"):
        assert part in got[0].entry
    assert "i2" not in got[0].entry and "news" not in got[1].entry
    ids = lambda **o: {r.id for r in sitemap_gen.eligible(inputs(spark), sitemap_gen.SitemapConfig(**o)).collect()}
    assert ids(include_statuses=(200, 301)) == {0, 1, 4, 5} and ids(exclude_patterns=("/en/p1",)) == {0, 5} and ids(include_patterns=("/en/p5",)) == {5} and ids(selected_urls=("https://x.com/en/p0", "no")) == {0}


def test_sitemap_files_round_trip(spark):
    rows = inputs(spark, 50).withColumn("status", F.lit(200)).withColumn("is_external", F.lit(False))
    files = sitemap_gen.files(rows, sitemap_gen.SitemapConfig(max_urls_per_file=20, filename="my.xml.gz")).collect()
    assert sorted(f.name for f in files) == ["my-1.xml", "my-2.xml", "my-3.xml", "my-index.xml"] and sum(f.url_count for f in files) == 50
    docs = spark.createDataFrame([(f.name, f.content) for f in files], "name string, xml string")
    back = sitemap.parse_documents(docs).collect()
    assert [u for r in sorted(back, key=lambda r: r.name) for u in r.urls] == [f"https://x.com/en/p{i}" for i in range(50)]
    assert next(r for r in back if r.nested).nested == [f"https://x.com/my-{k}.xml" for k in (1, 2, 3)]
    for f in files:
        ElementTree.fromstring(f.content)
    one = sitemap_gen.files(rows, sitemap_gen.SitemapConfig()).collect()
    assert [f.name for f in one] == ["sitemap.xml"] and sitemap_gen.files(rows, sitemap_gen.SitemapConfig(format="txt")).first().content.endswith("p49\n")
    checks = sitemap_gen.preview_checks(spark.createDataFrame([("a", one[0].content)], "name string, content string")).first()
    assert checks.duplicates == 0 and checks.well_formed
    assert sitemap_gen.warnings(rows.limit(0), sitemap_gen.SitemapConfig()) == ["No URLs match the current selection."]
    assert export.archive([(f.name, f.content) for f in files])[0] == "sitemaps.zip" and gzip.decompress(export.archive([("a", "x")], True)[1]) == b"x"


# ---------------------------------------------------------------- exports and streams

@pytest.fixture(scope="module")
def audited(spark):
    from pagemill.plans.audit import audit

    return audit(fetches(spark, [(0, URL, RICH, 200, None, {}), (1, "https://b.com/", page('Quote " and, comma for the title'), 404, None, {})])).cache()


def test_csv(audited, tmp_path):
    from pagemill.operators.views import ALL

    path = export.write_csv(audited, str(tmp_path / "out"))
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.startswith("﻿URL,Status") and path
    rows = list(csv.reader(io.StringIO(text[1:], newline="")))
    assert len(rows) == 3 and all(len(r) == len(ALL) for r in rows) and rows[2][4] == 'Quote " and, comma for the title'


def test_workbook_and_report(audited):
    book = zipfile.ZipFile(io.BytesIO(export.build_workbook(audited)))
    sheets = [n for n in book.namelist() if n.startswith("xl/worksheets/")]
    assert len(sheets) == 9
    for n in book.namelist():
        ElementTree.fromstring(book.read(n))
    assert b's="2"' in book.read("xl/worksheets/sheet3.xml")
    report = export.build_report(audited)
    assert "https://b.com/" in report and "pages with errors" in report and "<svg" in report


def test_workbook_holds_all_rows(audited):
    n = audited.count()
    assert n > 1
    book = zipfile.ZipFile(io.BytesIO(export.build_workbook(audited, 2)))
    names = [x.get("name") for x in ElementTree.fromstring(book.read("xl/workbook.xml"))[0]]
    assert len(set(names)) == len(names) == 1 + 8 * n
    rows = [len(ElementTree.fromstring(book.read(f"xl/worksheets/sheet{i}.xml"))[0]) for i in range(1, len(names) + 1)]
    assert set(rows[1:]) == {2}
    want = [str(v) for v in export.summary(audited).first()]
    got = ["".join(list(r)[1].itertext()) for r in ElementTree.fromstring(book.read("xl/worksheets/sheet1.xml"))[0]][1:]
    assert got[0] == want[0] == str(n)


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows = fetches(spark, [(0, URL, page("Same title here for both pages"), 200, None, {}), (1, URL + "2", page("Same title here for both pages"), 200, None, {})])
    rows.where("id = 0").write.mode("append").parquet(str(src))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(src))
    run = lambda: live.start_audit(stream(), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    run()
    assert not live.audited(spark, str(tmp_path / "out")).first().duplicate_title
    rows.where("id = 1").write.mode("append").parquet(str(src))
    run()
    assert [r.duplicate_title for r in live.audited(spark, str(tmp_path / "out")).collect()] == [True, True]
    eta = spark.createDataFrame([(10, 100, 50, 2000), (0, 1, 1, 0)], "crawled long, discovered long, most long, ms long").select(*live.rate_and_eta(*map(F.col, ("crawled", "discovered", "most", "ms"))))
    assert [tuple(r) for r in eta.collect()] == [(5.0, 8000), (0.0, None)]


def test_links_of_a_page(spark):
    from pagemill.operators.features import Dom, extracted_links

    dom = with_dom(spark.createDataFrame([("https://x.com/a", '<a href="/b/">1</a><a href="b">2</a><a href="https://y.com">3</a><a href="#x">4</a><a href="/b#q">5</a>')], "url string, html string"))
    inside, outside = extracted_links(Dom(F.col("dom")), F.lit("x.com"))
    got = dom.select(inside.alias("i"), outside.alias("o")).first()
    assert got.i == ["https://x.com/b"] and got.o == ["https://y.com/"]


def test_nested_sets_agree_with_a_walk(spark):
    rng = random.Random(4)
    urls = {"https://x.com/"} | {"https://x.com/" + "/".join(rng.choices("abcd", k=rng.randint(1, 5))) for _ in range(60)} | {"https://y.org/q/r"}
    t = tree.build_tree(spark.createDataFrame([(i, u, 200, 50, "") for i, u in enumerate(sorted(urls))], "id long, url string, status int, health_score int, title string")).repartition(5)
    nested = tree.nested_sets(t)
    rows = {(r.origin, r.path): r for r in nested.collect()}
    below = {}
    for (o, _), r in rows.items():
        below.setdefault((o, r.parent_path), []).append(r)
    want = {}

    def walk(r, n):
        first = n
        for x in sorted(below.get((r.origin, r.path), []), key=lambda x: (x.child_count == 0, x.label)):
            n = walk(x, n + 1)
        want[r.origin, r.path] = (first, n)
        return n

    for r in [r for r in rows.values() if r.parent_path is None]:
        walk(r, 0)
    assert {k: (r.left, r.right) for k, r in rows.items()} == want
    inside = {r.path for r in tree.subtree(nested, "https://x.com", "/a").collect()}
    assert inside == {p for o, p in rows if o == "https://x.com" and (p == "/a" or p.startswith("/a/"))} and tree.subtree(nested, "https://x.com", "/none").count() == 0
    opened = tree.expand_subtree(tree.expanded_to(nested, 1), nested, "https://x.com", "/a")
    assert {r.path for r in opened.collect()} == inside | {"/", "/q"} - {"/q"}
    assert {r.path for r in tree.collapse_subtree(opened, nested, "https://x.com", "/a").collect()} == {"/"}
    lines = [r.line for r in tree.indented_lines(t).where("origin = 'https://x.com'").orderBy("left").collect()]
    assert len(lines) == sum(o == "https://x.com" for o, _ in rows) and lines[0].startswith("x.com [200]") and lines[-1].lstrip("│ ").startswith("└── ")
    assert tree.build_tree(spark.createDataFrame([], "id long, url string, status int, health_score int, title string")).transform(tree.nested_sets).count() == 0


def test_root_url(spark):
    r = spark.createDataFrame([(0, "https://x.com/a/b", 1), (1, "https://x.com/c", 0), (2, "https://x.com/", 2), (3, "https://y.com/", 2)], "id long, url string, depth int")
    assert tree.root_url(r) == "https://x.com/c" and tree.root_url(r.drop("depth")) == "https://x.com/c" and tree.root_url(r.where("id > 1").drop("depth")) == "https://x.com/"
    assert tree.root_url(r, "https://z/") == "https://z/" and tree.root_url(r.limit(0)) is None


def test_running_sums_do_not_need_one_task(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), (F.col("id") % 5).alias("v")).repartition(6)
    got = {r.k: (r.n, r.s) for r in ordering.running(df, ["k"], {"n": F.lit(1), "s": F.col("v")}).collect()}
    values = {r.k: r.v for r in df.collect()}
    assert got == {k: (k, sum(values[j] for j in range(k))) for k in range(500)}


def test_text_sitemap_in_ranges(spark, tmp_path):
    rows = spark.range(300).select("id", F.format_string("https://x.com/p%d", "id").alias("url"), F.lit(200).alias("status"), F.lit(0).alias("chain_length"), F.lit(True).alias("is_html"), F.lit(False).alias("is_external"), F.lit(1).alias("depth"), F.lit(0).alias("inbound")).repartition(7)
    at = sitemap_gen.write_text(rows, sitemap_gen.SitemapConfig(format="txt", exclude_patterns=("/p7",)), str(tmp_path / "t"))
    lines = "".join(f.read_text() for f in sorted(pathlib.Path(at).glob("part-*"))).splitlines()
    assert lines == [f"https://x.com/p{i}" for i in range(300) if i != 7]


def test_live_progress_goes_on_from_its_checkpoint(spark, tmp_path):
    schema = "crawl string, ts timestamp, depth int, status_code int, discovered long, links long"
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    first = [("a", at(0), 0, 200, 9, 8), ("a", at(1), 1, 404, 20, 11), ("b", at(5), 0, None, 1, None)]
    second = [("a", at(4), 1, 301, 30, 0), ("a", at(2), 2, 503, 40, 2)]

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        keep = lambda batch, n: batch.write.mode("overwrite").parquet(str(tmp_path / "out"))
        live.live_progress(stream, max_pages=25, max_depth=2).writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
        return {r.crawl: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    got = run(first)
    assert (got["a"].crawled, got["a"].elapsed_ms, got["a"].pages_per_sec, got["a"].eta_ms) == (2, 1000, 2.0, 9000) and (got["b"].errors, got["b"].eta_ms, got["b"].total_links) == (1, None, 0)
    a = run(second)["a"]
    assert (a.crawled, a.discovered, a.queued, a.total_links, a.elapsed_ms, a.pages_per_sec, a.eta_ms) == (4, 40, 21, 21, 4000, 1.0, 21000)
    assert (a.status_2xx, a.status_3xx, a.status_4xx, a.status_5xx, a.depth_0, a.depth_1, a.depth_2) == (1, 1, 1, 1, 1, 2, 1)


def test_quiet_crawls(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", at(0)), ("a", at(3)), ("b", at(1)), ("a", at(40))], "crawl string, ts timestamp").coalesce(1).write.parquet(src)
    spark.createDataFrame([("c", at(59))], "crawl string, ts timestamp").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("crawl string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    live.quiet_crawls(stream).writeStream.outputMode("append").format("memory").queryName("quiet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.crawl, r.started.minute, r.last_seen.minute, r.pages) for r in spark.table("quiet").collect()} >= {("a", 0, 3, 2), ("b", 1, 1, 1)}
