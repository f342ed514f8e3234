import pytest
from pyspark.sql import functions as F

from pagemill.operators import scoring, summary, views
from pagemill.plans.audit import audit, register
from pagemill.sources.fetch_log import HTTP
from pagemill.sources.html import parse_page

URL = "https://www.example.com/dir/page"
RICH = """<!DOCTYPE html><html lang=" en "><head><meta charset=utf-8><title> Example page about things that is long </title>
<meta name="description" content="d"><meta name="viewport" content="x"><meta name="robots" content="NoIndex">
<link rel="canonical" href="/dir/page/"><link rel="alternate" hreflang="en" href="/dir/page"><link rel=alternate hreflang=de href="https://de.example.com/">
<link rel="shortcut icon" href="/f.ico"><link rel="stylesheet" href="a.css"><link rel="stylesheet" href="p.css" media="print"><link rel=preload as=font href=x>
<meta property="og:title" content="o"><meta property="og:image" content="i"><meta name="twitter:card" content="s">
<script src="/a.js"></script><script async src="b.js"></script><script type="module" src="c.js"></script><script>var x = "</p>";</script>
<script type="application/ld+json">{"@context":"x","@graph":[{"@type":"Product"},{"@type":["Article",3]}]}</script><script type="application/ld+json">{bad</script></head>
<body><nav>menu <a href="/n">n</a></nav><h1>Head <b>line</b></h1><h3>skip</h3><p>One<p>Two words. Three!
<img src="a.webp?x" alt="" width=1 height=1 loading=lazy><img src="b.JPG"><a href="#">top</a><a href="javascript:x()">j</a><a href="https://other.org/x" rel="NoFollow ugc"><img src="c.png" alt=z></a>
<a href="mailto:a@b">m</a><a href=""></a><a>bare</a><iframe src="https://www.youtube.com/embed/1"></iframe><table></table><style>.x{}</style><noscript>no</noscript><footer>foot</footer></body></html>"""


def fetches(spark, rows):
    """rows: (id, url, html, status, error, options)"""
    base = dict(status_text="", redirect_chain=[], ttfb_ms=10, total_download_ms=10, redirect_time_ms=0, content_type="text/html", content_length_kb=1.0, http_version="2.0", compressed=True, headers={"strict-transport-security": "x"})
    data = [(i, u, h, {"status_code": s, **base, **o}, e) for i, u, h, s, e, o in rows]
    return spark.createDataFrame(data, f"id long, url string, html string, http {HTTP}, error string")


@pytest.fixture(scope="module")
def rich(spark):
    return audit(fetches(spark, [(1, URL, RICH, 200, None, {})])).first()


def test_seo(rich):
    s = rich.seo
    assert s.title == "Example page about things that is long" and s.title_length == 38 and s.title_pixel_width == 228 and s.title_has_brand
    assert s.meta_description == "d" and s.h1 == "Head line" and (s.h1_count, s.h2_count, s.h3_count) == (1, 0, 1) and not s.heading_hierarchy_valid
    assert s.canonical_status == "self" and s.canonical_url == "https://www.example.com/dir/page/" and not s.is_indexable and s.html_lang == "en"
    assert s.hreflang == ["en", "de"] and s.hreflang_count == 2 and s.hreflang_self_reference and s.hreflang_links[1].href == "https://de.example.com/"
    assert s.url_depth == 2 and not s.has_uppercase and not s.has_parameters


def test_performance(rich):
    p = rich.performance
    assert p.js_file_urls == ["https://www.example.com/a.js", "https://www.example.com/dir/b.js", "https://www.example.com/dir/c.js"]
    assert p.render_blocking_js == ["https://www.example.com/a.js"] and p.render_blocking_css == ["https://www.example.com/dir/a.css"] and p.css_files_count == 2
    assert (p.inline_script_count, p.inline_style_count, p.image_count, p.font_preloads, p.render_blocking_count) == (3, 1, 3, 1, 2)
    assert p.has_lazy_loading and p.has_resource_hints and not p.has_preconnect


def test_content_and_technical(rich):
    c, t = rich.content, rich.technical
    assert c.word_count == 6  # texts of neighbouring elements are joined without a space
    assert c.has_video and c.has_table and c.has_iframe and c.iframe_domains == ["www.youtube.com"] and c.paragraph_count == 2
    assert t.https and t.http2 and t.has_doctype and t.has_charset and t.has_viewport and t.has_favicon and t.strict_transport_security == "x"


def test_content_text():
    text = " ".join(parse_page(URL, RICH)["visible_text"].split())
    assert text == "Head lineskipOneTwo words. Three! topj mbare"


def test_social_images_links(rich):
    o, i, k = rich.social, rich.images, rich.links
    assert o.schema_types == ["Product", "Article"] and o.schema_count == 2 and not o.json_ld_valid and o.has_product and o.has_article and not o.has_faq and not o.og_complete
    assert (i.total_images, i.missing_alt, i.empty_alt, i.missing_dimensions, i.next_gen_formats, i.legacy_formats, i.lazy_loaded) == (3, 1, 1, 2, 1, 2, 1)
    assert (k.total_links, k.internal_links, k.external_links, k.nofollow, k.ugc, k.without_anchor_text, k.hash_only, k.javascript_links) == (7, 1, 1, 1, 1, 1, 1, 1) and k.external_domains == ["other.org"]


def page(title="T" * 40, head="", body=""):
    return f'<!doctype html><html lang="en"><head><meta charset="u"><title>{title}</title>{head}</head><body><h1>h</h1>{body}</body></html>'


def fields(spark, html, url=URL, **options):
    row = audit(fetches(spark, [(1, url, html, 200, None, options)])).first()
    return {(i.field, i.severity): i for i in row.issues}, row


@pytest.mark.parametrize("n, field", [(29, "titleLength"), (30, None), (60, None), (61, "titleLength"), (0, "title")])
def test_title_bounds(spark, n, field):
    got, _ = fields(spark, page("T" * n))
    assert {f for f, _ in got if f in ("title", "titleLength")} == ({field} if field else set())


@pytest.mark.parametrize("ms, severity", [(800, None), (801, "warning"), (2000, "warning"), (2001, "critical")])
def test_ttfb_bounds(spark, ms, severity):
    got, _ = fields(spark, page(), ttfb_ms=ms)
    assert [s for f, s in got if f == "ttfb"] == ([severity] if severity else [])


def test_messages_and_values(spark):
    got, row = fields(spark, page("short"), total_download_ms=3001, redirect_chain=[("a", 301), ("b", 302), ("c", 301), ("d", 302), ("e", 200)], redirect_time_ms=501, headers={"x-robots-tag": "noindex"}, compressed=False)
    assert got["titleLength", "warning"].message == "Title too short (5 chars, <30)" and got["titleLength", "warning"].value_num == 5
    assert got["redirects", "critical"].message == "Redirect chain too long (4)" and got["xRobotsTag", "critical"].value_str == "noindex"
    assert ("hsts", "warning") in got and ("compression", "warning") in got and row.row_status == "warning"


def test_failures_and_plain_pages(spark):
    a = {r.id: r for r in audit(fetches(spark, [(1, URL, None, None, "Timeout", {}), (2, URL, page(), 404, None, {"status_text": "Not Found"}), (3, URL, None, 200, None, {}), (4, URL, "", 301, None, {})])).collect()}
    assert [(i.field, i.message, i.value_num) for i in a[1].issues] == [("request", "Timeout", None)] and a[1].health_score == 0 and a[1].row_status == "error"
    assert a[2].issues[0].message == "HTTP 404 Not Found" and a[2].issues[0].value_num == 404 and a[2].seo is not None and tuple(a[2].scores) == (0,) * 6
    assert a[3].issues == [] and a[3].health_score == 100 and a[3].row_status == "ok" and a[3].seo is None and a[4].health_score == 100


def test_duplicates_lower_seo_by_ten(spark):
    rows = [(1, URL + "1", page("Same title for two of the pages"), 200, None, {}), (2, URL + "2", page(" same TITLE for two of the pages "), 200, None, {}), (3, URL + "3", page("Another title for the third page"), 200, None, {}), (4, URL + "4", page("Another title for the third page"), 404, None, {})]
    a = {r.id: r for r in audit(fetches(spark, rows)).collect()}
    assert a[1].duplicate_title and a[2].duplicate_title and a[3].duplicate_title and len(a[4].issues) == 1
    alone = audit(fetches(spark, rows[:1])).first()
    assert alone.scores.seo - a[1].scores.seo == 10 and not alone.duplicate_title


def test_score_properties(spark):
    rows = [(i, f"http://ex.com/{'a/' * i}", page("x" * i * 5, body="<p>w</p>" * i), [200, 301, 500, None][i % 4], None, {"ttfb_ms": i * 400}) for i in range(12)]
    for r in audit(fetches(spark, rows)).collect():
        assert all(0 <= s <= 100 for s in [*r.scores, r.health_score])
        assert (r.row_status == "error") == (r.health_score == 0 and len(r.issues) == 1)
        if r.row_status != "error":
            assert r.health_score == int(sum(s * w for s, w in zip(r.scores, scoring.WEIGHTS.values(), strict=True)) + 0.5)


@pytest.fixture(scope="module")
def several(spark):
    rows = [(0, "https://b.com/x", page("Title number one of the whole lot"), 200, None, {}), (1, "https://a.com/y", page(""), 404, None, {}), (2, "http://c.com/", RICH, 200, None, {"ttfb_ms": 900, "redirect_chain": [("u", 302), ("https://t", 200)]}), (3, "https://d.com", None, None, "Cancelled", {})]
    return audit(fetches(spark, rows)).cache()


def test_filters(several):
    ids = lambda cond: [r.id for r in several.where(cond).orderBy("id").collect()]
    assert ids(views.search("NUMBER one")) == [0] and ids(views.search("  ")) == [0, 1, 2, 3] and ids(views.search("not found")) == []
    assert ids(views.global_filter(statuses={"errors", "4xx"})) == [1, 3] and ids(views.global_filter(health=(1, 100))) == [0, 2]
    assert ids(views.global_filter(severities={"none"})) == [] and ids(views.global_filter(severities={"critical"})) == [0, 1, 2, 3]
    assert ids(views.pill_filter(["tech-no-https"])) == [2] and ids(views.pill_filter(["seo-missing-title", "perf-slow-ttfb"])) == []
    counts = {r.pill: r.n for r in views.pill_counts(several).collect()}
    assert counts["perf-slow-ttfb"] == 1 and counts["seo-missing-title"] == 1 and len(counts) == 29


def test_sort_project_format(several):
    order = lambda c, d=False: [r.id for r in views.sort_rows(several, c, d).collect()]
    assert order("url") == [2, 1, 0, 3]
    assert order("title")[0] == 3 and order("title", True)[-1] == 3 and order("ttfb", True)[0] == 2
    assert views.next_sort(None, "a") == ("a", False) and views.next_sort(("a", False), "a") == ("a", True) and views.next_sort(("a", True), "a") is None
    full = views.project(several, views.ALL)
    assert len(full.columns) == 126 and full.count() == 4
    assert [r.redirect for r in full.orderBy("url").collect()].count("302 → https://t") == 1
    got = {r.id: r.f for r in several.select("id", views.flag("ttfb").alias("f")).collect()}
    assert got == {0: None, 1: None, 2: "warning", 3: None}
    shown = several.where("id = 2").select(views.display_value(F.col("seo.hreflang"), "array<string>").alias("v"), views.csv_value(F.col("seo.hreflang"), "array<string>").alias("w"), views.csv_value(F.col("performance.html_compressed"), "boolean").alias("b")).first()
    assert shown.v == "en, de" and shown.w == "en | de" and shown.b == "Yes"


def test_summary(several):
    s = summary.summary(several).first()
    assert (s.total, s.status_2xx, s.status_4xx, s.errors, s.missing_title) == (4, 2, 1, 1, 1)
    cats = {r.category: (r.critical, r.warning) for r in summary.issues_by_category(several).collect()}
    assert len(cats) == 7 and sum(a + b for a, b in cats.values()) == s.total_issues and sum(a for a, _ in cats.values()) == s.critical_issues
    assert [r.id for r in summary.worst(several, 2).collect()] == [1, 3] and sum(r.n for r in summary.health_histogram(several).collect()) == 4
    assert summary.key_findings(summary.summary(several)).orderBy("position").collect()[-1].finding == "2 pages with errors"


def test_sql_views(spark, several):
    register(several)
    assert spark.sql("select count(*) from issues join audited using (id) where severity = 'critical'").first()[0] == summary.summary(several).first().critical_issues


def test_empty(spark):
    a = audit(fetches(spark, [(1, URL, page(), 200, None, {})]).limit(0))
    assert a.count() == 0 and summary.summary(a).first().total == 0 and summary.summary(a).first().avg_health == 0
