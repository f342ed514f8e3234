"""Selectors by text, on nested and repeated elements."""

import pytest
from pyspark.sql import functions as F

from pagemill.operators import selectors
from pagemill.operators.features import Dom, page_features
from pagemill.sources.html import with_dom

HTML = """<!doctype html><html lang="en"><head><title>One</title><meta charset="utf-8"><meta name="Description" content="no"><meta name="description" content="yes"><meta name="robots" content="x">
<meta http-equiv="content-type" content="t"><meta name="viewport" content="w"><link REL="Canonical" href="/c"><link rel="alternate" hreflang="en" href="/e"><link rel="alternate" href="/f"><link rel="stylesheet" href="a.css">
<link rel="stylesheet" href="b.css" media="PRINT"><link rel="preload" as="font" href="f"><link rel="preload" as="Font" href="f"><link rel="preconnect" href="p"><link rel="dns-prefetch" href="d"><link rel="prefetch" href="q"><link rel="shortcut icon" href="i">
<link rel="sitemap" href="s"><script>var a="<a href='/no'>"</script><script type="application/LD+json">{}</script></head>
<body><nav><ul><li><a href="/a">A</a></li><li><a class="x big y" href="https://o.org/">B</a></li></ul></nav><article><h1>H</h1><div><h2>I</h2><div><h2>J</h2><p><a href="#">n</a><p><a>bare</a></div></div>
<svg><title>inner</title></svg><ul><li><ol><li><a href="/deep/x.pdf" rel="nofollow sponsored" title="it's, a > b">D</a></li></ol></li></ul></article><img src="a.webp" loading="lazy"><img src="b" loading="Lazy"><video></video><audio></audio><iframe src="x"></iframe><table></table><style></style><h3>K</h3></body></html>"""

# every selector that the audit's fields need, and forms that they do not
CASES = {
    "head > title": 1, "title": 2, "svg > title": 1, 'meta[name="description"]': 1, "h1": 1, "h2": 2, "h3": 1, "h1, h2, h3, h4, h5, h6": 4, 'meta[name="robots"]': 1, 'link[rel="canonical"]': 1,
    'link[rel="alternate"][hreflang]': 1, "html": 1, "script": 2, 'link[rel="stylesheet"]': 2, 'link[rel="preload"][as="font"]': 1, "style": 1, "img": 2, 'img[loading="lazy"]': 1, 'link[rel="preconnect"]': 1,
    'link[rel="dns-prefetch"]': 1, 'link[rel="preload"], link[rel="prefetch"], link[rel="prerender"]': 3, "video": 1, "iframe": 1, "p": 2, "table": 1, "audio": 1, "meta[charset]": 1, 'meta[http-equiv="Content-Type"]': 1,
    'meta[name="viewport"]': 1, 'link[rel="icon"], link[rel="shortcut icon"], link[rel="apple-touch-icon"]': 1, 'link[rel="sitemap"]': 1, 'script[type="application/ld+json"]': 1, "a": 5, "a[href]": 4,
    "nav a": 2, "nav > a": 0, "ul > li > a": 2, "li a": 3, "li li a": 1, "ol>li>a": 1, "div h2": 2, "div > div > h2": 1, "div div h2": 1, "article > * > h2": 1, "body > article > h1": 1, "*[loading]": 2, "[loading=Lazy]": 1, "[loading=lazy i]": 2,
    'a[href^="/"]': 2, "a[href$='.pdf']": 1, 'a[href*="o.org"]': 1, 'a[class~="big"]': 1, 'a[class~="bi"]': 0, 'a[rel~="SPONSORED"]': 1, 'html[lang|="en"]': 1, 'a[href^=""]': 0, 'a[title="it\'s, a > b"]': 1, "A[HREF]": 4, "head a": 0, "head script, body img": 4,
}


def test_selectors(spark):
    page = with_dom(spark.createDataFrame([("https://x.com/", HTML), ("https://x.com/2", None)], "url string, html string"))
    dom = Dom(F.col("dom"))
    got = page.select(*[selectors.count(dom, s).alias(str(i)) for i, s in enumerate(CASES)]).collect()
    assert {s: got[0][i] for i, s in enumerate(CASES)} == CASES and all(v is None or v == -1 for v in got[1])
    one = page.select(selectors.first(dom, "li li a")["attrs"]["href"].alias("href"), selectors.select(dom, "div h2")["text"].alias("t"), selectors.first(dom, "ol > a").alias("none")).first()
    assert one.href == "/deep/x.pdf" and one.none is None


def test_selectors_agree_with_the_features(spark):
    http = "struct<status_code:int,status_text:string,redirect_chain:array<struct<url:string,status:int>>,ttfb_ms:int,total_download_ms:int,redirect_time_ms:int,content_type:string,content_length_kb:double,http_version:string,compressed:boolean,headers:map<string,string>>"
    row = spark.createDataFrame([(1, "https://x.com/", HTML)], "id long, url string, html string").select("*", F.lit(None).cast(http).alias("http"), F.lit(None).cast("string").alias("error"))
    dom = Dom(F.col("dom"))
    n = lambda s: selectors.count(dom, s)
    pairs = [("seo.h1_count", n("h1")), ("seo.h2_count", n("h2")), ("performance.font_preloads", n('link[rel="preload"][as="font"]')), ("performance.inline_style_count", n("style")), ("content.paragraph_count", n("p")), ("images.total_images", n("img")), ("links.total_links", n("a")), ("seo.title", selectors.first(dom, "head > title")["text"])]
    got = page_features(row).select(*[F.struct(F.col(a).cast("string").alias("a"), b.cast("string").alias("b")).alias(str(i)) for i, (a, b) in enumerate(pairs)]).first()
    assert all(x.a == x.b for x in got)


@pytest.mark.parametrize("bad", ["", "a,", "a >", "> a", "a[href", "blink", "a:hover", "a + p", "div[x] a", "a..b"])
def test_what_is_not_known_is_refused(bad):
    with pytest.raises(ValueError):
        selectors.predicate(bad)(F.col("e"))
