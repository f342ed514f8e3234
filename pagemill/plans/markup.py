"""Pages with markup that the page table lacks, derived from page_id, and the same facts in SQL.

Canonical links, alternates, social tags, structured data, images and odd links are put into each page's own html, so that
the fields and rules that read them work on the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LD = '{"@graph":[{"@type":["Article","Thing"]},{"@type":"FAQPage","name":"x"}]}'


def marked(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with derived markup in head and body."""
    i = F.col("page_id")
    url = F.replace("url", F.lit("&"), F.lit("&amp;"))

    def given(when: Column, *parts: str | Column) -> Column:
        return F.when(when, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")

    meta = lambda key, value: f'<meta property="{key}" content="{value}">'
    head = [
        given(i % 4 == 0, '<link rel="canonical" href="', url, '">'), given(i % 4 == 1, '<link rel="canonical" href="/other">'),
        given(i % 5 == 0, '<link rel="alternate" hreflang="en" href="', url, '"><link rel="alternate" hreflang="de" href="/de">'),
        given(i % 2 == 0, meta("og:title", "t")), given(i % 3 == 0, meta("og:description", "d")), given(i % 5 != 0, meta("og:image", "/i.png")), given((i % 5 != 0) & (i % 2 == 0), meta("og:image:width", "100")),
        given(i % 7 != 0, meta("og:type", "article")), given(i % 3 != 1, meta("og:url", "u")), given(i % 4 == 0, '<meta name="twitter:card" content="summary">'),
        given(i % 6 == 0, f'<script type="application/ld+json">{_LD}</script>'), given(i % 6 == 1, '<script type="application/ld+json">{bad</script>'),
    ]
    body = [
        given(i % 2 == 0, '<img src="/a.webp" alt="x" width="1" height="1" loading="lazy">'), given(i % 3 == 0, '<img src="b.JPG?x=1"><img src="/c.png" alt="">'),
        given(i % 4 == 2, '<a href="#">t</a>'), given(i % 5 == 3, '<a href="javascript:void(0)">t</a>'), given(i % 3 == 1, '<a href="https://ext.example.org/" rel="nofollow sponsored"> </a>'),
        given(i % 7 == 3, '<a href="/pic"><img src="d.gif" alt="d" width="2" height="2"></a>'),
    ]
    html = F.replace("html", F.lit("</title>"), F.concat(F.lit("</title>"), *head))
    return pages.withColumn("html", F.replace(html, F.lit("<body>"), F.concat(F.lit("<body>"), *body)))


#: Facts of marked() by page: a row for each page that was fetched.
FACTS = """facts AS (SELECT page_id AS id, url, html, i % 2 = 0 AND i % 3 = 0 AND i % 5 <> 0 AND i % 7 <> 0 AS og_complete, i % 6 = 0 AS ld, i % 6 <> 1 AS ld_valid, i % 4 AS canonical, i % 5 = 0 AS alternates,
  CASE WHEN i % 2 = 0 THEN 1::BIGINT ELSE 0 END AS webp, CASE WHEN i % 3 = 0 THEN 1::BIGINT ELSE 0 END AS pair, CASE WHEN i % 7 = 3 THEN 1::BIGINT ELSE 0 END AS gif, CASE WHEN i % 4 = 2 THEN 1::BIGINT ELSE 0 END AS hash, CASE WHEN i % 5 = 3 THEN 1::BIGINT ELSE 0 END AS js, CASE WHEN i % 3 = 1 THEN 1::BIGINT ELSE 0 END AS bare,
  i % 29 <> 0 AND i % 17 <> 0 AS fine, i % 23 <> 0 AS direct, i FROM (SELECT *, page_id AS i FROM pages) p WHERE i % 37 <> 0)"""

#: (category, severity, field, condition, message) of the rules on social tags, images and links.
_RULES = [
    ("social", "warning", "ogTitle", "i % 2 <> 0", "'Missing og:title'"), ("social", "warning", "ogDescription", "i % 3 <> 0", "'Missing og:description'"), ("social", "warning", "ogImage", "i % 5 = 0", "'Missing og:image'"),
    ("social", "warning", "ogImageDimensions", "i % 5 <> 0 AND i % 2 <> 0", "'Missing og:image dimensions'"), ("social", "warning", "ogType", "i % 7 = 0", "'Missing og:type'"), ("social", "warning", "ogUrl", "i % 3 = 1", "'Missing og:url'"),
    ("social", "critical", "ogComplete", "NOT og_complete", "'Open Graph tags incomplete'"), ("social", "warning", "twitterCard", "i % 4 <> 0", "'Missing twitter:card'"), ("social", "warning", "structuredData", "NOT ld", "'No structured data found'"),
    ("social", "critical", "jsonLd", "NOT ld_valid", "'Invalid JSON-LD'"), ("images", "critical", "missingAlt", "pair > 0", "'1 image(s) missing alt'"), ("images", "warning", "missingDimensions", "pair > 0", "'2 image(s) missing dimensions (CLS risk)'"),
    ("images", "warning", "legacyFormats", "pair + gif > 0 AND webp = 0", "'No next-gen image formats used'"), ("links", "warning", "anchorText", "bare > 0", "'1 link(s) without anchor text'"), ("links", "warning", "hashLinks", "hash > 0", "'1 empty (#) link(s)'"),
    ("links", "critical", "jsLinks", "js > 0", "'1 javascript: link(s)'"),
]
ISSUES = f"WITH {FACTS} " + " UNION ALL ".join(f"SELECT id, '{g}' AS category, '{s}' AS severity, '{f}' AS field, {m} AS message FROM facts WHERE fine AND {w}" for g, s, f, w, m in _RULES)

AUDIT = f"""WITH {FACTS} SELECT id, CASE canonical WHEN 0 THEN 'self' WHEN 1 THEN 'other' ELSE 'missing' END AS canonical_status, alternates AS hreflang_self, CASE WHEN ld THEN 'Article,Thing,FAQPage' ELSE '' END AS types, ld AS has_article, ld AS has_faq, og_complete, ld_valid AS json_valid,
  webp + 2 * pair + gif AS total_images, pair AS missing_alt, pair AS empty_alt, webp AS next_gen_formats, 2 * pair + gif AS legacy_formats, webp AS lazy_loaded, hash AS hash_only, js AS javascript_links, bare AS without_anchor, bare AS nofollow FROM facts"""

_XML = "replace(replace({x}, '&', '&amp;'), '''', '&apos;')"
_ORIGIN, _FOLDER = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)", "regexp_extract(url, '^([a-z]+://[^/?#]*/(?:[^?#/]*/)*)', 1)"
_DATE = "CASE WHEN i % 2 = 0 THEN '2023-05-06T07:08:09+00:00' ELSE '2024-01-01T00:00:00+00:00' END"
EXTENDED = f"""WITH {FACTS}, listed AS (SELECT *, list_concat(list_concat(CASE WHEN webp > 0 THEN [{_ORIGIN} || '/a.webp'] ELSE [] END, CASE WHEN pair > 0 THEN [{_FOLDER} || 'b.JPG?x=1', {_ORIGIN} || '/c.png'] ELSE [] END), CASE WHEN gif > 0 THEN [{_FOLDER} || 'd.gif'] ELSE [] END)[1:2] AS imgs, {_DATE} AS d FROM facts WHERE fine AND direct)
SELECT id, d AS lastmod, '  <url>' || chr(10) || '    <loc>' || {_XML.format(x="url")} || '</loc>' || chr(10) || '    <lastmod>' || d || '</lastmod>'
  || CASE WHEN alternates THEN chr(10) || '    <xhtml:link rel="alternate" hreflang="en" href="' || {_XML.format(x="url")} || '"/>' || chr(10) || '    <xhtml:link rel="alternate" hreflang="de" href="' || {_ORIGIN} || '/de"/>' ELSE '' END
  || array_to_string(list_transform(imgs, lambda u: chr(10) || '    <image:image><image:loc>' || u || '</image:loc></image:image>'), '')
  || CASE WHEN contains(url, '/en/') THEN chr(10) || '    <news:news><news:publication><news:name>P &amp; Q</news:name><news:language>en</news:language></news:publication><news:publication_date>' || d || '</news:publication_date><news:title>' || replace(replace(trim(regexp_extract(html, '<title>(.*?)</title>', 1)), '''', '&apos;'), '"', '&quot;') || '</news:title></news:news>' ELSE '' END
  || chr(10) || '  </url>' AS entry FROM listed"""
