"""The rule set as data: each rule has a category, a severity, a field, a predicate, a message and a value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import empty, number_text

CATEGORIES = ["seo", "performance", "content", "technical", "social", "images", "links"]
ISSUE = "struct<category:string,severity:string,field:string,message:string,value_num:double,value_str:string>"


@dataclass
class Rule:
    category: str
    severity: str
    field: str
    when: Column
    message: Column
    num: Column | None = None
    text: Column | None = None

    def issue(self) -> Column:
        """The issue where the rule holds, else null."""
        null = F.lit(None)
        found = F.struct(F.lit(self.category).alias("category"), F.lit(self.severity).alias("severity"), F.lit(self.field).alias("field"), self.message.alias("message"), (null if self.num is None else self.num).cast("double").alias("value_num"), (null if self.text is None else self.text).cast("string").alias("value_str"))
        return F.when(F.coalesce(self.when, F.lit(False)), found).cast(ISSUE)


def _say(text: str, n: Column | None = None) -> Column:
    """Text with {} filled by a number."""
    if n is None:
        return F.lit(text)
    head, tail = text.split("{}")
    return F.concat(F.lit(head), number_text(n.cast("double")), F.lit(tail))


def rule_set(f: dict[str, Column], duplicate_title: Column, duplicate_description: Column) -> list[Rule]:
    """All rules over the feature structs f; the thresholds and wordings are those of the audit."""
    out: list[Rule] = []
    group = ""

    def add(severity: str, field: str, when: Column, message: str, num: Column | None = None, text: Column | None = None) -> None:
        out.append(Rule(group, severity, field, when, _say(message, num if "{}" in message else None), num, text))

    def above(severity: str, field: str, x: Column, limit: float, message: str, top: float | None = None) -> None:
        add(severity, field, (x > limit) if top is None else (x > limit) & (x <= top), message, x)

    group, s = "seo", f["seo"]
    no_title, no_desc = empty(s["title"]), empty(s["meta_description"])
    n, d = s["title_length"], s["meta_description_length"]
    add("warning", "title", no_title, "Missing title tag")
    add("warning", "titleLength", ~no_title & (n < 30), "Title too short ({} chars, <30)", n)
    add("warning", "titleLength", ~no_title & (n > 60), "Title too long ({} chars, >60)", n)
    add("warning", "titlePixelWidth", ~no_title & (s["title_pixel_width"] > 580), "Title may truncate in SERP (~{}px)", s["title_pixel_width"])
    add("critical", "duplicateTitle", duplicate_title & s.isNotNull(), "Title duplicated on another page", text=s["title"])
    add("warning", "metaDescription", no_desc, "Missing meta description")
    add("warning", "metaDescriptionLength", ~no_desc & (d < 70), "Meta description short ({}, <70)", d)
    add("warning", "metaDescriptionLength", ~no_desc & (d > 160), "Meta description long ({}, >160)", d)
    add("critical", "duplicateDescription", duplicate_description & s.isNotNull(), "Meta description duplicated on another page")
    add("warning", "h1", empty(s["h1"]), "Missing H1")
    add("warning", "h1Count", s["h1_count"] == 0, "No H1 tag", F.lit(0))
    above("warning", "h1Count", s["h1_count"], 1, "Multiple H1 tags ({})")
    add("warning", "headingHierarchy", ~s["heading_hierarchy_valid"], "Heading levels skip (broken hierarchy)")
    add("critical", "metaRobots", s["meta_robots"].rlike("(?i)noindex"), "meta robots is noindex", text=s["meta_robots"])
    add("critical", "xRobotsTag", s["x_robots_tag"].rlike("(?i)noindex"), "X-Robots-Tag is noindex", text=s["x_robots_tag"])
    add("warning", "canonical", s["canonical_status"] == "missing", "Missing canonical tag")
    add("warning", "canonical", s["canonical_status"] == "other", "Canonical points to another URL", text=s["canonical_url"])
    add("critical", "isIndexable", ~s["is_indexable"], "Page is not indexable")
    above("warning", "urlLength", s["url_length"], 115, "URL very long ({} chars)")
    above("warning", "urlDepth", s["url_depth"], 4, "Deep URL ({} levels)")
    add("warning", "urlCase", s["has_uppercase"], "URL contains uppercase letters")
    add("warning", "urlUnderscores", s["has_underscores"], "URL uses underscores instead of hyphens")
    add("warning", "htmlLang", empty(s["html_lang"]), "Missing html lang attribute")
    add("warning", "hreflang", (s["hreflang_count"] > 0) & ~s["hreflang_self_reference"], "hreflang set missing self-reference")

    group, p = "performance", f["performance"]
    above("critical", "ttfb", p["ttfb_ms"], 2000, "Very slow TTFB ({}ms)")
    above("warning", "ttfb", p["ttfb_ms"], 800, "Slow TTFB ({}ms)", 2000)
    above("warning", "download", p["total_download_ms"], 3000, "Slow download ({}ms)")
    above("warning", "redirectTime", p["redirect_time_ms"], 500, "Slow redirects ({}ms)")
    above("critical", "redirects", p["num_redirects"], 3, "Redirect chain too long ({})")
    above("warning", "redirects", p["num_redirects"], 1, "Multiple redirects ({})", 3)
    above("warning", "htmlSize", p["html_size_kb"], 100, "Large HTML ({}KB)")
    above("warning", "pageWeight", p["total_page_weight_kb"], 3000, "Heavy page ({}KB)")
    add("warning", "compression", ~p["html_compressed"], "Response not compressed")
    above("warning", "jsFiles", p["js_files_count"], 15, "Many JS files ({})")
    above("warning", "cssFiles", p["css_files_count"], 8, "Many CSS files ({})")
    above("warning", "inlineScripts", p["inline_script_count"], 10, "Many inline scripts ({})")
    above("warning", "inlineStyles", p["inline_style_count"], 5, "Many inline style blocks ({})")
    add("warning", "lazyLoading", (p["image_count"] > 0) & ~p["has_lazy_loading"], "No images use lazy loading")
    above("critical", "renderBlocking", p["render_blocking_count"], 10, "Many render-blocking resources ({})")
    above("warning", "renderBlocking", p["render_blocking_count"], 5, "Render-blocking resources ({})", 10)

    group, c = "content", f["content"]
    add("warning", "wordCount", c["word_count"] < 300, "Thin content ({} words, <300)", c["word_count"])
    add("warning", "textRatio", c["text_html_ratio"] < 10, "Low text/HTML ratio ({}%)", c["text_html_ratio"])

    group, t = "technical", f["technical"]
    add("critical", "https", ~t["https"], "Not served over HTTPS")
    add("warning", "doctype", ~t["has_doctype"], "Missing doctype")
    add("warning", "charset", ~t["has_charset"], "Missing charset declaration")
    add("warning", "viewport", ~t["has_viewport"], "Missing viewport meta")
    add("warning", "favicon", ~t["has_favicon"], "No favicon found")
    add("warning", "hsts", t["https"] & empty(t["strict_transport_security"]), "Missing HSTS header on HTTPS")

    group, o = "social", f["social"]
    there = o.isNotNull()
    add("warning", "ogTitle", there & empty(o["og_title"]), "Missing og:title")
    add("warning", "ogDescription", there & empty(o["og_description"]), "Missing og:description")
    add("warning", "ogImage", there & empty(o["og_image"]), "Missing og:image")
    add("warning", "ogImageDimensions", there & ~empty(o["og_image"]) & empty(o["og_image_width"]) & empty(o["og_image_height"]), "Missing og:image dimensions")
    add("warning", "ogType", there & empty(o["og_type"]), "Missing og:type")
    add("warning", "ogUrl", there & empty(o["og_url"]), "Missing og:url")
    add("critical", "ogComplete", ~o["og_complete"], "Open Graph tags incomplete")
    add("warning", "twitterCard", there & empty(o["twitter_card"]), "Missing twitter:card")
    add("warning", "structuredData", ~o["has_structured_data"], "No structured data found")
    add("critical", "jsonLd", ~o["json_ld_valid"], "Invalid JSON-LD")

    group, i = "images", f["images"]
    above("critical", "missingAlt", i["missing_alt"], 0, "{} image(s) missing alt")
    above("warning", "missingDimensions", i["missing_dimensions"], 0, "{} image(s) missing dimensions (CLS risk)")
    add("warning", "legacyFormats", (i["total_images"] > 0) & (i["legacy_formats"] > 0) & (i["next_gen_formats"] == 0), "No next-gen image formats used")

    group, k = "links", f["links"]
    above("warning", "anchorText", k["without_anchor_text"], 0, "{} link(s) without anchor text")
    above("warning", "hashLinks", k["hash_only"], 0, "{} empty (#) link(s)")
    above("critical", "jsLinks", k["javascript_links"], 0, "{} javascript: link(s)")

    for rule in out:
        if rule.category == "seo" and rule.field in ("title", "metaDescription", "h1", "htmlLang"):
            rule.when = rule.when & s.isNotNull()
    return out
