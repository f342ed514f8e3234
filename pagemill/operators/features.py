"""Feature structs of a page as column expressions over its dom and fetch row.

Names are snake-case forms of the audit's fields; each struct is null where the page has no html.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import detect_language, html_kb, reading_level, squeeze, text_ratio, trim, words
from ..functions.urls import host_of, path_of, segments
from ..sources.html import with_dom

Pred = Callable[[Column], Column]
# Response headers that are kept, and statuses' texts.
HEADER_KEYS = ["content-type", "server", "x-frame-options", "content-security-policy", "strict-transport-security", "cache-control", "etag", "x-robots-tag", "last-modified"]


def _attr(e: Column, name: str) -> Column:
    return e["attrs"][name]


def _low(e: Column, name: str) -> Column:
    return F.lower(F.coalesce(_attr(e, name), F.lit("")))


class Dom:
    """A page's dom column with its elements by tag, text and words.

    staged() computes those once as columns of their own; without it they are expressions over dom.
    """

    STAGED = ("a", "img", "script", "link", "meta", "iframe")

    def __init__(self, dom: Column, staged: bool = False) -> None:
        self.dom, self.staged = dom, staged
        self.text = F.col("_text") if staged else squeeze(dom["visible_text"])
        self.words = F.col("_words") if staged else words(self.text)

    def __getitem__(self, field: str) -> Column:
        return self.dom[field]

    def tag(self, name: str) -> Column:
        return F.col(f"_{name}") if self.staged and name in self.STAGED else F.filter(self.dom["els"], lambda e: e["tag"] == name)

    @classmethod
    def stage(cls, pages: DataFrame) -> tuple[DataFrame, Dom]:
        plain = cls(F.col("dom"))
        out = pages.withColumn("_text", plain.text).select("*", words(F.col("_text")).alias("_words"), *[plain.tag(t).alias(f"_{t}") for t in cls.STAGED])
        return out, cls(F.col("dom"), staged=True)


def _els(dom: Dom, tag: str, where: Pred | None = None) -> Column:
    found = dom.tag(tag)
    return found if where is None else F.filter(found, lambda e: F.coalesce(where(e), F.lit(False)))


def _count(dom: Dom, tag: str, where: Pred | None = None) -> Column:
    return F.size(_els(dom, tag, where))


def _first(dom: Dom, tag: str, where: Pred | None = None) -> Column:
    return F.get(_els(dom, tag, where), 0)


def _meta(dom: Dom, key: str, value: str) -> Column:
    """Content of the first meta with that name or property."""
    return trim(F.coalesce(_attr(_first(dom, "meta", lambda e: _attr(e, key) == value), "content"), F.lit("")))


def _rel(*values: str) -> Pred:
    return lambda e: _low(e, "rel").isin(*values)


def _rel_holds(word: str) -> Pred:
    return lambda e: F.contains(_low(e, "rel"), F.lit(word))


def seo(dom: Dom, url: Column, http: Column) -> Column:
    title = F.coalesce(_first(dom, "title", lambda e: e["in_head"])["text"], F.lit(""))
    desc = _meta(dom, "name", "description")
    host = F.coalesce(dom["page_url"]["host"], F.lit(""))
    labels = F.split(F.regexp_replace(host, r"^www\.", ""), r"\.")
    brand = F.coalesce(F.get(labels, F.greatest(F.size(labels) - 2, F.lit(0))), F.lit(""))
    levels = F.transform(F.filter(dom["els"], lambda e: e["tag"].rlike("^h[1-6]$")), lambda e: F.substring(e["tag"], 2, 1).cast("int"))
    jump = F.exists(F.sequence(F.lit(1), F.size(levels) - 1), lambda i: F.get(levels, i) > F.get(levels, i - 1) + 1)
    canonical = _first(dom, "link", _rel("canonical"))
    raw = F.coalesce(canonical["ref"], F.lit(""))
    status = F.when(raw == "", "missing").when(F.coalesce(canonical["key"] == dom["page_key"], F.lit(False)), "self").otherwise("other")
    robots, x_robots = _meta(dom, "name", "robots"), F.coalesce(http["headers"]["x-robots-tag"], F.lit(""))
    noindex = robots.rlike("(?i)noindex") | x_robots.rlike("(?i)noindex")
    path = F.coalesce(dom["page_url"]["path"], url)
    alternates = _els(dom, "link", lambda e: (_low(e, "rel") == "alternate") & _attr(e, "hreflang").isNotNull())
    langs = F.filter(F.transform(alternates, lambda e: trim(_attr(e, "hreflang"))), lambda x: x != "")
    links = F.transform(F.filter(alternates, lambda e: (trim(_attr(e, "hreflang")) != "") & e["url"].isNotNull()), lambda e: F.struct(trim(_attr(e, "hreflang")).alias("lang"), e["url"].alias("href")))
    self_ref = F.exists(alternates, lambda e: F.coalesce(e["key"] == dom["page_key"], F.lit(False)))
    return F.struct(
        title.alias("title"),
        F.length(title).alias("title_length"),
        (F.length(title) * 6).alias("title_pixel_width"),
        ((F.length(brand) > 1) & F.contains(F.lower(title), F.lower(brand))).alias("title_has_brand"),
        desc.alias("meta_description"),
        F.length(desc).alias("meta_description_length"),
        F.coalesce(_first(dom, "h1")["text"], F.lit("")).alias("h1"),
        _count(dom, "h1").alias("h1_count"),
        _count(dom, "h2").alias("h2_count"),
        _count(dom, "h3").alias("h3_count"),
        F.when(F.size(levels) < 2, True).otherwise(~jump).alias("heading_hierarchy_valid"),
        robots.alias("meta_robots"),
        x_robots.alias("x_robots_tag"),
        F.coalesce(F.when(raw != "", canonical["url"]), raw).alias("canonical_url"),
        status.alias("canonical_status"),
        (~noindex & (status != "missing") & F.coalesce(http["status_code"] == 200, F.lit(False))).alias("is_indexable"),
        F.length(url).alias("url_length"),
        F.size(segments(path)).alias("url_depth"),
        path.rlike("[A-Z]").alias("has_uppercase"),
        F.contains(path, F.lit("_")).alias("has_underscores"),
        (F.coalesce(dom["page_url"]["query"], F.lit("")) != "").alias("has_parameters"),
        trim(F.coalesce(_attr(_first(dom, "html"), "lang"), F.lit(""))).alias("html_lang"),
        langs.alias("hreflang"),
        links.alias("hreflang_links"),
        F.size(langs).alias("hreflang_count"),
        ((F.size(langs) > 0) & self_ref).alias("hreflang_self_reference"),
    )


def performance(dom: Dom, html: Column, http: Column) -> Column:
    src = href = lambda e: e["ref"]
    scripts = _els(dom, "script", lambda e: src(e) != "")
    blocking_js = F.filter(scripts, lambda e: e["in_head"] & _attr(e, "async").isNull() & _attr(e, "defer").isNull() & ~F.coalesce(_attr(e, "type") == "module", F.lit(False)))
    sheets = _els(dom, "link", lambda e: (_low(e, "rel") == "stylesheet") & (href(e) != ""))
    blocking_css = F.filter(sheets, lambda e: e["in_head"] & trim(_low(e, "media")).isin("", "all", "screen"))
    urls = lambda xs, at: F.transform(xs, lambda e: F.coalesce(e["url"], at(e)))
    kb = html_kb(html)
    return F.struct(
        http["ttfb_ms"].alias("ttfb_ms"),
        http["total_download_ms"].alias("total_download_ms"),
        http["redirect_time_ms"].alias("redirect_time_ms"),
        F.size(F.filter(http["redirect_chain"], lambda h: h["status"].between(300, 399))).alias("num_redirects"),
        kb.alias("html_size_kb"),
        kb.alias("total_page_weight_kb"),
        http["compressed"].alias("html_compressed"),
        F.size(scripts).alias("js_files_count"),
        F.size(sheets).alias("css_files_count"),
        _count(dom, "img").alias("image_count"),
        _count(dom, "link", lambda e: (_low(e, "rel") == "preload") & (_attr(e, "as") == "font")).alias("font_preloads"),
        _count(dom, "script", lambda e: src(e) == "").alias("inline_script_count"),
        _count(dom, "style").alias("inline_style_count"),
        urls(scripts, src).alias("js_file_urls"),
        urls(sheets, href).alias("css_file_urls"),
        urls(blocking_js, src).alias("render_blocking_js"),
        urls(blocking_css, href).alias("render_blocking_css"),
        (_count(dom, "img", lambda e: _attr(e, "loading") == "lazy") > 0).alias("has_lazy_loading"),
        (_count(dom, "link", _rel("preconnect")) > 0).alias("has_preconnect"),
        (_count(dom, "link", _rel("dns-prefetch")) > 0).alias("has_dns_prefetch"),
        (_count(dom, "link", _rel("preload", "prefetch", "prerender")) > 0).alias("has_resource_hints"),
        (F.size(blocking_js) + F.size(blocking_css)).alias("render_blocking_count"),
    )


def content(dom: Dom, html: Column) -> Column:
    text, listed = dom.text, dom.words
    iframes = _els(dom, "iframe")
    embeds = F.exists(iframes, lambda e: F.coalesce(_attr(e, "src"), F.lit("")).rlike(r"(?i)youtube\.com|youtu\.be|vimeo\.com"))
    return F.struct(
        F.size(listed).alias("word_count"),
        text_ratio(text, html).alias("text_html_ratio"),
        reading_level(text, listed).alias("reading_level"),
        _count(dom, "p").alias("paragraph_count"),
        (_count(dom, "table") > 0).alias("has_table"),
        ((_count(dom, "video") > 0) | embeds).alias("has_video"),
        (_count(dom, "audio") > 0).alias("has_audio"),
        (F.size(iframes) > 0).alias("has_iframe"),
        F.array_distinct(F.filter(F.transform(iframes, lambda e: F.coalesce(e["host"], F.lit(""))), lambda h: h != "")).alias("iframe_domains"),
        detect_language(text).alias("content_language"),
    )


def technical(dom: Dom, url: Column, html: Column, http: Column) -> Column:
    header = lambda k: F.coalesce(http["headers"][k], F.lit(""))
    return F.struct(
        F.lower(url).startswith("https://").alias("https"),
        F.coalesce(http["http_version"].startswith("2"), F.lit(False)).alias("http2"),
        F.substring(html, 1, 200).rlike(r"(?i)<!doctype\s+html").alias("has_doctype"),
        ((_count(dom, "meta", lambda e: _attr(e, "charset").isNotNull()) > 0) | (_count(dom, "meta", lambda e: _low(e, "http-equiv") == "content-type") > 0)).alias("has_charset"),
        (_count(dom, "meta", lambda e: _attr(e, "name") == "viewport") > 0).alias("has_viewport"),
        (_count(dom, "link", _rel("icon", "shortcut icon", "apple-touch-icon")) > 0).alias("has_favicon"),
        (_count(dom, "link", _rel("sitemap")) > 0).alias("has_sitemap_reference"),
        F.coalesce(http["content_type"], F.lit("")).alias("content_type_header"),
        header("server").alias("server_header"),
        header("x-frame-options").alias("x_frame_options"),
        header("content-security-policy").alias("content_security_policy"),
        header("strict-transport-security").alias("strict_transport_security"),
        header("cache-control").alias("cache_control"),
        header("etag").alias("etag"),
    )


def social(dom: Dom) -> Column:
    og = {k: _meta(dom, "property", f"og:{k}") for k in ("title", "description", "image", "image:width", "image:height", "type", "url")}
    full = (og["title"] != "") & (og["description"] != "") & (og["image"] != "") & (og["type"] != "") & (og["url"] != "")
    lower = F.transform(dom["schema_types"], lambda t: F.lower(t))
    has = lambda *names: F.arrays_overlap(lower, F.array(*map(F.lit, names)))
    return F.struct(
        *[og[k].alias("og_" + k.replace(":", "_")) for k in og],
        full.alias("og_complete"),
        *[_meta(dom, "name", f"twitter:{k}").alias(f"twitter_{k}") for k in ("card", "title", "description", "image")],
        ((F.size(dom["schema_types"]) > 0) | dom["microdata"]).alias("has_structured_data"),
        dom["schema_types"].alias("schema_types"),
        F.size(dom["json_ld"]).alias("schema_count"),
        has("breadcrumblist").alias("has_breadcrumb"),
        has("faqpage").alias("has_faq"),
        has("article", "newsarticle", "blogposting").alias("has_article"),
        has("product").alias("has_product"),
        has("localbusiness").alias("has_local_business"),
        dom["json_valid"].alias("json_ld_valid"),
        dom["json_ld"].alias("raw_json_ld"),
    )


def images(dom: Dom) -> Column:
    def src(e: Column) -> Column:
        return e["ref"]

    def clean(e: Column) -> Column:
        return F.lower(F.split(src(e), r"\?")[0])

    n = lambda where: _count(dom, "img", where)
    return F.struct(
        _count(dom, "img").alias("total_images"),
        n(lambda e: _attr(e, "alt").isNull()).alias("missing_alt"),
        n(lambda e: trim(_attr(e, "alt")) == "").alias("empty_alt"),
        n(lambda e: _attr(e, "width").isNull() | _attr(e, "height").isNull()).alias("missing_dimensions"),
        n(lambda e: clean(e).rlike(r"\.(webp|avif)$")).alias("next_gen_formats"),
        n(lambda e: clean(e).rlike(r"\.(jpe?g|png|gif)$")).alias("legacy_formats"),
        n(lambda e: _attr(e, "loading") == "lazy").alias("lazy_loaded"),
        n(lambda e: _attr(e, "srcset").isNotNull()).alias("with_srcset"),
        F.transform(_els(dom, "img", lambda e: src(e) != ""), lambda e: F.coalesce(e["url"], src(e))).alias("image_urls"),
    )


def links(dom: Dom) -> Column:
    def href(e: Column) -> Column:
        return e["ref"]

    def followed(e: Column) -> Column:
        h = href(e)
        return ~(F.lower(h).startswith("javascript:") | (h == "") | h.startswith("#") | h.startswith("mailto:") | h.startswith("tel:")) & e["url"].isNotNull()

    n = lambda where: _count(dom, "a", where)
    own = F.coalesce(dom["page_url"]["host"], F.lit(""))
    host = lambda e: F.coalesce(e["host"], F.lit(""))
    outside = _els(dom, "a", lambda e: followed(e) & (host(e) != own) & (host(e) != ""))
    return F.struct(
        _count(dom, "a").alias("total_links"),
        n(lambda e: followed(e) & (host(e) == own)).alias("internal_links"),
        F.size(outside).alias("external_links"),
        *[n(_rel_holds(k)).alias(k) for k in ("nofollow", "sponsored", "ugc")],
        n(lambda e: (F.coalesce(e["text"], F.lit("")) == "") & ~e["has_media"]).alias("without_anchor_text"),
        n(lambda e: href(e) == "#").alias("hash_only"),
        n(lambda e: F.lower(href(e)).startswith("javascript:")).alias("javascript_links"),
        F.array_distinct(F.transform(outside, host)).alias("external_domains"),
    )


def extracted_links(dom: Dom, root_host: Column, follow_subdomains: bool = False) -> tuple[Column, Column]:
    """(internal, external) crawl keys of a page's links, distinct, in order."""
    keys = F.array_distinct(F.transform(_els(dom, "a", lambda e: e["key"].isNotNull()), lambda e: e["key"]))
    bare = F.regexp_replace(root_host, r"^www\.", "")
    inside = lambda k: (host_of(k) == bare) | host_of(k).endswith(F.concat(F.lit("."), bare)) if follow_subdomains else host_of(k) == root_host
    return F.filter(keys, inside), F.filter(keys, lambda k: ~inside(k))


def page_features(pages: DataFrame, terminated: bool = False) -> DataFrame:
    """pages(id, url, http, html, error, ...) plus the seven feature structs and dom; html that is null or '' has none."""
    p, dom = Dom.stage(with_dom(pages, terminated=terminated))
    url, html, http = F.col("url"), F.col("html"), F.col("http")
    groups = {"seo": seo(dom, url, http), "performance": performance(dom, html, http), "content": content(dom, html), "technical": technical(dom, url, html, http), "social": social(dom), "images": images(dom), "links": links(dom)}
    return p.select(*pages.columns, "dom", *[F.when(F.col("dom").isNotNull(), x).alias(k) for k, x in groups.items()])


def url_fields(url: Column) -> dict[str, Column]:
    """Anatomy of absolute urls by plain column functions."""
    path = path_of(url)
    return {"host": host_of(url), "path": path, "depth": F.size(segments(path))}
