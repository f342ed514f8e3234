"""Sitemap generation: eligibility, url entries, numbered files and their index."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fixed1
from ..functions.urls import any_glob, glob_match, path_of
from .features import url_fields
from .ordering import write_lines

c = F.col
MAX_URLS_PER_FILE = 50_000


@dataclass(frozen=True)
class SitemapConfig:
    """Options of a sitemap; as_of stands for now, so that runs agree."""

    format: str = "xml"  # xml, xml-index, txt
    max_urls_per_file: int = MAX_URLS_PER_FILE
    include_statuses: tuple[int, ...] = (200,)
    include_non_html: bool = False
    selected_urls: tuple[str, ...] | None = None
    include_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    lastmod: str = "crawl-date"  # header, crawl-date, custom, none
    custom_lastmod: str = ""
    lastmod_format: str = "date"  # date, datetime
    changefreq: str = "auto-by-depth"  # uniform, none
    uniform_changefreq: str = "monthly"
    depth_changefreq: dict[int, str] = field(default_factory=lambda: {0: "daily", 1: "weekly", 2: "weekly", 3: "monthly"})
    priority: str = "auto-calculate"  # uniform, none
    uniform_priority: float = 0.5
    priority_overrides: tuple[tuple[str, float], ...] = ()
    hreflang: str | None = None  # auto-detect, manual-mapping
    hreflang_mappings: tuple[tuple[str, str], ...] = ()  # (language, marker in the url)
    x_default: str = ""
    images: bool = False
    max_images: int = 100
    video: bool = False
    news_patterns: tuple[str, ...] | None = None
    publication: str = ""
    language: str = "en"
    filename: str = "sitemap.xml"
    as_of: str = "2024-01-01 00:00:00"


def eligible(results: DataFrame, cfg: SitemapConfig) -> DataFrame:
    """results(id, url, status, chain_length, is_html, is_external, depth, inbound, ...) that the sitemap lists."""
    status = c("status").isin(*cfg.include_statuses)
    if 301 in cfg.include_statuses:
        status = status | (F.coalesce("chain_length", F.lit(0)) > 0)
    path = path_of(c("url"))
    keep = c("status").isNotNull() & status & ~F.coalesce("is_external", F.lit(False))
    if not cfg.include_non_html:
        keep = keep & c("is_html")
    if cfg.exclude_patterns:
        keep = keep & ~any_glob(path, list(cfg.exclude_patterns))
    if cfg.include_patterns:
        keep = keep & any_glob(path, list(cfg.include_patterns))
    out = results.where(keep)
    if cfg.selected_urls is not None:
        chosen = results.sparkSession.createDataFrame([(u,) for u in dict.fromkeys(cfg.selected_urls)], "url string")
        out = out.join(chosen, "url", "left_semi")
    return out


def lastmod(cfg: SitemapConfig, mode: str | None = None, fmt: str | None = None) -> Column:
    mode, fmt = mode or cfg.lastmod, fmt or cfg.lastmod_format
    if mode == "none":
        return F.lit(None).cast("string")
    if mode == "custom":
        return F.lit(cfg.custom_lastmod or None).cast("string")
    now = F.to_timestamp(F.lit(cfg.as_of))
    when = now if mode == "crawl-date" else F.coalesce(F.try_to_timestamp(F.regexp_replace(F.coalesce("last_modified", F.lit("")), "^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss")), now)
    return F.date_format(when, "yyyy-MM-dd") if fmt == "date" else F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def changefreq(cfg: SitemapConfig) -> Column:
    """By depth: the value of the deepest key that is not deeper, else monthly."""
    if cfg.changefreq == "none":
        return F.lit(None).cast("string")
    if cfg.changefreq == "uniform":
        return F.lit(cfg.uniform_changefreq)
    out = F.lit("monthly")
    for k in sorted(cfg.depth_changefreq):
        out = F.when(F.coalesce("depth", F.lit(0)) >= k, cfg.depth_changefreq[k]).otherwise(out)
    return out


def auto_priority(depth: int, tens: int) -> str:
    """1 less 0.15 a level plus 0.1 for ten links in, within 0.1 and 1, with one decimal of the binary value."""
    return fixed1(max(0.1, min(1.0, 1.0 - depth * 0.15 + tens * 0.1)))


def _one_decimal(x: Column) -> Column:
    """x in [0, 1] with one decimal of its binary value; a middle that lies above the true one in binary goes up."""
    middles = [(2 * i + 1) / 20 for i in range(10)]
    tenths = sum((F.when((x >= m) if Fraction(m) >= Fraction(2 * i + 1, 20) else (x > m), 1).otherwise(0) for i, m in enumerate(middles)), F.lit(0))
    return F.concat((tenths >= 10).cast("int").cast("string"), F.lit("."), (tenths % 10).cast("string"))


def priority(cfg: SitemapConfig) -> Column:
    if cfg.priority == "none":
        return F.lit(None).cast("string")
    if cfg.priority == "uniform":
        return F.lit(fixed1(cfg.uniform_priority))
    d, t = F.coalesce("depth", F.lit(0)).cast("double"), F.floor(F.coalesce("inbound", F.lit(0)) / 10).cast("double")
    out = _one_decimal(F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.lit(1.0) - d * 0.15 + t * 0.1)))
    path = path_of(c("url"))
    for pattern, p in reversed(cfg.priority_overrides):
        out = F.when(glob_match(path, pattern), fixed1(max(0.0, min(1.0, p)))).otherwise(out)
    return out


def escape_xml(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def alternates(cfg: SitemapConfig) -> Column:
    """Array of (lang, href): the page's own links, or its url with the first marker it holds swapped for each other."""
    kind = "array<struct<lang:string,href:string>>"
    if cfg.hreflang is None:
        return F.array().cast(kind)
    if cfg.hreflang == "auto-detect":
        return F.coalesce(c("hreflang_links"), F.array().cast(kind))
    out = F.array().cast(kind)
    for _, marker in reversed(cfg.hreflang_mappings):
        swapped = [(lang, m) for lang, m in cfg.hreflang_mappings] + [("x-default", m) for lang, m in cfg.hreflang_mappings if cfg.x_default and lang == cfg.x_default][:1]
        links = F.array(*[F.struct(F.lit(lang).alias("lang"), F.replace(c("url"), F.lit(marker), F.lit(m)).alias("href")) for lang, m in swapped])
        out = F.when(F.contains("url", F.lit(marker)), links).otherwise(out)
    return out


def entries(results: DataFrame, cfg: SitemapConfig) -> DataFrame:
    """(id, url, lastmod, changefreq, priority, entry) of eligible results."""
    e = eligible(results, cfg).select("*", lastmod(cfg).alias("lastmod"), changefreq(cfg).alias("changefreq"), priority(cfg).alias("priority"))
    tag = lambda name: F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit(f"    <{name}>"), c(name), F.lit(f"</{name}>")))
    parts = [F.lit("  <url>"), F.concat(F.lit("    <loc>"), escape_xml(c("url")), F.lit("</loc>")), tag("lastmod"), tag("changefreq"), tag("priority")]
    lists = [F.array_compact(F.array(*parts))]
    if cfg.hreflang:
        lists.append(F.transform(alternates(cfg), lambda a: F.concat(F.lit('    <xhtml:link rel="alternate" hreflang="'), escape_xml(a["lang"]), F.lit('" href="'), escape_xml(a["href"]), F.lit('"/>'))))
    if cfg.images:
        lists.append(F.transform(F.slice(F.coalesce("image_urls", F.array().cast("array<string>")), 1, cfg.max_images), lambda u: F.concat(F.lit("    <image:image><image:loc>"), escape_xml(u), F.lit("</image:loc></image:image>"))))
    if cfg.news_patterns is not None:
        date = lastmod(cfg, "header", "datetime")
        news = F.concat(F.lit("    <news:news><news:publication><news:name>"), escape_xml(F.lit(cfg.publication)), F.lit("</news:name><news:language>"), escape_xml(F.lit(cfg.language)), F.lit("</news:language></news:publication><news:publication_date>"), date, F.lit("</news:publication_date><news:title>"), escape_xml(F.coalesce("title", F.lit(""))), F.lit("</news:title></news:news>"))
        lists.append(F.array_compact(F.array(F.when(any_glob(path_of(c("url")), list(cfg.news_patterns)), news))))
    lists.append(F.array(F.lit("  </url>")))
    return e.select("id", "url", "lastmod", "changefreq", "priority", F.array_join(F.concat(*lists), "\n").alias("entry"))


def _namespaces(cfg: SitemapConfig) -> str:
    ns = ['xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"']
    if cfg.hreflang:
        ns.append('xmlns:xhtml="http://www.w3.org/1999/xhtml"')
    if cfg.images:
        ns.append('xmlns:image="http://www.google.com/schemas/sitemap-image/1.1"')
    if cfg.video:
        ns.append('xmlns:video="http://www.google.com/schemas/sitemap-video/1.1"')
    if cfg.news_patterns is not None:
        ns.append('xmlns:news="http://www.google.com/schemas/sitemap-news/0.9"')
    return "\n        ".join(ns)


def numbered(rows: DataFrame, per_file: int) -> DataFrame:
    """rows plus chunk, from 1, in order of id: positions are counted per range of ids and added up, so no task orders all rows."""
    spread = rows.withColumn("_b", F.shiftright(c("id").cast("long"), 10))
    counts = spread.groupBy("_b").agg(F.count("*").alias("_n"))
    before = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - c("_n")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_b").orderBy("id"))
    placed = spread.join(before, "_b").withColumn("_at", c("_before") + inner - 1)
    return placed.withColumn("chunk", (F.floor(c("_at") / per_file) + 1).cast("int")).withColumn("position", c("_at").cast("long")).drop("_b", "_before", "_at")


def files(results: DataFrame, cfg: SitemapConfig) -> DataFrame:
    """(name, content, url_count) of the sitemap's files; an index comes first where there are several."""
    spark = results.sparkSession
    listed = entries(results, cfg)
    total = listed.count()
    base = re.sub(r"\.xml(\.gz)?$", "", cfg.filename, flags=re.IGNORECASE)
    per_file = max(1, min(cfg.max_urls_per_file, MAX_URLS_PER_FILE))
    ordered = lambda col, sep: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", col))), lambda x: x[col]), sep)
    if cfg.format == "txt":  # one file, in pieces of at most MAX_URLS_PER_FILE lines; larger ones are better written by write_text
        pieces = numbered(listed, MAX_URLS_PER_FILE).groupBy("chunk").agg(F.count("*").alias("url_count"), ordered("url", "\n").alias("t"))
        return pieces.select(F.lit(f"{base}.txt").alias("name"), F.concat("t", F.lit("\n")).alias("content"), "url_count", c("chunk").alias("piece"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<urlset {_namespaces(cfg)}>\n'
    body = lambda col: F.concat(F.lit(head), col, F.lit("\n</urlset>\n"))
    if cfg.format != "xml-index" and total <= per_file:
        return listed.agg(F.count("*").alias("url_count"), ordered("entry", "\n").alias("t")).select(F.lit(f"{base}.xml").alias("name"), body(c("t")).alias("content"), "url_count")
    chunks = numbered(listed, per_file).groupBy("chunk").agg(F.count("*").alias("url_count"), ordered("entry", "\n").alias("t"))
    parts = chunks.select(F.concat(F.lit(f"{base}-"), c("chunk").cast("string"), F.lit(".xml")).alias("name"), body(c("t")).alias("content"), "url_count")
    first = listed.orderBy("id").select("url").first()
    origin = re.sub(r"^([a-z]+://[^/?#]*).*$", r"\1", first.url) if first else ""
    count = -(-total // per_file)
    rows = "\n".join(f"  <sitemap>\n    <loc>{origin}/{base}-{k}.xml</loc>\n    <lastmod>{cfg.as_of[:10]}</lastmod>\n  </sitemap>" for k in range(1, count + 1))
    index = f'<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n{rows}\n</sitemapindex>\n'
    return spark.createDataFrame([(f"{base}-index.xml", index, 0)], "name string, content string, url_count long").unionByName(parts)


def write_text(results: DataFrame, cfg: SitemapConfig, path: str) -> str:
    """Eligible urls as lines of text files that join in order of id: tasks write ranges, no row or task holds all."""
    return write_lines(eligible(results, cfg).select("id", "url", c("url").alias("line")), ["id", "url"], path)


def warnings(results: DataFrame, cfg: SitemapConfig) -> list[str]:
    n, long = eligible(results, cfg).agg(F.count("*"), F.count_if(F.length("url") > 2048)).first()
    return (["No URLs match the current selection."] if n == 0 else []) + ([f"{long} URL(s) exceed 2048 characters."] if long else [])


def preview_checks(content: DataFrame) -> DataFrame:
    """(name, duplicates, well_formed, bytes) of generated files."""
    locs = F.regexp_extract_all("content", F.lit(r"<loc>([^<]*)</loc>"), F.lit(1))
    return content.select("name", (F.size(locs) - F.size(F.array_distinct(locs))).alias("duplicates"), F.trim("content").startswith("<?xml").alias("well_formed"), F.octet_length("content").alias("bytes"))


def results_of(audited: DataFrame) -> DataFrame:
    """Sitemap inputs of audited rows; depth is the path's where no crawl gave one."""
    u = url_fields(c("url"))
    spider = "spider" in audited.columns
    return audited.select(
        "id", "url", c("http.status_code").alias("status"), F.size("http.redirect_chain").alias("chain_length"), c("seo").isNotNull().alias("is_html"), (c("spider.is_external") if spider else F.lit(False)).alias("is_external"),
        (c("spider.depth") if spider else u["depth"]).alias("depth"), (c("spider.inbound_internal") if spider else F.lit(0)).alias("inbound"), c("http.headers")["last-modified"].alias("last_modified"), c("seo.title").alias("title"), c("seo.hreflang_links").alias("hreflang_links"), c("images.image_urls").alias("image_urls"),
    )
