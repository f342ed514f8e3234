"""Fetch rows: pages joined to http facts, and a derived deterministic log where none was recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HTTP = "struct<status_code:int,status_text:string,redirect_chain:array<struct<url:string,status:int>>,ttfb_ms:int,total_download_ms:int,redirect_time_ms:int,content_type:string,content_length_kb:double,http_version:string,compressed:boolean,headers:map<string,string>>"

# Reason phrases used where a server gave none.
STATUS_TEXT = {200: "OK", 201: "Created", 204: "No Content", 301: "Moved Permanently", 302: "Found", 303: "See Other", 304: "Not Modified", 307: "Temporary Redirect", 308: "Permanent Redirect", 400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 410: "Gone", 429: "Too Many Requests", 500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout"}
MAX_REDIRECTS, MAX_BODY_BYTES = 10, 5 * 1024 * 1024


def status_text(code: Column, given: Column | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in STATUS_TEXT.items() for x in (k, v)])
    known = F.coalesce(F.try_element_at(table, code), F.lit(""))
    return known if given is None else F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(known)


def keep_headers(headers: Column) -> Column:
    """Headers that an audit uses, by lower-case name."""
    from ..operators.features import HEADER_KEYS

    return F.map_filter(F.transform_keys(headers, lambda k, _: F.lower(k)), lambda k, _: k.isin(HEADER_KEYS))


def content_length_kb(header: Column, body: Column) -> Column:
    size = F.coalesce(header.try_cast("double"), F.nullif(F.octet_length(body).cast("double"), F.lit(0.0)))
    return F.floor(size / 1024 * 100 + 0.5) / 100


def simulated(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> (id, url, html, http, error): facts are integer arithmetic on page_id."""
    i = F.col("page_id")
    status = F.when(i % 37 == 0, F.lit(None)).when(i % 29 == 0, 500).when(i % 17 == 0, 404).when(i % 23 == 0, 301).otherwise(200).cast("int")
    hop = F.struct(F.col("url").alias("url"), F.lit(301).alias("status"))
    last = F.struct(F.concat(F.lit("https://final.example.net/"), i.cast("string")).alias("url"), F.coalesce(status, F.lit(0)).alias("status"))
    chain = F.when(i % 13 == 0, F.array(hop, hop, last)).when(i % 7 == 0, F.array(hop, last)).otherwise(F.array().cast("array<struct<url:string,status:int>>"))
    headers = F.map_from_arrays(
        F.array(F.lit("server"), F.lit("strict-transport-security"), F.lit("x-robots-tag")),
        F.array(F.lit("sim"), F.when(i % 3 == 0, "max-age=1").otherwise(""), F.when(i % 19 == 0, "noindex").otherwise("")),
    )
    http = F.struct(
        status.alias("status_code"),
        status_text(status).alias("status_text"),
        chain.alias("redirect_chain"),
        (i * 7919 % 3000).cast("int").alias("ttfb_ms"),
        (i * 104729 % 5000).cast("int").alias("total_download_ms"),
        F.when(F.size(chain) > 0, i * 31 % 900).otherwise(0).cast("int").alias("redirect_time_ms"),
        F.lit("text/html").alias("content_type"),
        content_length_kb(F.lit(None).cast("string"), F.col("html")).alias("content_length_kb"),
        F.when(i % 2 == 0, "2.0").otherwise("1.1").alias("http_version"),
        (i % 5 != 0).alias("compressed"),
        headers.alias("headers"),
    ).cast(HTTP)
    return pages.select(i.cast("long").alias("id"), "url", F.when(status.isNotNull(), F.col("html")).alias("html"), http.alias("http"), F.when(status.isNull(), "Timeout").alias("error"))


def redirect_summary(http: Column) -> Column:
    """(status, target) of pages reached over redirects: the first 3xx hop's status, the last url; else null."""
    chain = http["redirect_chain"]
    hop = F.get(F.filter(chain, lambda h: h["status"].between(300, 399)), 0)
    return F.when(F.size(chain) > 0, F.struct(F.coalesce(hop["status"], F.get(chain, 0)["status"]).alias("status"), F.element_at(chain, -1)["url"].alias("target")))


def fetch_rows(raw: DataFrame) -> DataFrame:
    """Recorded fetches (id, url, status_code, error, headers, html, ...) as (id, url, html, http, error): bodies only of html, capped."""
    html = F.when(F.lower(F.coalesce("content_type", F.lit(""))).contains("text/html") & F.col("error").isNull(), F.col("html"))
    kept, low = keep_headers(F.col("headers")), F.transform_keys("headers", lambda k, _: F.lower(k))
    length, encoding = low["content-length"], F.lower(F.coalesce(low["content-encoding"], F.lit("")))
    http = F.struct(
        F.when(F.col("error").isNull(), F.col("status_code")).alias("status_code"),
        F.when(F.col("error").isNotNull(), "Error").otherwise(status_text(F.col("status_code"), F.col("status_text"))).alias("status_text"),
        "redirect_chain", "ttfb_ms", "total_download_ms", "redirect_time_ms", "content_type",
        content_length_kb(length, html).alias("content_length_kb"),
        "http_version", (~encoding.isin("", "identity")).alias("compressed"), kept.alias("headers"),
    )
    return raw.select("id", "url", html.alias("html"), http.cast(HTTP).alias("http"), "error")
