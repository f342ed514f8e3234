"""Sitemaps in: documents to urls and nested sitemaps, index trees as a frontier of documents.

The order of a tree is depth first, each document where it is met first, and at most MAX_SITEMAPS are read. Level by
level that order is a key: the positions on the way from the first document, compared from the left. A document's key
is the least of its ways that meet no document twice (which is the way depth-first search takes), and ways
through documents that are not among the first MAX_SITEMAPS keys so far cannot lead to one that is.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import shared_dir

#: Sitemaps of one index tree that are read; further ones are left out.
MAX_SITEMAPS = 50
INVALID = "File is not a valid XML sitemap."
NO_URLS = "Sitemap contained no URLs."


def is_valid(xml: Column) -> Column:
    return F.contains(xml, F.lit("<urlset")) | F.contains(xml, F.lit("<sitemapindex")) | F.ltrim(xml).startswith("<?xml")


def _locs(xml: Column, path: str) -> Column:
    return F.filter(F.transform(F.xpath(xml, F.lit(path)), lambda x: F.trim(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))), lambda x: x != "")


def parse_documents(docs: DataFrame) -> DataFrame:
    """docs(name, xml) -> (name, urls, nested): locations of a urlset and of an index, blank ones dropped."""
    known = F.contains("xml", F.lit("<urlset")) | F.contains("xml", F.lit("<sitemapindex"))
    none = F.array().cast("array<string>")
    return docs.select("name", F.when(known, _locs(F.col("xml"), "urlset/url/loc/text()")).otherwise(none).alias("urls"), F.when(known, _locs(F.col("xml"), "sitemapindex/sitemap/loc/text()")).otherwise(none).alias("nested"))


def _text(name: str, raw: bytes) -> tuple[str | None, str | None]:
    """(text, error) of a document: gzipped by ending or magic number."""
    try:
        packed = name.lower().endswith(".gz") or raw[:2] == b"\x1f\x8b"
        return (zlib.decompress(raw, 31) if packed else raw).decode("utf-8", "replace"), None
    except zlib.error as problem:
        return None, str(problem)


def decoded(files: DataFrame) -> DataFrame:
    """files(name, content, error) -> (name, xml, error)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(None, e) if e is not None else _text(n, raw or b"") for n, raw, e in zip(*[x.to_pylist() for x in b.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], names=["name", "xml", "error"])

    return files.select("name", "content", "error").mapInArrow(run, "name string, xml string, error string")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, xml) of files, gzipped ones by ending or magic number; one that cannot be unpacked is an error."""
    got = decoded(spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), "content", F.lit(None).cast("string").alias("error")))
    return got.select("name", F.when(F.col("error").isNotNull(), F.raise_error(F.concat("name", F.lit(": "), "error"))).otherwise(F.col("xml")).alias("xml"))


class Sitemap(NamedTuple):
    """urls(at array<int>, url): distinct, at is their place in depth-first order."""

    urls: DataFrame
    sitemap_count: int
    error: str | None


def resolve_tree(spark: SparkSession, start: str, fetch: Callable[[DataFrame], DataFrame], first: str | None = None, most: int = MAX_SITEMAPS, folder: str | None = None) -> Sitemap:
    """Urls of a sitemap or index tree; a failure of any document that is read makes the result empty with its error.

    fetch: (id, url) -> (id, url, content, error), as http.fetch_bytes; each document is asked for once. first: the
    text of the start document where it is at hand. Each level of documents is a written table.
    """
    base = folder or f"{shared_dir(spark)}/sitemap-{uuid.uuid4().hex}"
    c, none = F.col, F.array().cast("array<int>")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    def read(names: DataFrame, level: int) -> DataFrame:
        if level == 0 and first is not None:
            texts = names.select("name", F.lit(first).alias("xml"), F.lit(None).cast("string").alias("error"))
        else:
            got = fetch(names.select(F.xxhash64("name").alias("id"), c("name").alias("url")))
            texts = decoded(got.select(c("url").alias("name"), "content", "error"))
        wrong = F.when(c("error").isNull() & ~F.coalesce(is_valid(c("xml")), F.lit(False)), F.concat(F.lit("Invalid sitemap XML at "), "name"))
        texts = kept(texts.withColumn("error", F.coalesce("error", wrong)), f"texts/level={level}")
        parsed = parse_documents(texts.where("error is null"))
        return texts.select("name", "error").join(parsed, "name", "left")

    known = kept(spark.createDataFrame([(start, [], [start])], "name string, key array<int>, trail array<string>"), "known-0")
    docs: DataFrame | None = None
    level = 0
    while True:
        top = known.orderBy("key").limit(most)
        todo = top if docs is None else top.join(docs, "name", "left_anti")
        fresh = kept(read(todo.select("name"), level), f"documents/level={level}")
        asked = fresh.count()
        docs = fresh if docs is None else docs.unionByName(fresh)
        ways = top.join(docs, "name").select(c("key"), c("trail"), F.posexplode("nested").alias("at", "child")).where(~F.array_contains("trail", c("child")))
        ways = ways.select(c("child").alias("name"), F.array_append("key", c("at")).alias("key"), F.array_append("trail", c("child")).alias("trail"))
        best = known.unionByName(ways).groupBy("name").agg(F.min(F.struct("key", "trail")).alias("w")).select("name", "w.key", "w.trail")
        level += 1
        best = kept(best, f"known-{level}")
        moved = not best.select("name", "key").exceptAll(known.select("name", "key")).isEmpty()
        known = best
        if not asked and not moved:
            break
    listed = known.orderBy("key").limit(most).select("name", "key").join(docs, "name")
    failed = listed.where("error is not null").orderBy("key").select("error").first()
    if failed:
        return Sitemap(spark.createDataFrame([], "at array<int>, url string"), 0, failed.error)
    places = listed.select("key", F.posexplode("urls").alias("i", "url"))
    # a document's own urls come before those of its nested ones: -1 is before any position
    places = places.select("url", F.concat(F.coalesce("key", none), F.array(F.lit(-1), c("i"))).alias("at"))
    return Sitemap(places.groupBy("url").agg(F.min("at").alias("at")).select("at", "url"), listed.count(), None)


def _from_texts(fetch: Callable[[str], str]) -> Callable[[DataFrame], DataFrame]:
    """Fetch of a table from one of a text; what it raises is a row's error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content, errors = [], []
            for url in b.column(1).to_pylist():
                try:
                    content.append(fetch(url).encode())
                    errors.append(None)
                except Exception as problem:  # the contract of this source: an error is a result
                    content.append(None)
                    errors.append(str(problem) or type(problem).__name__)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(content, pa.binary()), pa.array(errors, pa.string())], names=["id", "url", "content", "error"])

    return lambda df: df.mapInArrow(run, "id long, url string, content binary, error string")


def resolve(spark: SparkSession, start: str, fetch: Callable[[str], str], first: str | None = None) -> dict:
    """resolve_tree() with a fetch of one text, its urls as a list: for trees that a caller can hold."""
    try:
        got = resolve_tree(spark, start, _from_texts(fetch), first)
        return {"urls": [r.url for r in got.urls.orderBy("at").collect()], "sitemap_count": got.sitemap_count, "error": got.error}
    except PySparkException as problem:  # a document that is no XML
        return {"urls": [], "sitemap_count": 0, "error": str(problem)}


def read_file(spark: SparkSession, path: str, fetch: Callable[[str], str] | None = None) -> dict:
    """Urls of a sitemap file; nested sitemaps are fetched."""
    row = read_documents(spark, path).first()
    if not spark.createDataFrame([(row.xml,)], "xml string").select(is_valid(F.col("xml"))).first()[0]:
        return {"urls": [], "sitemap_count": 0, "error": INVALID}

    def remote(at: str) -> str:
        raise ValueError(f"{at} is remote")

    return resolve(spark, path, fetch or remote, row.xml)
