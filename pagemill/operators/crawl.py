"""Breadth-first crawl over a link table: gates, levels, caps and first discoverers, as joins level by level."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import any_glob, path_of
from .storage import shared_dir

c = F.col


def gate(url: Column, depth: Column, include: list[str], exclude: list[str], robots: Column | None = None) -> Column:
    """Whether a url is crawled: depth 0 always; else not excluded, included if there are includes, and allowed by robots."""
    path = path_of(url)
    ok = ~any_glob(path, exclude) if exclude else F.lit(True)
    if include:
        ok = ok & any_glob(path, include)
    if robots is not None:
        ok = ok & robots
    return (depth == 0) | ok


def _written(df: DataFrame, base: str, level: int) -> DataFrame:
    path = f"{base}/level-{level}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crawl(links: DataFrame, start: str, max_depth: int = 5, max_pages: int = 500, include: list[str] = (), exclude: list[str] = (), rejected: DataFrame | None = None, work_dir: str | None = None) -> DataFrame:
    """links(source, link_idx, target) -> (url, depth, seq, discovered_from, crawled) in order of discovery.

    Of several pages that link to a new url, the first in crawl order discovers it; discovery stops at max_pages
    urls, and a url that the gates reject keeps its place but is not followed. rejected(url): urls that
    robots forbid. Each level is written to the shared folder.
    """
    spark = links.sparkSession
    base = work_dir or f"{shared_dir(spark)}/crawl-{uuid.uuid4().hex}"
    forbidden = rejected.select("url").distinct().withColumn("forbidden", F.lit(True)) if rejected is not None else None

    def gated(df: DataFrame) -> DataFrame:
        if forbidden is not None:
            df = df.join(forbidden, "url", "left")
            robots = ~F.coalesce("forbidden", F.lit(False))
        else:
            robots = None
        return df.select("url", "depth", "seq", "discovered_from", gate(c("url"), c("depth"), list(include), list(exclude), robots).alias("crawled"))

    first = spark.createDataFrame([(start, 0, 0, "")], "url string, depth int, seq long, discovered_from string")
    frontier = _written(gated(first), base, 0)
    known, total = frontier, 1
    for depth in range(1, max_depth + 1):
        if total >= max_pages:
            break
        out = frontier.where("crawled").select(c("url").alias("source"), c("seq").alias("parent"))
        found = links.join(out, "source").select(c("target").alias("url"), "parent", "link_idx", "source")
        new = found.groupBy("url").agg(F.min(F.struct("parent", "link_idx", "source")).alias("f")).join(known.select("url"), "url", "left_anti")
        # the cap keeps the first of the level: a bounded, ordered prefix
        new = new.orderBy("f.parent", "f.link_idx", "url").limit(max_pages - total)
        # at most max_pages rows are left to number
        new = new.select("url", F.lit(depth).alias("depth"), (F.row_number().over(Window.orderBy("f.parent", "f.link_idx", "url")) + total - 1).cast("long").alias("seq"), c("f.source").alias("discovered_from"))
        frontier = _written(gated(new), base, depth)
        n = frontier.count()
        if n == 0:
            break
        known, total = known.unionByName(frontier), total + n
    return known


def reach(links: DataFrame, start: str, max_depth: int, work_dir: str | None = None) -> DataFrame:
    """(url, depth) of all that can be reached, without a cap or an order of discovery."""
    spark = links.sparkSession
    base = work_dir or f"{shared_dir(spark)}/crawl-{uuid.uuid4().hex}"
    edges = links.select("source", "target").distinct()
    frontier = _written(spark.createDataFrame([(start, 0)], "url string, depth int"), base, 0)
    known = frontier
    for depth in range(1, max_depth + 1):
        new = edges.join(frontier.select(c("url").alias("source")), "source", "left_semi").select(c("target").alias("url")).distinct()
        frontier = _written(new.join(known, "url", "left_anti").select("url", F.lit(depth).alias("depth")), base, depth)
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def spider_meta(crawled: DataFrame, pages: DataFrame) -> DataFrame:
    """Spider columns of crawled pages: pages(url, internal_links, external_links, last_modified, path_group)."""
    return crawled.where("crawled").join(pages, "url").select(
        "url", F.struct("depth", "discovered_from", "internal_links", "external_links", F.lit(False).alias("is_external"), F.coalesce("last_modified", F.lit("")).alias("last_modified"), F.size("internal_links").alias("outbound_internal"), F.size("external_links").alias("outbound_external"), (F.size("internal_links") == 0).alias("is_dead_end"), "path_group").alias("spider")
    )
