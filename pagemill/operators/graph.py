"""Link graph: edges, degrees, orphans, metadata, and its view filter."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def node_type(status: Column, chain_length: Column) -> Column:
    return F.when(status.isNull() | (status >= 400), "error").when((status >= 300) | (chain_length > 0), "redirect").otherwise("page")


def build_edges(results: DataFrame, include_external: bool = False) -> DataFrame:
    """(source, target, type) of results(url, internal_links, external_links): internal ones end in other crawled pages."""
    links = results.select(c("url").alias("source"), F.explode("internal_links").alias("target")).where("source <> target")
    edges = links.join(results.select(c("url").alias("target")).distinct(), "target", "left_semi").select("source", "target", F.lit("internal").alias("type"))
    if include_external:
        edges = edges.unionByName(results.select(c("url").alias("source"), F.explode("external_links").alias("target"), F.lit("external").alias("type")))
    return edges


def build_nodes(results: DataFrame, edges: DataFrame, include_external: bool = False) -> DataFrame:
    """Nodes with degrees; results(id, url, depth, status, health_score, title, chain_length, outbound_internal, path_group). External ones have depth -1 and no degrees."""
    inbound = edges.where("type = 'internal'").select("source", "target").distinct().groupBy("target").agg(F.count("*").alias("in_degree"))
    nodes = results.join(inbound, results["url"] == inbound["target"], "left").select(
        "id", "url", "depth", "status", "health_score", F.coalesce("title", F.lit("")).alias("title"), node_type(c("status"), c("chain_length")).alias("type"),
        F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"), c("outbound_internal").cast("long").alias("out_degree"), c("path_group").alias("group"),
    )
    nodes = nodes.withColumn("is_orphan", (c("in_degree") == 0) & (c("depth") != 0)).withColumn("is_dead_end", c("out_degree") == 0)
    if include_external:
        outside = edges.where("type = 'external'").select("target").distinct()
        nodes = nodes.unionByName(outside.select(F.lit(None).cast(nodes.schema["id"].dataType).alias("id"), c("target").alias("url"), F.lit(-1).alias("depth"), F.lit(None).cast(nodes.schema["status"].dataType).alias("status"), F.lit(0).alias("health_score"), F.lit("").alias("title"), F.lit("external").alias("type"), F.lit(0).cast("long").alias("in_degree"), F.lit(0).cast("long").alias("out_degree"), F.lit("external").alias("group"), F.lit(False).alias("is_orphan"), F.lit(False).alias("is_dead_end")))
    return nodes


def parents(edges: DataFrame, results: DataFrame) -> DataFrame:
    """(url, parents): distinct sources of a page in crawl order."""
    order = results.select(c("url").alias("source"), "id")
    named = edges.where("type = 'internal'").select("source", "target").distinct().join(order, "source")
    return named.groupBy(c("target").alias("url")).agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "source"))), lambda s: s["source"]).alias("parents"))


def metadata(nodes: DataFrame, edges: DataFrame, root_url: str) -> DataFrame:
    """One row; the most linked page is the first of those with the highest in-degree."""
    inside = F.when(c("type") != "external", True)
    best = F.max(F.when(c("type") != "external", F.struct(c("in_degree"), (-c("id")).alias("back"), c("url"))))
    row = nodes.agg(
        F.count("*").alias("total_nodes"), F.coalesce(F.max(F.when(inside, c("depth"))), F.lit(0)).cast("long").alias("max_depth"),
        F.coalesce(F.floor(F.avg(F.when(inside, F.greatest(c("depth"), F.lit(0)))) * 10 + 0.5) / 10, F.lit(0.0)).alias("avg_depth"),
        F.count_if(inside).alias("internal_count"), F.count_if(c("type") == "external").alias("external_count"), best.alias("b"),
        F.count_if(inside & c("is_orphan")).alias("orphans"), F.count_if(inside & c("is_dead_end")).alias("dead_ends"),
    )
    counted = edges.agg(F.count("*").alias("total_edges"))
    # both sides are one row
    return row.select("*", F.lit(1).alias("k")).join(counted.select("*", F.lit(1).alias("k")), "k").select(
        F.lit(root_url).alias("root_url"), "total_nodes", "total_edges", "max_depth", "avg_depth", "internal_count", "external_count", c("b.url").alias("most_linked_url"), c("b.in_degree").alias("most_linked_in_degree"), "orphans", "dead_ends"
    )


def view(nodes: DataFrame, edges: DataFrame, search: str = "", depth_max: int = 10, health_min: int = 0, statuses: tuple[str, ...] = ("2xx", "3xx", "4xx", "5xx"), min_in_degree: int = 0, show_external: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that a view shows; external nodes obey show_external alone, the root no in-degree."""
    s = c("status")
    group = F.when(s >= 500, "5xx").when(s >= 400, "4xx").when(s >= 300, "3xx").otherwise("2xx")
    q = search.strip().lower()
    inside = (c("depth") <= depth_max) & (c("health_score") >= health_min) & (s.isNull() | group.isin(*statuses)) & ((c("in_degree") >= min_in_degree) | (c("depth") == 0))
    if q:
        inside = inside & (F.contains(F.lower("url"), F.lit(q)) | F.contains(F.lower("title"), F.lit(q)))
    shown = nodes.where(F.when(c("type") == "external", F.lit(show_external)).otherwise(inside))
    ids = shown.select("url")
    kept = edges.join(ids.withColumnRenamed("url", "source"), "source", "left_semi").join(ids.withColumnRenamed("url", "target"), "target", "left_semi")
    return shown, kept.select("source", "target", "type")


#: Centre and radii by depth of the small preview.
CENTRE, RADII = (150.0, 100.0), (0.0, 55.0, 92.0)


def preview(nodes: DataFrame, k: int = 80, depth: int = 2) -> DataFrame:
    """The first k nodes within depth, each at its place in the ring of its depth: rings are shared out evenly, in order of arrival."""
    near = nodes.where((c("depth").between(0, depth)) & (c("type") != "external")).orderBy("id").limit(k)
    ring = Window.partitionBy("depth")  # k rows at most
    turn = (F.row_number().over(ring.orderBy("id")) - 1) / F.count("*").over(ring) * (2 * math.pi)
    radius = F.element_at(F.array(*[F.lit(r) for r in RADII]), F.least(c("depth"), F.lit(len(RADII) - 1)) + 1)
    return near.withColumn("x", CENTRE[0] + radius * F.cos(turn)).withColumn("y", CENTRE[1] + radius * F.sin(turn))


def preview_edges(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(x1, y1, x2, y2, source, target) of edges between points."""
    at = F.broadcast(points.select("url", "x", "y"))  # the preview's rows
    a, b = at.toDF("source", "x1", "y1"), at.toDF("target", "x2", "y2")
    return edges.join(a, "source").join(b, "target").select("source", "target", "x1", "y1", "x2", "y2")


def derived_results(audited: DataFrame, n: int) -> DataFrame:
    """Results for graphs over pages that do not link to each other: links by arithmetic on id among n pages, depth 0 for id 0."""
    i = c("id")
    target = lambda e: F.concat(F.lit("p"), F.pmod(e, F.lit(n)).cast("string"))
    linked = F.when(i % 11 == 10, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(target(i * 3 + 1), target(i * 7 + 2))))
    return audited.select(
        i, F.concat(F.lit("p"), i.cast("string")).alias("url"), F.when(i == 0, 0).otherwise(1 + i % 4).cast("int").alias("depth"), c("http.status_code").alias("status"), "health_score", c("seo.title").alias("title"), F.size("http.redirect_chain").alias("chain_length"),
        linked.alias("internal_links"), F.when(i % 5 == 0, F.array(F.concat(F.lit("x"), (i % 15).cast("string")))).otherwise(F.array().cast("array<string>")).alias("external_links"), F.size(linked).alias("outbound_internal"), F.lit("/g").alias("path_group"),
    )
