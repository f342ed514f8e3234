"""Aggregates of an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import empty
from .rules import CATEGORIES
from .scoring import count_severity
from .views import has_issue, status_group

c = F.col


def summary(audited: DataFrame) -> DataFrame:
    """One row of counts and means."""
    group = status_group(c("http.status_code"))
    seo = c("seo")
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    mean = lambda x: F.coalesce(F.floor(F.avg(x) + 0.5), F.lit(0)).cast("long")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return audited.agg(
        F.count("*").alias("total"),
        *[n(group == g).alias(a) for g, a in (("2xx", "status_2xx"), ("3xx", "status_3xx"), ("4xx", "status_4xx"), ("5xx", "status_5xx"), ("errors", "errors"))],
        mean("http.ttfb_ms").alias("avg_ttfb_ms"),
        mean("health_score").alias("avg_health"),
        total("total_issues").alias("total_issues"),
        total("critical_issues").alias("critical_issues"),
        n(seo.isNotNull() & empty(seo["title"])).alias("missing_title"),
        n(seo.isNotNull() & empty(seo["meta_description"])).alias("missing_meta_description"),
        n(seo["h1_count"] == 0).alias("missing_h1"),
        n(has_issue("duplicateTitle")).alias("duplicate_titles"),
        n(has_issue("duplicateDescription")).alias("duplicate_descriptions"),
        total("images.missing_alt").alias("images_missing_alt_total"),
        n(~seo["is_indexable"]).alias("not_indexable"),
    )


def issues_by_category(audited: DataFrame) -> DataFrame:
    """(category, critical, warning) for all seven categories."""
    counts = [F.coalesce(F.sum(count_severity(c("issues"), s, k)), F.lit(0)).cast("long").alias(f"{k}_{s}") for k in CATEGORIES for s in ("critical", "warning")]
    row = audited.agg(*counts)
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.col(f"{k}_critical").alias("critical"), F.col(f"{k}_warning").alias("warning")) for k in CATEGORIES])).alias("r")).select("r.*")


def worst(audited: DataFrame, k: int = 10) -> DataFrame:
    return audited.orderBy("health_score", "id").limit(k)


def health_histogram(audited: DataFrame) -> DataFrame:
    """(bucket, n): 0 is 0-29, 4 is 90-100; empty buckets are there."""
    s = c("health_score")
    bucket: Column = F.when(s >= 90, 4).when(s >= 70, 3).when(s >= 50, 2).when(s >= 30, 1).otherwise(0)
    row = audited.agg(*[F.count_if(bucket == b).alias(f"b{b}") for b in range(5)])
    return row.select(F.posexplode(F.array(*[F.col(f"b{b}") for b in range(5)])).alias("bucket", "n"))


def status_distribution(audited: DataFrame) -> DataFrame:
    """(status_group, n) of the groups that occur."""
    return audited.groupBy(status_group(c("http.status_code")).alias("status_group")).agg(F.count("*").alias("n"))


def key_findings(summary_row: DataFrame) -> DataFrame:
    """(position, finding): sentences of the counts that are not zero, in order."""
    failed = c("status_4xx") + c("status_5xx") + c("errors")
    said = [("missing_meta_description", "pages missing meta description"), ("missing_title", "pages missing a title"), ("missing_h1", "pages missing an H1"), ("duplicate_titles", "pages with duplicate titles"), ("not_indexable", "pages not indexable"), ("images_missing_alt_total", "images missing alt text")]
    lines = [F.when(c(k) > 0, F.concat(c(k).cast("string"), F.lit(f" {t}"))) for k, t in said] + [F.when(failed > 0, F.concat(failed.cast("string"), F.lit(" pages with errors")))]
    return summary_row.select(F.posexplode(F.array_compact(F.array(*lines))).alias("position", "finding"))
