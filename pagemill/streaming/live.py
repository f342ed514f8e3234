"""Audits as Structured Streaming: fetch rows arrive, features append, counters run along.

Duplicate titles depend on all rows, so scores are evaluated over the accumulated table
when it is asked for; each micro-batch only appends features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.features import page_features
from ..operators.scoring import duplicate_flags, evaluate
from ..operators.views import status_group


def start_audit(fetches: DataFrame, out: str, checkpoint: str, trigger: str = "200 milliseconds", once: bool = False) -> StreamingQuery:
    """Append features of a stream of fetch rows(id, url, html, http, error) to a table at out.

    A batch that is retried replaces its own folder, so rows are not doubled.
    """
    def append(batch: DataFrame, batch_id: int) -> None:
        page_features(batch).drop("html", "dom").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = fetches.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger)).start()


def audited(spark: SparkSession, out: str) -> DataFrame:
    """Scores over all that has arrived."""
    return evaluate(duplicate_flags(spark.read.parquet(out).drop("batch")))


def progress(fetches: DataFrame) -> DataFrame:
    """Running counts by status group of a stream or table of (status_code); complete or update mode."""
    return fetches.groupBy(status_group(F.col("status_code")).alias("status_group")).agg(F.count("*").alias("n"))


def windowed_progress(fetches: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and status group; rows later than the watermark are left out."""
    return fetches.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), status_group(F.col("status_code")).alias("status_group")).agg(F.count("*").alias("n")).select("w.start", "status_group", "n")


def rate_and_eta(crawled: Column, discovered: Column, max_pages: Column, elapsed_ms: Column) -> list[Column]:
    """pages_per_sec with one decimal, and eta_ms: null if nothing is known to be left or done."""
    rate = F.when(elapsed_ms > 0, crawled / (elapsed_ms / 1000)).otherwise(0.0)
    left = F.least(discovered, max_pages) - crawled
    return [(F.floor(rate * 10 + 0.5) / 10).alias("pages_per_sec"), F.when((rate > 0) & (left > 0), F.floor(left / rate * 1000 + 0.5)).cast("long").alias("eta_ms")]


def live_progress(fetches: DataFrame, max_pages: int, max_depth: int = 5, key: str = "crawl") -> DataFrame:
    """Progress of each crawl of a stream (or table) of (crawl, ts, depth, status_code, discovered, links): one row a crawl, kept up to date.

    State is a running aggregate by crawl that tasks combine before the shuffle, so a crawl of very many pages is no hot
    key; rate and time left follow from it in the plan. discovered: urls known when the page was done. Complete or update mode.
    """
    ms = lambda t: F.unix_millis(t.cast("timestamp"))
    group = status_group(F.col("status_code"))
    counts = [F.count_if(group == g).cast("long").alias(n) for g, n in (("2xx", "status_2xx"), ("3xx", "status_3xx"), ("4xx", "status_4xx"), ("5xx", "status_5xx"), ("errors", "errors"))]
    depths = [F.count_if(F.col("depth") == d).cast("long").alias(f"depth_{d}") for d in range(max_depth + 1)]
    state = fetches.groupBy(key).agg(F.count("*").alias("crawled"), F.max("discovered").cast("long").alias("discovered"), F.coalesce(F.sum("links"), F.lit(0)).cast("long").alias("total_links"), (ms(F.max("ts")) - ms(F.min("ts"))).alias("elapsed_ms"), *counts, *depths)
    known = F.least(F.col("discovered"), F.lit(max_pages))
    return state.select("*", F.greatest(known - F.col("crawled"), F.lit(0)).alias("queued"), *rate_and_eta(F.col("crawled"), F.col("discovered"), F.lit(max_pages), F.col("elapsed_ms")))


def quiet_crawls(fetches: DataFrame, gap: str = "10 minutes", late: str = "1 minute", key: str = "crawl") -> DataFrame:
    """(crawl, started, last_seen, pages) of runs without a page for gap: sessions that the watermark's timer closes; append mode."""
    runs = fetches.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("pages"), F.max("ts").alias("last_seen"))
    return runs.select(key, F.col("w.start").alias("started"), "last_seen", "pages")
