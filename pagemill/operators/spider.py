"""Spider: frontier levels that are fetched, parsed and expanded until depth or page cap; a crawl can stop and go on.

Everything a crawl knows is in one folder: a table a level (pages, frontier), robots rules by origin, and a log of states.
A level counts once its state row is written; a crawl that was paused, cancelled or lost goes on behind its last
whole level, and gives the rows that an unbroken one gives.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import crawl_key, parse, path_group, path_of
from ..sources import robots
from .crawl import gate
from .features import Dom, extracted_links, page_features
from .graph import build_edges
from .scoring import duplicate_flags, evaluate
from .storage import shared_dir

c = F.col

STATE = "at long, kind string, level int, total long, detail string"
FRONTIER = "id long, url string, depth int, discovered_from string"
RUNNING, PAUSED, CANCELLED, COMPLETED = "running", "paused", "cancelled", "completed"


@dataclass(frozen=True)
class SpiderConfig:
    max_depth: int = 5
    max_pages: int = 500
    keep_query: bool = False
    follow_subdomains: bool = False
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    robots_txt: str | None = None
    user_agent: str = "pagemill"


class Crawl:
    """A crawl from start, in folder; the folder of an earlier crawl with the same settings continues it.

    fetch: (id, url, delay_ms) -> (id, url, html, http, error). fetch_robots: (id, url) -> (id, url, content, error), asked once
    for the robots.txt of each origin that the frontier reaches; without it the config's robots_txt holds for the start's origin.

    A url that a gate rejects keeps its place among max_pages but is not fetched; the first page in crawl order that
    links to a url discovers it.
    """

    def __init__(self, spark: SparkSession, start: str, fetch: Callable[[DataFrame], DataFrame], cfg: SpiderConfig = SpiderConfig(), fetch_robots: Callable[[DataFrame], DataFrame] | None = None, folder: str | None = None) -> None:
        first = crawl_key(start)
        if first is None:
            raise ValueError(f"{start} cannot be crawled")
        self.spark, self.first, self.fetch, self.cfg, self.fetch_robots = spark, first, fetch, cfg, fetch_robots
        self.root = parse(first).host
        self.folder = folder or f"{shared_dir(spark)}/spider-{uuid.uuid4().hex}"
        self.group = f"spider-{uuid.uuid4().hex}"
        settings = json.dumps([first, asdict(cfg)], sort_keys=True)
        known = [r.detail for r in self.states() if r.kind == "begun"]
        if not known:
            self._say("begun", -1, 0, settings)
        elif json.loads(known[0]) != json.loads(settings):
            raise ValueError(f"{self.folder} holds a crawl with other settings")

    # ------------------------------------------------------------ state

    def states(self) -> list:
        """State rows in order: begun, a row a whole level, and what was asked of the crawl."""
        try:
            return self.spark.read.schema(STATE).parquet(f"{self.folder}/state").orderBy("at").collect()  # a row a level or command
        except AnalysisException:
            return []

    def _say(self, kind: str, level: int = -1, total: int = 0, detail: str = "") -> None:
        self.spark.createDataFrame([(time.time_ns(), kind, level, total, detail)], STATE).coalesce(1).write.mode("append").parquet(f"{self.folder}/state")

    def pause(self) -> None:
        """Stop before the next level; what runs is finished."""
        self._say(PAUSED)

    def cancel(self, now: bool = True) -> None:
        """Stop for good; now: the level that runs is given up. Results are those of whole levels."""
        self._say(CANCELLED)
        if now:
            self.spark.sparkContext.cancelJobGroup(self.group)

    def resume(self) -> str:
        """Go on behind the last whole level."""
        self._say(RUNNING)
        return self.run()

    def status(self) -> str:
        asked = [r.kind for r in self.states() if r.kind != "level"]
        return RUNNING if asked[-1] == "begun" else asked[-1]

    # ------------------------------------------------------------ levels

    def run(self) -> str:
        """Crawl until the end or until another session or thread says pause or cancel; returns the status."""
        self.spark.sparkContext.setJobGroup(self.group, f"crawl of {self.first}", True)
        try:
            while (status := self.status()) == RUNNING:
                done = [r for r in self.states() if r.kind == "level"]
                level, total = (done[-1].level + 1, done[-1].total) if done else (0, 1)
                if level == 0:
                    self.spark.createDataFrame([(0, self.first, 0, "")], FRONTIER).write.mode("overwrite").parquet(self._path("frontier", 0))
                try:
                    total, last = self._level(level, total)
                except Exception:
                    if self.status() == CANCELLED:  # its jobs were ended
                        break
                    raise
                self._say("level", level, total)
                if last:
                    self._say(COMPLETED)
            return self.status()
        finally:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    def _path(self, kind: str, level: int) -> str:
        return f"{self.folder}/{kind}/level={level}"

    def _read(self, kind: str, levels: range) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(self._path(kind, k)) for k in levels])

    def _judged(self, frontier: DataFrame, level: int) -> DataFrame:
        """frontier plus allowed and delay_ms; rules of origins that are new are fetched and kept."""
        if self.fetch_robots is None:
            own = robots.parse_robots(self.cfg.robots_txt or "", self.cfg.user_agent)
            return robots.decide(frontier.withColumn("path", robots.target_of(c("url"))), own["rules"]).drop("path").withColumn("delay_ms", F.lit(own["crawl_delay_ms"]).cast("long"))
        origins = frontier.select(robots.origin_of(c("url")).alias("origin")).distinct()
        if level:
            origins = origins.join(self._read("robots", range(level)), "origin", "left_anti")
        origins.transform(lambda o: o.join(robots.rules_table(o, self.fetch_robots, self.cfg.user_agent), "origin", "left")).write.mode("overwrite").parquet(self._path("robots", level))
        return robots.judge(frontier, self._read("robots", range(level + 1)))

    def _level(self, level: int, total: int) -> tuple[int, bool]:
        """(urls known, whether this was the last level) after fetching and expanding a level."""
        cfg, frontier = self.cfg, self.spark.read.parquet(self._path("frontier", level))
        open_ = self._judged(frontier, level)
        open_ = open_.where(gate(c("url"), c("depth"), list(cfg.include), list(cfg.exclude), c("allowed"))).drop("allowed")
        got = page_features(self.fetch(open_.select("id", "url", "delay_ms")))
        inside, outside = extracted_links(Dom(c("dom")), F.lit(self.root), cfg.follow_subdomains)
        none = F.array().cast("array<string>")
        got = got.withColumn("internal_links", F.coalesce(F.when(c("dom").isNotNull(), inside), none)).withColumn("external_links", F.coalesce(F.when(c("dom").isNotNull(), outside), none)).drop("dom", "html")
        got.join(frontier.select("id", "depth", "discovered_from"), "id").write.mode("overwrite").parquet(self._path("pages", level))
        if level == cfg.max_depth or total >= cfg.max_pages:
            return total, True
        found = self._read("pages", range(level, level + 1)).select(c("id").alias("parent"), c("url").alias("source"), F.posexplode("internal_links").alias("at", "url"))
        known = self._read("frontier", range(level + 1)).select("url")
        new = found.groupBy("url").agg(F.min(F.struct("parent", "at", "source")).alias("f")).join(known, "url", "left_anti")
        new = new.orderBy("f.parent", "f.at").limit(cfg.max_pages - total)
        # bounded by max_pages
        order = Window.orderBy("f.parent", "f.at", "url")
        new.select((F.row_number().over(order) + total - 1).cast("long").alias("id"), "url", F.lit(level + 1).alias("depth"), c("f.source").alias("discovered_from")).write.mode("overwrite").parquet(self._path("frontier", level + 1))
        n = self.spark.read.parquet(self._path("frontier", level + 1)).count()
        return total + n, n == 0

    # ------------------------------------------------------------ results

    def pages(self) -> DataFrame | None:
        """Pages of the whole levels so far."""
        done = [r.level for r in self.states() if r.kind == "level"]
        return self._read("pages", range(max(done) + 1)) if done else None

    def results(self) -> DataFrame | None:
        """Audited pages of the whole levels, whatever ended the crawl."""
        pages = self.pages()
        return None if pages is None else finalize(pages)

    def sitemaps(self) -> DataFrame:
        """(origin, sitemap) that the robots files name."""
        done = [r.level for r in self.states() if r.kind == "level"]
        return self._read("robots", range(max(done) + 1)).select("origin", F.explode("sitemaps").alias("sitemap"))


def spider(spark: SparkSession, start: str, fetch: Callable[[DataFrame], DataFrame], cfg: SpiderConfig = SpiderConfig(), fetch_robots: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Audited pages of a whole crawl with their spider struct."""
    crawl = Crawl(spark, start, fetch, cfg, fetch_robots)
    crawl.run()
    return crawl.results()


def finalize(pages: DataFrame) -> DataFrame:
    """Audited pages with inbound links, parents, orphans and dead ends, ids as they arrived."""
    edges = build_edges(pages.select("url", "internal_links"))
    order = pages.select(c("url").alias("source"), "id")
    inbound = edges.join(order, "source").groupBy(c("target").alias("url")).agg(F.transform(F.sort_array(F.collect_set(F.struct("id", "source"))), lambda x: x["source"]).alias("parents"))
    joined = pages.join(inbound, "url", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))
    struct = F.struct(
        "depth", "discovered_from", "internal_links", "external_links", F.lit(False).alias("is_external"), F.coalesce(c("http.headers")["last-modified"], F.lit("")).alias("last_modified"), F.size("parents").alias("inbound_internal"),
        F.size("internal_links").alias("outbound_internal"), F.size("external_links").alias("outbound_external"), "parents", ((F.size("parents") == 0) & (c("depth") != 0)).alias("is_orphan"), (F.size("internal_links") == 0).alias("is_dead_end"), path_group(path_of(c("url"))).alias("path_group"),
    )
    return evaluate(duplicate_flags(joined.withColumn("spider", struct).drop("depth", "discovered_from", "internal_links", "external_links", "parents")))
