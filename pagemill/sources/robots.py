"""robots.txt: rules of the groups that name an agent, decisions by the longest match, and a table of rules by origin."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = "agent string, allow boolean, pattern string, regex string, length int"


def parse_robots(text: str, agent: str) -> dict:
    """{rules: [(allow, pattern)], crawl_delay_ms, sitemaps} for an agent: its own groups, else those of *."""
    groups: list[tuple[list[str], list[tuple[str, str]]]] = []
    sitemaps, names_open = [], False
    for line in text.lstrip("﻿").splitlines():
        key, colon, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "sitemap":
            sitemaps.append(value)
        elif key == "user-agent":
            if not names_open:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
            names_open = True
        elif key in ("allow", "disallow", "crawl-delay") and groups:
            names_open = False
            groups[-1][1].append((key, value))
    token = re.split(r"[/\s]", agent.strip().lower())[0]
    own = [g for g in groups if any(n != "*" and n == token for n in g[0])] or [g for g in groups if "*" in g[0]]
    lines = [x for g in own for x in g[1]]
    delay = next((v for k, v in lines if k == "crawl-delay"), None)
    try:
        delay_ms = max(0, int(float(delay) * 1000)) if delay is not None else 0
    except (ValueError, OverflowError):
        delay_ms = 0
    return {"rules": [(k == "allow", v) for k, v in lines if k != "crawl-delay" and v], "crawl_delay_ms": delay_ms, "sitemaps": sitemaps}


def rule_regex(pattern: str) -> str:
    end = pattern.endswith("$")
    body = pattern[:-1] if end else pattern
    return "^" + "".join(".*" if ch == "*" else re.escape(ch) if not ch.isalnum() and ch not in "/_" else ch for ch in body) + ("$" if end else "")


def rules_frame(spark: SparkSession, text: str, agent: str) -> DataFrame:
    rows = [(agent, allow, p, rule_regex(p), len(p)) for allow, p in parse_robots(text, agent)["rules"]]
    return spark.createDataFrame(rows, RULES)


def decide(urls: DataFrame, rules: list[tuple[bool, str]]) -> DataFrame:
    """urls(url, path, ...) plus allowed: the longest rule that matches decides, allow wins ties, none allows."""
    fits = F.array_compact(F.array(*[F.when(F.col("path").rlike(rule_regex(p)), F.struct(F.lit(len(p)).alias("length"), F.lit(allow).alias("allow"))) for allow, p in rules])) if rules else F.array().cast("array<struct<length:int,allow:boolean>>")
    return urls.withColumn("allowed", F.coalesce(F.array_max(fits)["allow"], F.lit(True)))


# ---------------------------------------------------------------- by origin

RULE = "array<struct<length:int,allow:boolean,regex:string>>"
TABLE = f"origin string, rules {RULE}, delay_ms long, sitemaps array<string>"


def origin_of(url: Column) -> Column:
    """Scheme and host of a url."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1))


def target_of(url: Column) -> Column:
    """What rules are matched against: path and query."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def rules_table(origins: DataFrame, fetch: Callable[[DataFrame], DataFrame], agent: str) -> DataFrame:
    """TABLE of origins(origin): each one's robots.txt is asked for once; a file that cannot be had allows all.

    fetch: (id, url) -> (id, url, content, error), as sources.http.fetch_bytes.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse_robots((raw or b"").decode("utf-8", "replace"), agent) for raw in b.column(1).to_pylist()]
            rules = [[{"length": len(p), "allow": allow, "regex": rule_regex(p)} for allow, p in f["rules"]] for f in found]
            kind = pa.list_(pa.struct([("length", pa.int32()), ("allow", pa.bool_()), ("regex", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rules, kind), pa.array([f["crawl_delay_ms"] for f in found], pa.int64()), pa.array([f["sitemaps"] for f in found], pa.list_(pa.string()))], names=["origin", "rules", "delay_ms", "sitemaps"])

    asked = origins.select("origin", F.xxhash64("origin").alias("id"), F.concat("origin", F.lit("/robots.txt")).alias("url"))
    got = fetch(asked.select("id", "url")).where("error is null").select(F.regexp_replace("url", "/robots.txt$", "").alias("origin"), F.col("content").cast("binary"))
    return got.mapInArrow(parse, TABLE)


def allowed_by(target: Column, rules: Column) -> Column:
    """Verdict of the longest rule that matches; allow wins ties, none allows."""
    fits = F.filter(rules, lambda r: F.rlike(target, r["regex"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["length"].alias("length"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))


def judge(urls: DataFrame, table: DataFrame) -> DataFrame:
    """urls(url, ...) plus allowed and delay_ms by the TABLE of rules; an origin without an entry allows all at once."""
    own = table.select(F.col("origin").alias("_origin"), F.col("rules").alias("_rules"), "delay_ms")
    joined = urls.withColumn("_o", origin_of(F.col("url"))).join(own, F.col("_o") == F.col("_origin"), "left")
    return joined.withColumn("allowed", allowed_by(target_of(F.col("url")), F.col("_rules"))).withColumn("delay_ms", F.coalesce("delay_ms", F.lit(0).cast("long"))).drop("_o", "_origin", "_rules")
