"""URL filters: base rules, then association rules mined from labelled urls.

A url's tokens are its host labels, its path words, its query keys and its
extension. Spark's FP-growth mines token combinations that go with a label;
rules are pruned by confidence and support and to the smallest antecedents, and
matched through an inverted index from token to rule. Tokens that stand in the same labelled
urls are twins: one of them is mined for all, and any of them matches. A template of many tokens that always come
together is thus one token and not all their combinations. An antecedent has MAX_ANTECEDENT tokens at most; that is the form of a rule, and
urls of many tokens are mined as parts that cover every three of them, so nothing longer is ever formed of them. Rules' rows are counted exactly.

Defined results: null urls and urls without :// have an empty host and path, no
tokens and the default verdict; equal rows give equal rows; of rules that match, the most confident, then the best supported, longest and the one of
largest id decides; an empty table
gives none, and without labelled urls no rule is mined.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets, materialize

# Fixed values of the query's contract: (verdict, host, path).
BASE_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pruning of mined rules; all that pass are matched.
MIN_SUPPORT, MIN_CONFIDENCE, MAX_ANTECEDENT = 0.002, 0.8, 3
#: Tokens of a url that is mined in one piece; rows that one task repeats of a distinct one.
WHOLE, REPEATS = 10, 1 << 16
DEFAULT = "allow"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) as the contract defines them."""
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, _URL, 1), UPPER, LOWER), F.regexp_extract(u, _URL, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Sorted distinct tokens; runs of digits read alike."""
    host, path = url_parts(url)
    named = lambda p, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(p), F.regexp_replace(F.lower(x), r"[0-9]+", "0")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0])
    return F.array_sort(F.array_distinct(F.concat(named("host:", F.split(host, r"\.")), named("path:", F.split(path, r"[/.]")), named("query:", keys))))


def token_sets(labelled: DataFrame) -> DataFrame:
    """labelled(tokens, label) -> (set_id, tokens, label, n) of distinct rows that have tokens."""
    sets = labelled.where("size(tokens) > 0 and label is not null").groupBy("tokens", "label").agg(F.count("*").alias("n"))
    return materialize(sets.withColumn("set_id", F.monotonically_increasing_id()), "url-sets")


def frequent_tokens(sets: DataFrame, least: int) -> DataFrame:
    """token_sets -> (token, n, twin) of tokens of at least `least` rows; twin: the least token of those that stand in the same rows.

    Tokens are told to be twins by the count and the sum of hashes of their rows. There are at most
    tokens a url / min_support frequent ones.
    """
    rows = sets.select("n", F.xxhash64("tokens").cast("decimal(38,0)").alias("row"), F.explode("tokens").alias("token"))
    seen = rows.groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.col("row") * F.col("n").cast("decimal(20,0)")).alias("rows_sum")).where(F.col("n") >= least)
    first = seen.groupBy("n", "rows_sum").agg(F.min("token").alias("twin"))
    return materialize(seen.join(first, ["n", "rows_sum"]).select("token", "n", "twin"), "url-tokens")


def covering_parts(tokens: str) -> Column:
    """Arrays that hold every three tokens of a row together: the row itself up to WHOLE tokens, else each three of its pairs of neighbours."""
    pairs = f"cast(ceil(size({tokens}) / 2) as int)"
    pair = lambda at: f"slice({tokens}, 2 * {at} + 1, 2)"
    last = f"transform(sequence(j + 1, {pairs} - 1), l -> concat({pair('i')}, {pair('j')}, {pair('l')}))"
    split = f"flatten(transform(sequence(0, {pairs} - 3), i -> flatten(transform(sequence(i + 1, {pairs} - 2), j -> {last}))))"
    return F.expr(f"case when size({tokens}) <= {WHOLE} then array({tokens}) else {split} end")


def candidates(sets: DataFrame, least: int) -> DataFrame:
    """token_sets -> (antecedent) of up to three tokens that FP-growth finds with a label.

    Long rows are mined as parts that cover every three of their tokens, so a row of k free tokens makes no 2**k sets. A
    combination may lie in several parts of a row: it is counted too often, never too seldom, and its rows are counted again afterwards.
    """
    parts = sets.select("label", "n", F.explode(covering_parts("tokens")).alias("part"))
    # a set that very many rows share is repeated by several tasks
    pieces = parts.select("label", "part", F.explode(F.expr(f"transform(sequence(0, cast((n - 1) div {REPEATS} as int)), k -> least({REPEATS}, n - k * {REPEATS}))")).alias("k"))
    items = pieces.repartition(buckets(sets.sparkSession)).select(F.concat("part", F.array(F.concat(F.lit("label:"), "label"))).alias("items"), F.explode(F.sequence(F.lit(1), F.col("k").cast("int")))).select("items")
    total = parts.agg(F.sum("n")).first()[0] or 1
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / total), minConfidence=1.0).fit(items)
    found = model.freqItemsets.where(F.size(F.filter("items", lambda x: x.startswith("label:"))) == 1)
    return found.select(F.array_sort(F.filter("items", lambda x: ~x.startswith("label:"))).alias("antecedent")).where(F.size("antecedent").between(1, 3)).distinct()


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_antecedent: int = MAX_ANTECEDENT) -> tuple[DataFrame, DataFrame]:
    """labelled(tokens, label) -> rules (rule_id, antecedent, label, confidence, support) over all labelled rows, and twins (token, twin)."""
    if not 1 <= max_antecedent <= 3:
        raise ValueError("an antecedent has one to three tokens")
    sets = token_sets(labelled)
    total = sets.agg(F.sum("n")).first()[0] or 0
    least = max(1, math.ceil(min_support * total - 1e-9))
    tokens = frequent_tokens(sets, least)
    alone = F.broadcast(tokens.where("token = twin").select("token"))
    slim = sets.select("set_id", "label", "n", F.explode("tokens").alias("token")).join(alone, "token").groupBy("set_id", "label", "n").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    slim = materialize(slim.groupBy("tokens", "label").agg(F.sum("n").alias("n")), "url-slim")
    found = materialize(candidates(slim, least).where(F.size("antecedent") <= max_antecedent), "url-candidates")
    # the rows of each candidate, met by its rarest token
    rarest = found.select("antecedent", F.explode("antecedent").alias("token")).join(F.broadcast(tokens.select("token", "n")), "token").groupBy("antecedent").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    held = slim.select("tokens", "label", "n", F.explode("tokens").alias("token")).join(rarest, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    counts = held.groupBy("antecedent", "label").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("rows", F.sum("n").over(Window.partitionBy("antecedent"))).withColumn("confidence", F.col("n") / F.col("rows"))
    mined = counts.where((F.col("n") >= least) & (F.col("confidence") >= min_confidence)).select("antecedent", "label", "confidence", (F.col("n") / F.lit(float(max(1, total)))).alias("support"))
    mined = materialize(mined, "url-rules")
    # a rule goes if a part of its antecedent tells as much: looked up by the part, not by comparing rules
    subsets = lambda a: F.array_compact(F.transform(F.sequence(F.lit(1), F.shiftleft(F.lit(1), max_antecedent) - 2), lambda m: F.when(m < F.shiftleft(F.lit(1), max_antecedent), F.filter(a, lambda x, i: F.call_function("getbit", m.cast("long"), i) == 1))))
    parts = mined.select("antecedent", "label", "confidence", F.explode(F.array_distinct(subsets(F.col("antecedent")))).alias("part")).where(F.size("part").between(1, F.size("antecedent") - 1))
    lesser = mined.select(F.col("antecedent").alias("part"), "label", F.col("confidence").alias("c"))
    useless = parts.join(lesser, ["part", "label"]).where(F.col("c") >= F.col("confidence")).select("antecedent", "label").distinct()
    kept = mined.join(useless, ["antecedent", "label"], "left_anti")
    rules = materialize(kept.withColumn("rule_id", F.xxhash64("antecedent", "label")), "url-rules-kept")
    return rules, tokens.where("token <> twin").select("token", "twin")


def match_rules(tokens: DataFrame, rules: DataFrame, twins: DataFrame | None = None) -> DataFrame:
    """Distinct token sets (tokens) -> (set_id, label, confidence) of the best rule whose whole antecedent they or their twins hold."""
    index = rules.select("rule_id", "label", "confidence", "support", F.size("antecedent").alias("needs"), F.explode("antecedent").alias("token"))
    probe = tokens.select(F.xxhash64("tokens").alias("set_id"), F.explode("tokens").alias("token"))
    if twins is not None:
        probe = probe.join(F.broadcast(twins), "token", "left").select("set_id", F.coalesce("twin", "token").alias("token")).distinct()
    hits = probe.join(index, "token").groupBy("set_id", "rule_id", "label", "confidence", "support", "needs").agg(F.count("*").alias("n")).where("n = needs")
    best = F.max_by("label", F.struct("confidence", "support", "needs", "rule_id"))
    return hits.groupBy("set_id").agg(best.alias("label"), F.max("confidence").alias("confidence"))


def url_filter(pages: DataFrame, labels: DataFrame | None = None, rules: list[tuple[str, str, str]] = BASE_RULES, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """pages -> (page_id, host, path, rule, verdict, mined_confidence).

    labels: (url, label) rows to mine; without them, the urls that base rules decide are the labelled ones.
    """
    host, path = url_parts(F.col(url_col))
    judged = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("tokens", url_tokens(F.col("_url"))).drop("_url")
    judged = materialize(judged.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("v"), "tokens"), "url-judged")
    train = judged.where("v is not null").select("tokens", F.col("v").alias("label")) if labels is None else labels.select(url_tokens(F.col("url")).alias("tokens"), F.col("label").cast("string").alias("label")).where("label is not null")
    mined, twins = mine_rules(train, min_support, min_confidence)
    sets = judged.where("v is null and size(tokens) > 0").select("tokens").distinct()
    matched = materialize(match_rules(sets, mined, twins), "url-matched").withColumnRenamed("confidence", "mined_confidence")
    out = judged.withColumn("set_id", F.when(F.col("v").isNull(), F.xxhash64("tokens"))).join(matched, "set_id", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("v", "label", F.lit(default)).alias("verdict"), "mined_confidence")
