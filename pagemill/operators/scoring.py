"""Issues, category scores, health and row status; duplicates across pages are found first, so pages are scored once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import number_text, trim
from .rules import CATEGORIES, ISSUE, rule_set

# Deductions by severity and weights of categories in the health score.
DEDUCTION = {"critical": 10, "warning": 5, "info": 2}
WEIGHTS = {"seo": 0.35, "performance": 0.25, "content": 0.15, "technical": 0.1, "social": 0.1, "images": 0.05}


def duplicate_flags(features: DataFrame) -> DataFrame:
    """features plus duplicate_title and duplicate_description.

    Keys that several pages share are counted with a map-side combine and joined back, so a title
    that a third of all pages carry does not gather them in one task.
    """
    out = features
    for name, at in (("title", "title"), ("description", "meta_description")):
        key = F.lower(trim(F.coalesce(F.col(f"seo.{at}"), F.lit(""))))
        out = out.withColumn(f"_{name}", F.when(key != "", key))
        shared = out.where(F.col(f"_{name}").isNotNull()).groupBy(F.col(f"_{name}").alias(f"_k_{name}")).agg(F.count("*").alias("_n")).where("_n > 1").select(f"_k_{name}")
        # pages without a key are spread: nulls would all hash to one partition
        out = out.withColumn(f"_{name}", F.coalesce(f"_{name}", F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))))
        out = out.join(shared, F.col(f"_{name}") == F.col(f"_k_{name}"), "left").withColumn(f"duplicate_{name}", F.col(f"_k_{name}").isNotNull()).drop(f"_{name}", f"_k_{name}")
    return out


def count_severity(issues: Column, severity: str, category: str | None = None) -> Column:
    return F.size(F.filter(issues, lambda i: (i["severity"] == severity) & (F.lit(True) if category is None else i["category"] == category)))


def is_failed(http: Column, error: Column) -> Column:
    return (F.coalesce(error, F.lit("")) != "") | http["status_code"].isNull() | (http["status_code"] >= 400)


def evaluate(features: DataFrame) -> DataFrame:
    """features with duplicate flags -> plus issues, scores, health_score, row_status, issue counts."""
    failed = is_failed(F.col("http"), F.col("error"))
    code = F.col("http.status_code")
    said = F.coalesce(F.when(F.col("error") != "", F.col("error")), F.concat(F.lit("HTTP "), F.coalesce(number_text(code.cast("double")), F.lit("null")), F.lit(" "), F.coalesce("http.status_text", F.lit(""))))
    broken = F.struct(F.lit("technical").alias("category"), F.lit("critical").alias("severity"), F.lit("request").alias("field"), said.alias("message"), code.cast("double").alias("value_num"), F.lit(None).cast("string").alias("value_str")).cast(ISSUE)
    rules = rule_set({k: F.col(k) for k in CATEGORIES}, F.col("duplicate_title"), F.col("duplicate_description"))
    groups = [F.array_compact(F.array(*[r.issue() for r in rules if r.category == c])) for c in CATEGORIES]
    scored = features.withColumn("_failed", failed).withColumn("issues", F.when(failed, F.array(broken)).otherwise(F.concat(*groups)))
    points = lambda c: F.aggregate(F.filter("issues", lambda i: i["category"] == c), F.lit(0), lambda a, i: a + F.when(i["severity"] == "critical", DEDUCTION["critical"]).when(i["severity"] == "warning", DEDUCTION["warning"]).otherwise(DEDUCTION["info"]))
    scored = scored.withColumn("scores", F.struct(*[F.when(F.col("_failed"), 0).otherwise(F.greatest(F.lit(0), 100 - points(c))).alias(c) for c in WEIGHTS]))
    total = F.lit(0.0)
    for c, w in WEIGHTS.items():
        total = total + F.col("scores")[c] * F.lit(w)
    return (
        scored.withColumn("health_score", F.when(F.col("_failed"), 0).otherwise(F.floor(total + 0.5)).cast("int"))
        .withColumn("critical_issues", count_severity(F.col("issues"), "critical"))
        .withColumn("total_issues", F.col("critical_issues") + count_severity(F.col("issues"), "warning"))
        .withColumn("row_status", F.when(F.col("_failed"), "error").when(F.col("total_issues") > 0, "warning").otherwise("ok"))
        .drop("_failed")
    )


def issues_long(audited: DataFrame) -> DataFrame:
    """One row an issue, in order."""
    return audited.select("id", F.posexplode("issues").alias("position", "i")).select("id", "position", "i.*")
