"""A training-corpus pipeline: STAGES over documents, each written and read again.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
documents. Rows are told apart by a hash of doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import materialize, read
from pagemill.llm.decontaminate import decontaminate
from pagemill.llm.mixing import mix_sources
from pagemill.llm.ngram_join import ngram_components
from pagemill.llm.substring_dedup import substring_dedup
from pagemill.llm.toxicity import score_toxicity, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Models and rounded mixtures are beyond SQL.
ORACLE_SQL = None


def _row() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "text").alias("_row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the documents that are there."""
    scored = score_toxicity(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.where("predicted = 0").select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts the row with the smallest doc_id; texts without words and groups without ids stay whole."""
    rows = ngram_components(docs)
    grouped = rows.where("n_shingles > 0 and component_id is not null")
    first = grouped.groupBy("component_id").agg(F.min_by("row_id", F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")).alias("_row")).select("_row")
    loose = rows.where("n_shingles = 0 or component_id is null").select(F.col("row_id").alias("_row"), F.lit(True).alias("_loose"))
    keep = materialize(first.withColumn("_loose", F.lit(False)).unionByName(loose).distinct(), "pipeline-near")
    # equal rows are one where they stand for a group; each loose row is its own
    kept = docs.select("*", _row()).join(keep, "_row").withColumn("_nth", F.when(F.col("_loose"), F.monotonically_increasing_id()))
    return kept.dropDuplicates(["_row", "_nth"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document holds are cut; texts of which nothing is left go."""
    out = substring_dedup(docs.select(*COLUMNS), rejoin=False)
    left = out.where("n_removed = 0 or n_removed < n_words")
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    leaks = decontaminate(docs, read(spark, sf_dir, "benchmark")).select(F.col("row_id").alias("_row")).distinct()
    leaks = materialize(leaks, "pipeline-leaks")
    return docs.select("*", _row()).join(leaks, "_row", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, with how many copies of each."""
    taken = mix_sources(docs).groupBy("row_id").agg(F.first("size").alias("size"), F.first("target").alias("target"), F.sum("copies").alias("copies"), F.sum("taken").alias("taken"))
    taken = taken.where("copies > 0").withColumnRenamed("row_id", "_row")
    return docs.select("*", _row()).dropDuplicates(["_row"]).join(taken, "_row").select(*COLUMNS, "size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", one_of_near_copies),
    ("repeats", cut_repeats),
    ("leaks", drop_leaks),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
