"""Quality rules with adaptive thresholds.

Counts of a text are computed in its own row. Thresholds are read from mergeable
sketches of each language and source over the rows that pass the base rules: histograms
with integer bins of at most 1/32 relative width, which merge by addition, so the
result does not depend on the order of merging. They are fences around the quartiles,
widened to outer quantiles; features that are 0 in most rows are judged by the part that
is not 0: where it begins near 0 it is a tail, allowed up to a high quantile; else it is a
population of its own, and the limit is half way to its low quantile. Groups of few
rows take the sketch of their language, those of few again that of all. Documents are
then joined to the thresholds of their group.

Only built-in functions run.

Defined results: null and empty texts count 0 and fail; null languages and
sources are groups of their own; equal rows give equal rows; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Rows that a group's own sketch needs.
MIN_ROWS = 30
#: Feature -> (slack of its fence, whether it has a lower fence as well, else zeros are told apart); fences are quartile -+ 3 times the quartile range.
FEATURES = {"word_length": (50, True), "symbols": (20, False), "dup_lines": (10, False), "repeats": (30, False)}
FENCE = 3
#: Up to this value of its low quantile, the part of a feature that is not 0 is a tail of the zeros.
NEAR = 200
#: Percents of the quantiles read from sketches: of all rows, and of those that are not 0.
OF_ALL, OF_NONZERO = (5, 25, 75, 90), (10, 90)
WINDOW = 8


def base_counts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns keep plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    d = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    d = d.withColumn("_w", F.transform(F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    windows = F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("_w"), i + j) for j in range(WINDOW)]))
    d = d.withColumn("_h", F.when(F.size("_w") > WINDOW, windows))
    # most texts repeat nothing: only the others are sorted
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    again = F.filter("_s", lambda x, i: F.coalesce(F.get(F.col("_s"), i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(F.col("_s"), i + 1)["h"] == x["h"], F.lit(False)))
    places = F.sort_array(F.transform(again, lambda x: x["p"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD))
    d = d.withColumn("_l", lines)
    return d.select(
        *keep,
        "n_words",
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def features(counts: DataFrame) -> DataFrame:
    """Integer features by which adaptive thresholds judge: hundredths of characters a word, thousandths of others a word."""
    n = F.greatest("n_words", F.lit(1))
    whole = lambda x: F.floor(x / n).cast("long")
    return counts.withColumn("features", F.create_map(*[x for k, v in {"word_length": whole(100 * F.col("word_chars")), "symbols": whole(1000 * F.col("n_symbols")), "dup_lines": whole(1000 * F.col("n_dup_lines")), "repeats": whole(1000 * F.col("n_repeat_words"))}.items() for x in (F.lit(k), v)]))


def sketch_bin(x: Column) -> Column:
    """Lower end of x's bin: exact below 64, then 32 bins an octave."""
    shift = F.length(F.bin(x)) - 6
    return F.when(x < 64, x).otherwise(F.call_function("shiftleft", F.call_function("shiftright", x, shift), shift))


def sketches(featured: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """Mergeable sketches (group..., feature, bin, n): at most a few hundred bins a group and feature."""
    long = featured.where(~base_failed()).select(*group, F.explode("features").alias("feature", "x"))
    return long.groupBy(*group, "feature", sketch_bin(F.col("x")).alias("bin")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, group: tuple[str, ...]) -> DataFrame:
    """(group..., feature, rows, q5, ..., nz_rows, nz10, ...) of merged sketches; nz: of the rows that are not 0."""
    bins = sketch.groupBy(*group, "feature", "bin").agg(F.sum("n").alias("n"))
    over = F.coalesce(F.sum(F.when(F.col("bin") > 0, F.col("n"))), F.lit(0))
    listed = bins.groupBy(*group, "feature").agg(F.sum("n").alias("rows"), over.alias("nz_rows"), F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))

    def at(of: Column, rows: str, percent: int) -> Column:
        state = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("v"))
        return F.aggregate(of, state, lambda a, b: F.struct((a["seen"] + b["n"]).alias("seen"), F.when(a["v"].isNull() & (100 * (a["seen"] + b["n"]) >= percent * F.col(rows)), b["bin"]).otherwise(a["v"]).alias("v")), lambda a: a["v"])

    nonzero = F.filter("bins", lambda b: b["bin"] > 0)
    return listed.select(*group, "feature", "rows", *[at(F.col("bins"), "rows", q).alias(f"q{q}") for q in OF_ALL], "nz_rows", *[at(nonzero, "nz_rows", q).alias(f"nz{q}") for q in OF_NONZERO])


def thresholds(featured: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """(lang, source, feature_low, feature_high, ...) of each group; a group of under min_rows takes its language's, or those of all."""
    group = materialize(sketches(featured, ("lang", "source")), "quality-sketch")
    own, lang, everything = quantiles(group, ("lang", "source")), quantiles(group, ("lang",)), quantiles(group, ())
    read = ("rows", *[f"q{q}" for q in OF_ALL], "nz_rows", *[f"nz{q}" for q in OF_NONZERO])
    named = lambda df, p: df.select(*[c for c in df.columns if c not in read], *[F.col(c).alias(f"{p}_{c}") for c in read])
    lang, everything = named(lang, "l").withColumnRenamed("lang", "l_lang").withColumnRenamed("feature", "l_feature"), named(everything, "a").withColumnRenamed("feature", "a_feature")
    t = own.join(lang, own["lang"].eqNullSafe(F.col("l_lang")) & (own["feature"] == F.col("l_feature"))).join(everything, F.col("feature") == F.col("a_feature"))
    pick = lambda q: F.when(F.col("rows") >= min_rows, F.col(q)).when(F.col("l_rows") >= min_rows, F.col(f"l_{q}")).otherwise(F.col(f"a_{q}"))
    pick_nz = lambda q: F.when(F.col("nz_rows") >= min_rows, F.col(q)).when(F.col("l_nz_rows") >= min_rows, F.col(f"l_{q}")).when(F.col("a_nz_rows") >= min_rows, F.col(f"a_{q}"))
    top = lambda x: x + F.call_function("shiftright", x, F.lit(5))  # noqa: E731  # not under the upper end of x's bin
    reach = FENCE * (top(pick("q75")) - pick("q25"))
    tail = F.coalesce(F.when(pick_nz("nz10") <= NEAR, top(pick_nz("nz90"))).otherwise(F.floor(pick_nz("nz10") / 2)), F.lit(0)).cast("long")
    slack = F.element_at(F.create_map(*[F.lit(x) for k, (s, _) in FEATURES.items() for x in (k, s)]), F.col("feature"))
    two_sided = F.col("feature").isin([k for k, (_, both) in FEATURES.items() if both])
    outer = F.when(two_sided, top(pick("q90"))).otherwise(tail)
    fences = t.select(own["lang"], own["source"], "feature", (F.least(pick("q25") - reach, pick("q5")) - slack).alias("low"), (F.greatest(top(pick("q75")) + reach, outer) + slack).alias("high"))
    return fences.groupBy("lang", "source").agg(*[F.max(F.when(F.col("feature") == k, F.col(side))).alias(f"{k}_{side}") for k in FEATURES for side in ("low", "high")])


def quality_rules(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """docs(doc_id, text, lang, source) -> (doc_id, counts, base_failed, kept)."""
    # text goes no further than this scan
    counted = materialize(base_counts(docs.select("doc_id", "text", "lang", "source"), keep=("doc_id", "lang", "source")), "quality-counts")
    featured = features(counted)
    limits = materialize(thresholds(featured, min_rows), "quality-thresholds").withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    joined = featured.join(limits, featured["lang"].eqNullSafe(limits["t_lang"]) & featured["source"].eqNullSafe(limits["t_source"]), "left")
    value = lambda k: F.col("features")[k]
    within = [value(k) <= F.col(f"{k}_high") for k in FEATURES] + [value(k) >= F.col(f"{k}_low") for k, (_, both) in FEATURES.items() if both]
    verdict = within[0]
    for w in within[1:]:
        verdict = verdict & w
    failed = base_failed()
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.coalesce(verdict, F.lit(False))).alias("kept"))
