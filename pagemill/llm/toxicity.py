"""Toxicity by weak supervision.

Voters are lexicon entries and patterns. Lexicons of words and word stems are found
from a bounded sample of labelled rows: entries whose rows, where they stand once, twice or often for the length, are
surely mostly toxic. A generative label model estimates each voter's accuracy by expectation
maximisation from the votes alone; labels choose the voters and set the share of toxic rows, but do not
vote. Correlations that are left between voters given the posterior discount voters that say the
same. A linear classifier is trained on the posterior labels and scores every whole text.

The sample is the SAMPLE_ROWS rows with the smallest hash of doc_id, so reruns agree. Of its rows that share
their least 3-gram and label, such as near copies, one counts, and of rows with equal doc_id the one with the smallest text.
It is a table in the shared folder.

Defined results: null and empty texts get the classifier's score of no words; rows with
equal doc_id get equal folds; a null doc_id is in no fold to learn from
and not held out; contradicting labels of a doc_id count by their mean, a tie as not toxic;
of entries that rank alike the longer, then the smaller one comes first;
without labels all scores are 0; empty tables give an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_SEP, LOWER, Hasher, materialize, text_slices, word_bounds

#: Bound of the labelled rows that are learned from, and so of the entries of the lexicon.
SAMPLE_ROWS = 20_000
#: An entry is in that many toxic rows at least, and the share of toxic rows among its own is that at least, at two sigma.
MIN_ROWS, MIN_PRECISION = 5, 0.55
#: Lengths of word beginnings that may be entries beside whole words: insults also come as stems of compounds.
STEMS = (4, 5, 6, 7)
#: Conditions on an entry's places in a text, of which each entry gets the one that tells most: at least so many, and one for so many words (0: any).
CONDITIONS = ((1, 0), (2, 0), (2, 200))
THRESHOLD = 0.7
#: Fold of a document: crc32 of its id as text, modulo FOLDS; HELD_OUT is never learned from.
FOLDS, HELD_OUT = 3, 1
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_ALPHA = _UPPER.copy()
_ALPHA[0x61:0x7B] = True


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _wilson(p: Column, n: Column, z: float = 2.0) -> Column:
    """Lower end of the interval of the share p / n."""
    share = p / n
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _beginnings(length: int) -> Column:
    """Stem entries of one length of the column words."""
    return F.transform(F.filter("words", lambda w: F.length(w) >= length), lambda w: F.concat(F.substring(w, 1, length), F.lit("*")))


def _standing(times: int, per: int) -> Column:
    """(entry, times, per) of the column of sorted entries whose places meet the condition: a k-th of equal ones tells of k."""
    need = F.greatest(F.lit(times), F.ceil(F.size("words") / F.lit(per)).cast("int")) if per else F.lit(times)
    again = F.filter("entries", lambda x, i: (i >= need - 1) & x.eqNullSafe(F.get("entries", i - (need - 1))))
    return F.transform(F.array_distinct(again), lambda x: F.struct(x.alias("entry"), F.lit(times).alias("times"), F.lit(per).alias("per")))


@dataclass
class Model:
    """Lexicon, with the conditions (times, per) on which its entries count, and the linear classifier's weights: entries, then patterns, then the constant."""

    lexicon: list[str]
    needs: np.ndarray
    weights: np.ndarray


def text_features(column: pa.Array, lexicon: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, end, counts): per row the places of each lexicon entry, then words, ! marks, symbols, capitals, letters.

    An entry that ends in * stands for all words that begin so.
    """
    hasher = Hasher(4)
    with np.errstate(over="ignore"):
        stems: dict[int | None, list[int]] = {}
        for i, w in enumerate(lexicon):
            stems.setdefault(len(w[:-1].encode()) if w.endswith("*") else None, []).append(i)
        raw = [np.frombuffer(w.removesuffix("*").encode(), np.uint8) for w in lexicon]
        keys = np.array([hasher.words(r, np.array([0]), np.array([len(r)]))[0] for r in raw], np.uint64)
        for first, end, data, offs in text_slices(column):
            low = LOWER[data]
            starts, ends, heads = word_bounds(low, offs, ALNUM_SEP)
            rows = end - first
            out = np.zeros((rows, len(lexicon) + 5))
            sums = hasher.sums(low)
            for size, members in stems.items() if len(starts) else ():
                at = np.arange(len(starts)) if size is None else np.flatnonzero(ends - starts >= size)
                h = hasher.spans(sums, starts[at], ends[at] if size is None else starts[at] + size)
                mine = np.array(members)[np.argsort(keys[members])]
                spot = np.minimum(np.searchsorted(keys[mine], h), len(mine) - 1)
                hit = np.flatnonzero(keys[mine][spot] == h)
                np.add.at(out, (np.searchsorted(heads, at[hit], "right") - 1, mine[spot[hit]]), 1)
            out[:, len(lexicon)] = np.diff(heads)
            for k, mask in enumerate((data == 0x21, _SYMBOL[data], _UPPER[data], _ALPHA[data])):
                out[:, len(lexicon) + 1 + k] = np.diff(np.searchsorted(np.flatnonzero(mask), offs))
            yield first, end, out


def enough(counts: np.ndarray, needs: np.ndarray) -> np.ndarray:
    """counts without those of entries whose places do not meet their condition."""
    out, words = counts.copy(), counts[:, len(needs)]
    lex = out[:, : len(needs)]
    lex[lex < np.where(needs[:, 1] > 0, np.maximum(needs[:, 0], words[:, None] / np.maximum(needs[:, 1], 1)), needs[:, 0])] = 0
    return out


def votes(counts: np.ndarray, entries: int) -> np.ndarray:
    """Rows x voters: 1 toxic, 0 not, -1 abstains. The lexicon's entries vote one by one, patterns after them."""
    lex, words = counts[:, :entries], np.maximum(counts[:, entries], 1)
    kinds, places = (lex > 0).sum(axis=1), lex.sum(axis=1)
    shout = (counts[:, entries + 3] > 0.5 * np.maximum(counts[:, entries + 4], 20)).astype(int)
    patterns = [
        np.where(kinds >= 2, 1, np.where(kinds == 0, 0, -1)),  # several insults, or none
        np.where(kinds == 0, -1, np.where(places >= 0.004 * words, 1, 0)),  # dense in insults, or a few in a long text
        np.where(counts[:, entries + 1] > 0.05 * words, 1, -1),  # exclamations
        np.where(counts[:, entries + 2] > 0.2 * words, 1, -1),  # masked by symbols
        np.where(shout == 1, 1, -1),
    ]
    return np.column_stack([np.where(lex > 0, 1, -1), *patterns])


def label_model(v: np.ndarray, label: np.ndarray | None = None, share: float | None = None, rounds: int = 25) -> np.ndarray:
    """Posterior P(toxic) of each row under class-conditional voters with discounts for correlation.

    A voter has a rate of either vote in either class. share: toxic rows expected; label: one more, noisy voter. The start is what the voters say on average.
    """
    prior = np.clip(share if share is not None else 0.5 if label is None else label.mean(), 0.01, 0.5)
    all_votes = v if label is None else np.column_stack([v, label.astype(int)])
    said = [(all_votes == k).astype(float) for k in (0, 1)]
    post = np.where(label > 0, 0.8, 0.02) if label is not None else np.where((v == 1).sum(axis=1) > (v == 0).sum(axis=1), 0.8, 0.02)
    voted, weight = (all_votes >= 0).astype(float), np.ones(all_votes.shape)
    for _ in range(rounds):
        logit = np.full(len(post), np.log(prior / (1 - prior)))
        p1, p0 = post.sum(), (1 - post).sum()
        for k in range(2):  # abstaining tells nothing
            a = (post @ said[k] + 0.5) / (p1 + 1.5)
            b = ((1 - post) @ said[k] + 0.5) / (p0 + 1.5)
            logit += (said[k] * weight) @ np.log(a / b)
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        # what is left of the votes given the posterior: correlated voters that speak of a row share one vote's weight
        x = np.where(all_votes == 1, 1.0, np.where(all_votes == 0, -1.0, 0.0))
        p1, p0 = max(post.sum(), 1e-9), max((1 - post).sum(), 1e-9)
        left = x - np.outer(post, post @ x / p1) - np.outer(1 - post, (1 - post) @ x / p0)
        scale = np.sqrt((left**2).sum(axis=0)) + 1e-9
        corr = np.abs(left.T @ left / np.outer(scale, scale))
        np.fill_diagonal(corr, 0)
        weight = 1 / (1 + voted @ np.where(corr > 0.1, corr, 0))
    return post


def design(counts: np.ndarray, entries: int) -> np.ndarray:
    """Inputs of the linear classifier."""
    lex, words = counts[:, :entries], np.maximum(counts[:, entries], 1)
    kinds, places = (lex > 0).sum(axis=1), lex.sum(axis=1)
    extra = [np.minimum(kinds, 4), kinds >= 1, kinds >= 2, np.log1p(100 * places / words), counts[:, entries + 1] / words, np.minimum(counts[:, entries + 2] / words, 3), counts[:, entries + 3] / np.maximum(counts[:, entries + 4], 1), np.ones(len(counts))]
    return np.column_stack([np.minimum(lex, 3), *[np.asarray(e, float) for e in extra]])


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 0.03, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft targets by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - target) + penalty * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Learn from labelled rows outside the held-out fold; None without labels."""
    known = labels.where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("toxic") > 0.5).cast("int").alias("label"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # at most sample_rows small rows, and as many texts: of rows with equal ids the smallest text is learned from
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    sample = sample.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    sample = sample.select("doc_id", "text", "label", F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOW), F.lit(WORDS), F.lit(0)).alias("words"))
    # of near copies, which would count as evidence many times, most share their least 3-gram hash
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 3, F.lit(0))), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    sample = sample.groupBy(F.array_min(grams).alias("g"), "label").agg(F.min_by(F.struct("text", "words"), "doc_id").alias("s")).select("s.text", "s.words", "label")
    sample = materialize(sample, "toxicity-sample")
    n, pos = sample.agg(F.count("*"), F.sum("label")).first()
    if not n or not pos or pos == n:
        return None
    stems = [_beginnings(k) for k in STEMS]
    entries = sample.select("label", "words", F.array_sort(F.concat("words", *stems)).alias("entries"))
    held = [_standing(*c) for c in CONDITIONS]
    counted = entries.select("label", F.explode(F.concat(*held)).alias("e")).select("label", "e.*").groupBy("entry", "times", "per").agg(F.sum("label").alias("p"), F.count("*").alias("c"))
    found = counted.where(F.col("p") >= MIN_ROWS).withColumn("sure", _wilson(F.col("p"), F.col("c"))).where(F.col("sure") >= MIN_PRECISION)
    # the surest and widest first; a longer entry before a shorter one that finds the same
    ranked = found.orderBy(F.desc(F.col("p") * F.col("sure")), F.desc(F.length("entry")), "entry", "times", "per")
    lexicon: list[str] = []
    needs: list[tuple[int, int]] = []
    for r in ranked.collect():
        stem = r.entry.removesuffix("*")
        if not any(stem.startswith(x.removesuffix("*")) or x.startswith(stem) for x in lexicon):
            lexicon.append(r.entry)
            needs.append((r.times, r.per))
    if not lexicon:
        return None
    width = len(lexicon) + 5

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, counts in text_features(b.column(0), lexicon):
                yield pa.RecordBatch.from_arrays([b.column(1).slice(first, end - first), pa.array(list(counts), pa.list_(pa.float64()))], names=["label", "counts"])

    got = sample.select("text", "label").mapInArrow(measure, "label int, counts array<double>").toPandas()
    counts = np.stack(got.counts.to_numpy()).reshape(len(got), width)
    order = np.lexsort((got.label.to_numpy(), *counts.T))  # the order of arrival does not matter
    counts, label = counts[order], got.label.to_numpy()[order]
    counts = enough(counts, np.array(needs))
    post = label_model(votes(counts, len(lexicon)), share=float(label.mean()))
    return Model(lexicon, np.array(needs), fit_linear(design(counts, len(lexicon)), post))


def score_toxicity(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs plus score and predicted; columns of those names are replaced."""
    docs = docs.drop("score", "predicted")
    if model is None:
        return docs.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts))
        for first, end, counts in text_features(pa.array(texts, pa.large_string(), from_pandas=True), model.lexicon):
            out[first:end] = 1 / (1 + np.exp(-np.clip(design(enough(counts, model.needs), len(model.lexicon)) @ model.weights, -30, 30)))
        return pd.Series(out)

    return docs.withColumn("score", score(F.col("text").cast("string"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Train on labels(doc_id, toxic) and score docs(doc_id, text): docs plus held_out, score, predicted."""
    scored = score_toxicity(docs, train(docs, labels), threshold)
    return scored.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)))
