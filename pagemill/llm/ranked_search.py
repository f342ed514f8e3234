"""Ranked lexical search by WAND, a shard of documents at a time.

Terms are runs of letters and digits (any character beyond ASCII counts), A-Z lower-cased. One
pass over the whole texts counts N, L and document frequencies and writes, per shard of documents,
the postings (document, tf) of the terms that are asked for, documents by id. WAND then walks
a shard's postings: cursors are sorted by their document, the pivot is the first document up to which the
terms' largest impacts in the shard add up to more than the threshold, cursors before it skip to it,
and only a pivot that all cursors have reached is scored. The threshold is the heap's least score; the k
best of one shard in SEED give all shards a threshold to begin with, below which (not at which) a document
cannot be among the best. Shard heaps are merged by item.

The terms of the items are looked up in every worker; items go in blocks of at most BLOCK_BYTES of
terms, a pass over the documents each. Words are found by hash and then compared byte by byte.

Defined results: null and empty texts have no term; an item without known terms has no rows; rows with
equal or null ids are rows of their own (a null doc_id ranks behind all ids on ties); empty tables give no rows;
other columns are ignored. A text is bounded by what a row may hold. Counts and scores are 64-bit integers.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM_SEP, LOWER, Hasher, materialize, text_slices, word_bounds

#: A term, after A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_BYTES = 8 << 20
#: One shard in so many is searched first.
SEED = 16

INDEX = "shard long, with_terms long, terms_total long, ids binary, lengths binary, terms binary, ends binary, places binary, tfs binary"
NO_ID = np.iinfo(np.int64).max
END = 1 << 62

c = F.col


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, terms): distinct terms of each row; item tells rows apart."""
    low = F.translate(F.coalesce(c(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select(c(id_col).alias("item_id"), F.array_distinct(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("terms")).withColumn("item", F.monotonically_increasing_id())


class Vocabulary:
    """Terms by number, found in bytes by hash and compared."""

    def __init__(self, terms: list[str]) -> None:
        self.raw = [t.encode() for t in terms]
        self.data = np.frombuffer(b"".join(self.raw), np.uint8)
        self.ends = np.cumsum([len(r) for r in self.raw])
        self.starts = self.ends - [len(r) for r in self.raw]
        for self.seed in range(1, 100):  # a seed that tells all terms apart
            hashes = Hasher(self.seed).words(self.data, self.starts, self.ends)
            if len(np.unique(hashes)) == len(terms):
                break
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def find(self, hasher: Hasher, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the word, number of the term) of all words that are terms."""
        h = hasher.words(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        term = self.order[at[hit]]
        same = (ends - starts)[hit] == (self.ends - self.starts)[term]
        hit, term = hit[same], term[same]
        if not len(hit):
            return hit, term
        lens = (ends - starts)[hit]
        inner = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
        unlike = data[inner + np.repeat(starts[hit], lens)] != self.data[inner + np.repeat(self.starts[term], lens)]
        same = ~np.logical_or.reduceat(unlike, np.cumsum(lens) - lens)
        return hit[same], term[same]


def build_index(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """INDEX: a row for each batch of documents of a partition; places and tfs lie by term, and by document id in it."""
    words = Vocabulary(terms)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hasher, part = Hasher(words.seed), TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            ids = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            lengths, rows, found, counts = np.zeros(len(ids), np.int64), [], [], []
            for first, end, data, offs in text_slices(b.column(1)):
                data = LOWER[data]
                starts, ends, by_row = word_bounds(data, offs, ALNUM_SEP)
                lengths[first:end] = np.diff(by_row)
                hit, term = words.find(hasher, data, starts, ends)
                row = np.searchsorted(by_row, hit, "right") - 1
                key, n = np.unique(row * len(terms) + term, return_counts=True)
                rows.append(key // len(terms) + first)
                found.append(key % len(terms))
                counts.append(n)
            held = np.flatnonzero(lengths)
            order = held[np.lexsort((held, ids[held]))]
            place = np.zeros(len(ids), np.int64)
            place[order] = np.arange(len(order))
            rows, found, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, found, counts))
            by = np.lexsort((place[rows], found))
            term, at = np.unique(found[by], return_index=True)
            pack = lambda x, t="<i4": zlib.compress(x.astype(t).tobytes(), 1)
            row = [(part << 32) + k, len(held), int(lengths.sum()), pack(ids[order], "<i8"), pack(lengths[order]), pack(term), pack(np.append(at, len(by))[1:]), pack(place[rows][by]), pack(counts[by])]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int64()] * 3 + [pa.binary()] * 6, strict=True)], names=[n.split()[0] for n in INDEX.split(", ")])

    return docs.select(c(id_col).cast("long"), c(text_col).cast("string")).mapInArrow(build, INDEX)


def _unpack(raw: bytes, t: str = "<i4") -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), t).astype(np.int64)


def term_weights(index: DataFrame, n: int) -> DataFrame:
    """(term, weight): floor(1000 ln((2 N + 2) / (2 df + 1))) of the terms that a document holds."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for terms, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ends = _unpack(ends)
                yield pa.RecordBatch.from_arrays([pa.array(_unpack(terms)), pa.array(np.diff(ends, prepend=0))], names=["term", "df"])

    df = index.select("terms", "ends").mapInArrow(counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return df.select("term", F.floor(1000 * F.ln((2.0 * n + 2) / (2 * c("df") + 1))).cast("long").alias("weight"))


def wand(lists: list[tuple[list[int], list[int], int]], k: int, floor: int) -> list[tuple[int, int]]:
    """(score, place) of the k best documents that score over floor; lists: (places, impacts, largest impact) of each term.

    Of equal scores smaller places win. A place behind the last one ends a list.
    """
    heap: list[tuple[int, int]] = []  # (score, -place)
    limit = floor
    at = [0] * len(lists)
    cursors = sorted((docs[0], t) for t, (docs, _, _) in enumerate(lists))
    while cursors:
        total = 0
        for i, (pivot, t) in enumerate(cursors):
            total += lists[t][2]
            if total > limit:
                break
        else:
            break
        if pivot == END:
            break
        if cursors[0][0] == pivot:
            score, i = 0, 0
            for i, (doc, t) in enumerate(cursors):
                if doc != pivot:
                    break
                docs, impacts, _ = lists[t]
                score += impacts[at[t]]
                at[t] += 1
                cursors[i] = (docs[at[t]], t)
            if score > limit:
                if len(heap) < k:
                    heappush(heap, (score, -pivot))
                else:
                    heapreplace(heap, (score, -pivot))
                if len(heap) == k:
                    limit = max(floor, heap[0][0])  # later documents must beat it: they lose ties
        else:
            for i, (doc, t) in enumerate(cursors):
                if doc >= pivot:
                    break
                docs = lists[t][0]
                at[t] = bisect_left(docs, pivot, at[t])
                cursors[i] = (docs[at[t]], t)
        cursors.sort()
    return [(score, -place) for score, place in heap]


def search(index: DataFrame, items: dict[int, list[int]], weights: dict[int, int], n: int, total: int, k: int, floors: dict[int, int]) -> DataFrame:
    """(item, doc_id, score): the k best of each shard that score over the item's floor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, lengths, terms, ends = _unpack(row["ids"], "<i8"), _unpack(row["lengths"]), _unpack(row["terms"]), _unpack(row["ends"])
                places, tf = _unpack(row["places"]), _unpack(row["tfs"])
                m = 10 + 90 * lengths * n // total
                weight = np.array([weights[t] for t in terms.tolist()], np.int64)
                impacts = np.repeat(weight, np.diff(ends, prepend=0)) * (1_000_000_000 * tf // (1000 * tf + 8 * m[places]))
                lists, begin = {}, 0
                for t, end in zip(terms.tolist(), ends.tolist(), strict=True):
                    own = impacts[begin:end]
                    lists[t] = ([*places[begin:end].tolist(), END], own.tolist(), int(own.max()))
                    begin = end
                hit = []
                for item, asked in items.items():
                    if held := [lists[t] for t in asked if t in lists]:
                        hit += [(item, place, score) for score, place in wand(held, k, floors.get(item, 0))]
                doc = ids[[h[1] for h in hit]] if hit else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hit], pa.int64()), pa.array(doc, mask=doc == NO_ID), pa.array([h[2] for h in hit], pa.int64())], names=["item", "doc_id", "score"])

    return index.mapInArrow(run, "item long, doc_id long, score long")


def _merged(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(best)).where(c("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, seed: int = SEED) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0."""
    asked = materialize(item_terms(items, item_id, item_text), "ranked-items")
    size = asked.agg(F.sum(F.octet_length(F.array_join("terms", "")))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = []
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        rows = own.select("item", "terms").collect()  # at most about block_bytes of terms
        terms = sorted({t for r in rows for t in r.terms})
        if not terms:
            continue
        number = {t: i for i, t in enumerate(terms)}
        index = materialize(build_index(docs, terms, doc_id, doc_text), "ranked-index")
        n, total = index.agg(F.sum("with_terms"), F.sum("terms_total")).first()
        if not n:
            continue
        weights = {r.term: r.weight for r in term_weights(index, n).collect()}  # of the block's terms
        wanted = {r["item"]: [number[t] for t in r.terms if weights.get(number[t], 0) > 0] for r in rows}
        go = lambda of, floors: search(of, wanted, weights, n, total, k, floors)  # noqa: E731, B023
        first = _merged(go(index.where(F.pmod(F.xxhash64("shard"), F.lit(seed)) == 0), {}), k).where(c("rank") == k)
        # a document elsewhere may tie with the k-th of these and have a smaller id
        floors = {r["item"]: r["score"] - 1 for r in first.select("item", "score").collect()}
        best = materialize(_merged(go(index, floors), k), "ranked-hits")
        found.append(best.join(own.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return items.select(c(item_id).alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return reduce(DataFrame.unionByName, found)
