"""Language-model scores: a word unigram base and a causal self-attention model.

1. Workers cut every text into words and subword ids once; the ids of a slice's distinct words and the order of
   its words are stored, and the later steps read these. On the way they count, over all training documents, the words, the
   pairs of subword ids that follow each other, and the contexts of ids; a partition adds up before it sends, sums meet in hash buckets.
2. The attention model takes its classes and the shares of ids in them from these counts. Training
   rows are dealt by hash to shards, whose number follows from the training tokens, and lie by hash in them; each
   shard trains its weights over its own texts, a hash share a round, until every training window was seen
   once; after a round the shards' weights are averaged. The first share is the smallest, so that
   shards part from common weights. Neither the table's partitions nor the cluster's enter, so any partitioning gives equal scores.
3. Every whole text is cut into overlapping windows; each id is scored once, with
   masked attention over batches of windows. Counts of each bucket's most frequent
   words and pairs, bounded tables, are looked up on the way; rarer ones are sent to their
   bucket's counts and their sums return to the document.

Defined results: words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, plus one end a
text; null and empty texts are their end; a null doc_id is neither learned from nor held
out; equal rows get equal rows; without training rows, N and V are 0 and the
network is untrained; an empty table gives an empty result; other columns are ignored.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
import math
from array import array
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed
from .attention import END, START, TRAITS, Local, Net, back_totals, context_sums, hold, make_net, score, trait_vectors
from .common import LOWER, SPACE, Hasher, buckets, materialize, mix, single_threaded_blas, text_slices, word_bounds
from .toxicity import fold

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
FOLDS, HELD_OUT = 10, 0
#: Sixteenths of the training rows, by hash, of each round; after a round weights are averaged.
ROUNDS = (1, 5, 10)
#: Training tokens of a shard: enough steps for weights of its own.
SHARD_TOKENS = 2_000_000
#: Bounds of the words and of the pairs of ids looked up without a shuffle (the most frequent ones), and of a worker's subword cache.
FREQUENT, PAIRS, CACHE = 200_000, 4_000_000, 500_000
#: Counts that a worker holds before it sends them, and ids of a shard that it permutes at once (a longer text is a piece by itself).
HELD, PIECE_IDS = 1 << 21, 1 << 19
ALPHA = 0.1
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Subwords:
    """Ids of words by hash; a word's ids do not depend on its neighbours."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.sp.get_piece_size()
        self.known: dict[int, bytes] = {}

    def of(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one word behind another, ids a word) of distinct words."""
        if len(self.known) > CACHE:
            self.known.clear()
        keys = hashes.tolist()
        got = list(map(self.known.get, keys))
        missing = [i for i, x in enumerate(got) if x is None]
        if missing:
            raw = data.tobytes()
            words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)]
            for i, ids in zip(missing, self.sp.encode(words), strict=True):
                got[i] = self.known[keys[i]] = array("H", ids).tobytes()
        return np.frombuffer(b"".join(got), np.uint16), np.fromiter(map(len, got), np.int64, len(got)) // 2


@functools.lru_cache(1)
def _subwords(model: bytes) -> Subwords:
    """A worker's, which goes on with what earlier tasks have looked up."""
    return Subwords(model)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, ascending; an index of each; which of them each is)."""
    order = np.argsort(x)
    inside = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(inside[1:], inside[:-1], out=new[1:])
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    return inside[new], order[new], which


def _small(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest takes, behind that width."""
    width = 1 if not len(x) or x.max() < 1 << 8 else 2 if x.max() < 1 << 16 else 4
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _large(x: pa.Buffer) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


class _Slice:
    """Words of a slice with the distinct ones told apart, and the ids of these."""

    def __init__(self, hashes: np.ndarray | None, which: np.ndarray, counts: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Of distinct words: hashes, ids one behind another, ids a word; which: of each word; counts: words a row."""
        self.hashes, self.which, self.counts, self.ids, self.sizes = hashes, which, counts, ids, sizes

    @classmethod
    def of(cls, hasher: Hasher, sub: Subwords, data: np.ndarray, offs: np.ndarray) -> _Slice:
        low = LOWER[data]
        starts, ends, first = word_bounds(low, offs, SPACE)
        hashes, one, which = _distinct(hasher.words(low, starts, ends))
        return cls(hashes, which, np.diff(first), *sub.of(hashes, low, starts[one], ends[one]))

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def texts(self, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with their ends, ids a text), or of the rows of a mask."""
        which, counts = (self.which, self.counts) if of is None else (self.which[np.repeat(of, self.counts)], self.counts[of])
        n = self.sizes[which]
        begin = np.cumsum(self.sizes) - self.sizes
        flat = self.ids[np.repeat(begin[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        lengths = np.diff(np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(counts)))])
        return np.insert(flat, np.cumsum(lengths), END), lengths + 1


#: A slice: what its rows are, and the arrays of a _Slice.
_ROWS = ("doc_id", "uid", "held_out", "learn")
_SLICE_TYPES = {"doc_id": pa.list_(pa.int64()), "uid": pa.list_(pa.int64()), "held_out": pa.list_(pa.bool_()), "learn": pa.list_(pa.bool_()), "hashes": pa.binary(), "which": pa.binary(), "counts": pa.binary(), "ids": pa.binary(), "sizes": pa.binary()}
_SLICES = "doc_id array<long>, uid array<long>, held_out array<boolean>, learn array<boolean>, hashes binary, which binary, counts binary, ids binary, sizes binary"


def _packed(rows: pa.RecordBatch, s: _Slice) -> list[pa.Array]:
    lists = [pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(k)) for k in _ROWS]
    return [*lists, *(pa.array([x], pa.binary()) for x in (s.hashes.tobytes(), _small(s.which), _small(s.counts), s.ids.tobytes(), _small(s.sizes)))]


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, pa.Array], _Slice]]:
    """(columns of the rows, their slice); the hashes and columns of rows that are not asked for may be left out."""
    for b in batches:
        names = b.schema.names
        for i in range(b.num_rows):
            at = lambda k, b=b, i=i: b.column(k)[i].as_buffer()
            hashes = np.frombuffer(at("hashes"), "<u8") if "hashes" in names else None
            yield {k: b.column(k)[i].values for k in names if k in _ROWS}, _Slice(hashes, _large(at("which")), _large(at("counts")), np.frombuffer(at("ids"), "<u2"), _large(at("sizes")))


#: kind 0: hashes and counts of words; 1: keys and counts of id pairs; 2: ids, the sums of their contexts and their counts; 3: a number of texts.
_COUNTS = "bucket int, kind int, a binary, b binary, c binary"
_COUNT_TYPES = {"bucket": pa.int32(), "kind": pa.int32(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary()}


def _sum_by(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, an index of each, sums)."""
    some, one, at = _distinct(key)
    return some, one, np.bincount(at, weights=count, minlength=len(some)).astype(np.int64)


class _Tally:
    """Counts of the slices of a partition."""

    def __init__(self, n: int, size: int) -> None:
        self.n, self.size, self.vectors = n, size, trait_vectors(size)
        self._clear()

    def _clear(self) -> None:
        self.words: list[tuple] = []
        self.pairs: list[tuple] = []
        self.sums, self.ids, self.texts, self.held = np.zeros((self.size, TRAITS)), np.zeros(self.size, np.int64), 0, 0

    def add(self, s: _Slice, learn: np.ndarray) -> None:
        """learn: mask of the slice's rows."""
        if not learn.any():
            return
        ids, lengths = s.texts(learn)
        times = np.bincount(s.which[np.repeat(learn, s.counts)], minlength=len(s.hashes))
        here = np.flatnonzero(times)
        self.words.append((s.hashes[here], times[here]))
        key, times = np.unique(_pairs(ids, lengths, self.size), return_counts=True)
        self.pairs.append((key, times))
        self.sums += context_sums(self.vectors, ids, lengths)
        self.ids += np.bincount(ids, minlength=self.size)
        self.texts += len(lengths)
        self.held += len(here) + len(key)

    def rows(self) -> Iterator[tuple]:
        """Rows of _COUNTS of what is held, which is then let go."""
        if self.texts:
            words, _, total = _sum_by(*(np.concatenate([w[i] for w in self.words]) for i in range(2)))
            cut = np.searchsorted(packed.bucket_of(words, self.n), np.arange(self.n + 1))  # hashes ascend, so do their buckets
            for k, (x, y) in enumerate(zip(cut, cut[1:], strict=False)):
                if y > x:
                    yield k, 0, words[x:y].tobytes(), total[x:y].astype("<u4").tobytes(), b""
            key, _, total = _sum_by(np.concatenate([p[0] for p in self.pairs]), np.concatenate([p[1] for p in self.pairs]))
            lane = (key // np.uint32(self.size)) % np.uint32(self.n)
            order = np.argsort(lane, kind="stable")
            key, total = key[order], total[order]
            cut = np.searchsorted(lane[order], np.arange(self.n + 1))
            for k, (x, y) in enumerate(zip(cut, cut[1:], strict=False)):
                if y > x:
                    yield k, 1, key[x:y].tobytes(), total[x:y].astype("<u4").tobytes(), b""
            some = np.flatnonzero(self.ids)
            if len(some):
                yield int(some[0]) % self.n, 2, some.astype("<u4").tobytes(), self.sums[some].astype("<f4").tobytes(), self.ids[some].astype("<u4").tobytes()
            yield 0, 3, np.array([self.texts], "<i8").tobytes(), b"", b""
        self._clear()


def _pairs(ids: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Keys of each id with the one before it."""
    current = np.empty(len(ids), np.uint32)
    current[1:] = ids[:-1]
    current[np.cumsum(lengths) - lengths] = START
    return current * np.uint32(size) + ids.astype(np.uint32)


def _cut(docs: DataFrame, model: bytes) -> DataFrame:
    """docs(doc_id, uid, held_out, learn, text): rows of _SLICES of all texts, and rows of _COUNTS of the training texts."""
    n = buckets(docs.sparkSession)
    types = _SLICE_TYPES | {"c_" + k: t for k, t in _COUNT_TYPES.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded_blas()
        hasher, sub = Hasher(5), _subwords(model)
        tally = _Tally(n, sub.size)

        def send() -> pa.RecordBatch:
            rows = list(tally.rows())
            counts = [pa.array([r[i] for r in rows], t) for i, t in enumerate(_COUNT_TYPES.values())]
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), t) for t in _SLICE_TYPES.values()), *counts], names=list(types))

        with np.errstate(over="ignore"):
            for b in batches:
                for first, end, data, offs in text_slices(b.column("text")):
                    s, rows = _Slice.of(hasher, sub, data, offs), b.slice(first, end - first)
                    tally.add(s, rows.column("learn").to_numpy(zero_copy_only=False).astype(bool))
                    yield pa.RecordBatch.from_arrays([*_packed(rows, s), *(pa.nulls(1, t) for t in _COUNT_TYPES.values())], names=list(types))
                    if tally.held > HELD:
                        yield send()
        yield send()

    return docs.mapInArrow(run, f"{_SLICES}, c_{_COUNTS.replace(', ', ', c_')}")


_SUMS = "bucket int, kind int, words binary, counts binary, top binary, top_counts binary, n long, v long, texts long"


def _add_up(frequent: int, pairs: int):  # type: ignore[no-untyped-def]
    """One bucket's counts of a kind. Words and pairs: all, and the most frequent ones apart; ids: sums of contexts, and counts as top."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        kind = key[1].as_py()
        a, b = (table.column(k).to_pylist() for k in ("a", "b"))
        cat = lambda xs, t: np.frombuffer(b"".join(xs), t)
        words, counts, top, top_counts, n, v, texts = b"", b"", b"", b"", 0, 0, 0
        if kind == 3:
            texts = int(cat(a, "<i8").sum())
        elif kind == 2:
            some, at = np.unique(cat(a, "<u4"), return_inverse=True)
            sums = cat(b, "<f4").reshape(-1, TRAITS)
            sums = np.column_stack([np.bincount(at, weights=sums[:, d], minlength=len(some)) for d in range(TRAITS)])
            words, counts = some.tobytes(), sums.astype("<f8").tobytes()
            top = np.bincount(at, weights=cat(table.column("c").to_pylist(), "<u4"), minlength=len(some)).astype("<i8").tobytes()
        else:
            some, _, total = _sum_by(cat(a, "<u8" if kind == 0 else "<u4"), cat(b, "<u4"))
            best = np.sort(np.argsort(-total, kind="stable")[: frequent if kind == 0 else pairs])
            words, counts, n, v = some.tobytes(), total.tobytes(), int(total.sum()), len(some)
            top, top_counts = some[best].tobytes(), total[best].tobytes()
        row = {"bucket": key[0].as_py(), "kind": kind, "words": words, "counts": counts, "top": top, "top_counts": top_counts, "n": n, "v": v, "texts": texts}
        fields = [pa.int32(), pa.int32(), *[pa.binary()] * 4, *[pa.int64()] * 3]
        return pa.table({k: pa.array([x], t) for (k, x), t in zip(row.items(), fields, strict=True)})

    return run


def lm_score(docs: DataFrame, tokenizer: str = TOKENIZER, frequent: int = FREQUENT, pairs: int = PAIRS, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """docs(doc_id, text) -> RESULT; n_known counts tokens that training documents hold.

    rounds: sixteenths of the training rows of each round of training.
    """
    spark = docs.sparkSession
    n = buckets(spark)
    with open(tokenizer, "rb") as f:
        model = f.read()
    remainder = fold(F.col("doc_id"), FOLDS)
    is_fold = lambda x: F.coalesce(x, F.lit(False))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("uid"), is_fold(remainder == HELD_OUT).alias("held_out"), is_fold(remainder != HELD_OUT).alias("learn"), F.col("text").cast("string").alias("text"))

    cut = materialize(_cut(slim, model), "lm-cut")
    slices = cut.where("c_kind is null").select(*_SLICE_TYPES)
    counted = cut.where("c_kind is not null").select(*(F.col("c_" + k).alias(k) for k in _COUNT_TYPES))
    summed = materialize(counted.groupBy("bucket", "kind").applyInArrow(_add_up(-(-frequent // n), -(-pairs // n)), _SUMS), "lm-counts")
    # bounded: a few numbers, at most frequent + n words, pairs + n pairs, TRAITS numbers an id
    total = lambda k: F.coalesce(F.sum(k), F.lit(0))
    words_n, words_v, texts = summed.where("kind in (0, 3)").agg(total("n"), total("v"), total("texts")).first()
    train_tokens, train_words = words_n + texts, words_v + (texts > 0)

    def held(kind: int, t: str) -> tuple[np.ndarray, np.ndarray]:
        rows = summed.where(F.col("kind") == kind).select("top", "top_counts").collect()
        key = np.concatenate([np.zeros(0, t), *(np.frombuffer(bytes(r.top), t) for r in rows)])
        counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(bytes(r.top_counts), np.int64) for r in rows)])
        order = np.argsort(key)
        return key[order], counts[order]

    top, top_counts = held(0, "<u8")
    pair, pair_counts = held(1, "<u4")
    size = _subwords(model).size
    id_counts, sums = np.zeros(size), np.zeros((size, TRAITS))
    for r in summed.where("kind = 2").select("words", "counts", "top").collect():
        some = np.frombuffer(bytes(r.words), "<u4")
        sums[some] += np.frombuffer(bytes(r.counts), "<f8").reshape(-1, TRAITS)
        id_counts[some] += np.frombuffer(bytes(r.top), "<i8")
    net = make_net(id_counts, sums)
    hold(net, pair, pair_counts, *_back_totals(summed, net.cls))
    # pairs that the model does not hold are looked up in their buckets, as rarer words are
    more = bool(summed.where("kind = 1").agg(total("v")).first()[0] > len(pair))
    _train_all(net, slices, rounds, max(1, round(train_tokens / SHARD_TOKENS)))
    denominator = np.log10(train_tokens + ALPHA * (train_words + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded_blas()
        for docs, s in _unpacked(batches):
            with np.errstate(over="ignore"):
                ids, lengths = s.texts()
                lm = score(net, ids, lengths) / np.log(10)
                spot = np.minimum(np.searchsorted(top, s.hashes), max(0, len(top) - 1))
                found = top[spot] == s.hashes if len(top) else np.zeros(len(s.hashes), bool)
                logs = np.where(found, np.log10(top_counts[spot] + ALPHA), 0.0) if len(top) else np.zeros(len(s.hashes))
                rows, row = len(s.counts), s.row
                base = np.bincount(row, weights=logs[s.which], minlength=rows) + np.log10(texts + ALPHA)
                known = np.bincount(row, weights=found[s.which], minlength=rows).astype(np.int64) + (texts > 0)
                yield _out(docs, pa.array(s.counts + 1, pa.int64()), pa.array(known), pa.array(base), pa.array(lm), [])
                # rarer words: distinct ones of a row with how often they come, as position
                rare = np.flatnonzero(~found[s.which])
                pair, times = np.unique(row[rare] * np.int64(max(1, len(s.hashes))) + s.which[rare], return_counts=True)
                r, w = pair // max(1, len(s.hashes)), pair % max(1, len(s.hashes))
                k = docs["uid"].to_numpy(zero_copy_only=False)
                sent = list(packed.pack(packed.bucket_of(s.hashes[w], n), k, np.zeros(rows, np.int64), r, times, s.hashes[w], 8)) if len(r) else []
                if more:
                    key = _pairs(ids, lengths, size)
                    rest = np.flatnonzero(~net.holds(key))
                    both, times = np.unique((np.repeat(np.arange(rows), lengths)[rest] << 32) + key[rest].astype(np.int64), return_counts=True)
                    r, h = both >> 32, (both & 0xFFFFFFFF).astype(np.uint64)
                    sent += packed.pack(n + (h // np.uint64(size)).astype(np.int64) % n, k, np.zeros(rows, np.int64), r, times, h, 8)
                if sent:
                    yield _out(None, None, None, None, None, sent)

    schema = f"doc_id long, uid long, held_out boolean, n_tokens long, known long, base double, lm double, {packed.SCHEMA}"
    scored = materialize(slices.mapInArrow(run, schema), "lm-scored")
    asked = scored.where("bucket is not null").select(*packed.NAMES)

    bare = replace(net, pair=net.pair[:0], pair_ln=net.pair_ln[:0])

    def answer(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        of_pairs = key[0].as_py() >= n
        uid, _, row, times, h = packed.unpack(left, 0, 8)
        words = np.frombuffer(right.column("words")[0].as_py(), np.uint32 if of_pairs else np.uint64).astype(np.uint64) if right.num_rows else np.zeros(0, np.uint64)
        counts = np.frombuffer(right.column("counts")[0].as_py(), np.int64) if right.num_rows else np.zeros(0, np.int64)
        c = np.zeros(len(h), np.int64)
        if len(words):
            spot = np.minimum(np.searchsorted(words, h), len(words) - 1)
            c = np.where(words[spot] == h, counts[spot], 0)
        who, at = np.unique(uid[row], return_inverse=True)
        base, known, lm = np.zeros((3, len(h)))
        if of_pairs:
            lm = bare.rest(h.astype(np.uint32), c) / np.log(10) if len(words) else lm
        else:
            base, known = np.log10(c + ALPHA), c > 0
        sums = lambda x: np.bincount(at, weights=times * x, minlength=len(who))
        return pa.table({"uid": pa.array(who), "rare_base": pa.array(sums(base), pa.float64()), "rare_known": pa.array(sums(known).astype(np.int64)), "rare_lm": pa.array(sums(lm), pa.float64())})

    held_counts = summed.where(F.col("kind") <= int(more)).select((F.col("bucket") + F.col("kind") * n).alias("bucket"), "words", "counts")
    parts = asked.groupBy("bucket").cogroup(held_counts.groupBy("bucket")).applyInArrow(answer, "uid long, rare_base double, rare_known long, rare_lm double")
    rare = parts.groupBy("uid").agg(*(F.sum(x).alias(x) for x in ("rare_base", "rare_known", "rare_lm")))
    rows = scored.where("bucket is null")
    # equal rows have sent their rare words as often as they are there
    same = rows.groupBy("uid").agg(F.count("*").alias("same"))
    rare = rare.join(same, "uid").select("uid", (F.col("rare_base") / F.col("same")).alias("rare_base"), (F.col("rare_known") / F.col("same")).cast("long").alias("rare_known"), (F.col("rare_lm") / F.col("same")).alias("rare_lm"))
    out = rows.join(rare, "uid", "left")
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(denominator))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(train_tokens)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("lm") + F.coalesce("rare_lm", F.lit(0.0))).alias("score"))


def _back_totals(summed: DataFrame, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """back_totals over all pairs; a current id's pairs lie in one bucket, and there are at most ids * CLASSES rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                back, total, kinds = back_totals(cls, np.frombuffer(words, "<u4"), np.frombuffer(counts, "<i8"))
                yield pa.RecordBatch.from_pydict({"back": [back.astype("<u4").tobytes()], "total": [total.astype("<f8").tobytes()], "kinds": [kinds.astype("<i8").tobytes()]})

    rows = summed.where("kind = 1").select("words", "counts").mapInArrow(run, "back binary, total binary, kinds binary").collect()
    back, total, kinds = (np.frombuffer(b"".join(bytes(r[i]) for r in rows), t) for i, t in enumerate(("<u4", "<f8", "<i8")))
    order = np.argsort(back)
    return back[order], total[order], kinds[order]


def _rows_of_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, ids of texts, ids a text) in pieces of about PIECE_IDS that depend on the shard's rows alone."""
    held: list[bytes] = []
    shard, size = None, 0
    piece = lambda: (shard, np.frombuffer(b"".join(held), "<u2"), np.array([len(x) // 2 for x in held], np.int64))
    for b in batches:
        for ids, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if held and (own != shard or size >= PIECE_IDS):
                yield piece()
                held, size = [], 0
            shard = own
            held.append(ids)
            size += len(ids) // 2
    if held:
        yield piece()


def _shares(slices: DataFrame, low: int, high: int, shards: int) -> DataFrame:
    """(part, uid, ids) of the training rows whose sixteenth, by hash, is low to high - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, s in _unpacked(batches):
            uid = docs["uid"].to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                lot = mix(uid.astype(np.uint64))
                sixteenth = lot % np.uint64(16)
                mine = docs["learn"].to_numpy(zero_copy_only=False).astype(bool) & (sixteenth >= np.uint64(low)) & (sixteenth < np.uint64(high))
                part = (mix(lot + np.uint64(1)) % np.uint64(shards)).astype(np.int32)
            ids, lengths = s.texts(mine)
            # binary, as Arrow has it: the ids are the bytes, their ends the offsets
            offs = np.concatenate(([0], np.cumsum(2 * lengths))).astype(np.int32)
            texts = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(part[mine]), pa.array(uid[mine]), texts], names=["part", "uid", "ids"])

    return slices.select("uid", "learn", "which", "counts", "ids", "sizes").mapInArrow(run, "part int, uid long, ids binary")


def _train_all(net: Net, slices: DataFrame, rounds: tuple[int, ...], shards: int) -> int:
    """Trains net over all windows of the training rows of slices, each once if rounds add up to 16; returns how many they are."""
    names = sorted(net.p)
    groups = math.isqrt(shards) + 1
    schema = "part int, windows long, weights binary"
    fields = pa.schema([("part", pa.int32()), ("windows", pa.int64()), ("weights", pa.binary())])
    seen = 0
    for nth, share in enumerate(rounds):

        def run(batches: Iterator[pa.RecordBatch], nth: int = nth) -> Iterator[pa.RecordBatch]:
            single_threaded_blas()
            local, shard = None, None

            def done() -> pa.RecordBatch:
                local.update()
                weights = np.concatenate([local.p[k].ravel() for k in names]).astype("<f8") * local.windows
                return pa.RecordBatch.from_pylist([{"part": shard, "windows": local.windows, "weights": weights.tobytes()}], fields)

            for own, ids, lengths in _rows_of_shards(batches):
                if own != shard:
                    if local is not None:
                        yield done()
                    shard, local = own, Local(net, (own << 8) + nth)
                local.add(ids, lengths)
            if local is not None:
                yield done()

        def add_up(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: r["part"])
            weights = np.zeros(len(rows[0]["weights"]) // 8)
            for r in rows:
                weights += np.frombuffer(r["weights"], "<f8")
            return pa.Table.from_pylist([{"part": rows[0]["part"], "windows": sum(r["windows"] for r in rows), "weights": weights.tobytes()}], fields)

        low = sum(rounds[:nth])
        share = _shares(slices, low, low + share, shards)
        share = share.repartition(max(1, min(shards, buckets(slices.sparkSession))), "part").sortWithinPartitions("part", "uid").select("ids", "part")
        # sums of about a square root of the shards reach the driver
        sums = share.mapInArrow(run, schema).groupBy(F.col("part") % groups).applyInArrow(add_up, schema).collect()
        windows = sum(r.windows for r in sums)
        if windows:
            mean = sum((np.frombuffer(bytes(r.weights), "<f8") for r in sorted(sums, key=lambda r: r.part)), np.zeros(1)) / windows
            cut = np.cumsum([net.p[k].size for k in names])[:-1]
            net.p = {k: x.reshape(net.p[k].shape).astype(np.float32) for k, x in zip(names, np.split(mean, cut), strict=True)}
        seen += windows
    return seen


def _out(rows: dict[str, pa.Array] | None, n_tokens, known, base, lm, sent: list[tuple]) -> pa.RecordBatch:  # type: ignore[no-untyped-def]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = ["doc_id", "uid", "held_out", "n_tokens", "known", "base", "lm", *packed.NAMES]
    if rows is not None:
        docs = [rows["doc_id"], rows["uid"], rows["held_out"], n_tokens, known, base, lm]
        return pa.RecordBatch.from_arrays([*docs, *(pa.nulls(len(known), t) for t in packed.TYPES)], names=names)
    return pa.RecordBatch.from_arrays([*(pa.nulls(len(sent), t) for t in kinds), *packed.batch(sent).columns], names=names)
