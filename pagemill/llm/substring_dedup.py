"""Substring dedup by fixed-block anchors.

Non-overlapping blocks of a document are its anchors; every rolling window of
all documents probes them. Any window of the sought length holds one anchor whole,
so no repeat is missed. Hits are extended: around them, windows of the full
length are compared, and where their runs agree they join to maximal repeats,
whose words go from all documents but that with the smallest id.

Phases (each a packed exchange, written to the shared folder):
1. anchors and probes by block hash -> places where a block is held by two documents;
2. full windows over those places by window hash -> windows that start in a smaller doc_id;
3. those windows back to their documents, whose covered words are cut.

Blocks and windows are first paired within a worker's slice, so a passage that a
third of all documents share sends one entry a slice. No pairs are formed.

Defined results: words are [^\\x20\\x09-\\x0D]+; a null text has none and comes back empty; rows with
equal doc_id never cut each other; a row with a null doc_id is kept as it is and
cuts nothing; an empty table gives an empty result; other columns pass unchanged.
Windows are compared by 64-bit hashes within a hash bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import packed
from .common import SPACE, Hasher, buckets, gram_starts, materialize, text_slices, word_bounds

WINDOW = 13


def block_length(window: int) -> int:
    """Longest block of which a window of that length always holds an aligned one: 2 * block - 1 <= window."""
    return (window + 1) // 2


class _Slice:
    """Words of consecutive rows: bounds, row and position of each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray) -> None:
        self.data = data
        self.starts, self.ends, self.first = word_bounds(data, offs, SPACE)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self.pos = np.arange(len(self.starts)) - self.first[self.row] if len(self.starts) else np.zeros(0, np.int64)


def _anchor_entries(hasher: Hasher, doc: np.ndarray, uid: np.ndarray, s: _Slice, size: int, n: int, salt: int) -> Iterator[tuple]:
    """Entries of a slice for phase 1; blocks shared within it are hits at once and send one entry."""
    h = hasher.grams(hasher.words(s.data, s.starts, s.ends), size)
    at = np.flatnonzero(gram_starts(s.first, size)[: len(h)]) if len(h) else np.zeros(0, np.int64)
    if not len(at):
        return
    h, row, pos = h[at], s.row[at], s.pos[at]
    order, group = packed.groups(h)
    sizes = np.diff(group, append=len(order))
    r = row[order]
    shared = np.minimum.reduceat(r, group) != np.maximum.reduceat(r, group)
    send = np.ones(len(h), bool)
    if shared.any():
        of = np.repeat(np.arange(len(group)), sizes)
        inside = shared[of]
        hit = order[inside]
        yield from packed.pack(np.full(len(hit), salt % n), uid, doc, row[hit], pos[hit], None)
        # the entry sent is an anchor if one is there
        aligned = (pos[order] % size == 0) & inside
        pick = np.full(len(group), -1)
        pick[of[inside][::-1]] = order[inside][::-1]
        pick[of[aligned][::-1]] = order[aligned][::-1]
        send[hit] = False
        send[pick[shared]] = True
    yield from packed.pack(packed.bucket_of(h[send], n), uid, doc, row[send], pos[send], h[send], 4)


def _match_anchors(table: pa.Table, size: int) -> tuple[np.ndarray, ...]:
    """Of one bucket's entries: those whose block is an anchor of one document and held by another."""
    uid, doc, row, pos, h = packed.unpack(table, 0, 4)
    if not len(h):
        return uid, doc, row, pos
    order, group = packed.groups(h)
    r, sizes = row[order], np.diff(group, append=len(order))
    key = uid[r]
    anchored = np.maximum.reduceat(pos[order] % size == 0, group)
    hit = np.repeat(anchored & (np.minimum.reduceat(key, group) != np.maximum.reduceat(key, group)), sizes)
    keep = order[hit]
    return uid, doc, row[keep], pos[keep]


def _route(uid: np.ndarray, doc: np.ndarray, row: np.ndarray, pos: np.ndarray, n: int) -> Iterator[tuple]:
    """Places as rows by the bucket of their document."""
    if len(row):
        yield from packed.pack(np.mod(uid[row], n), uid, doc, row, pos, None)


def _places(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uid, doc, pos) of all places, by uid."""
    uid, doc, row, pos, _ = packed.unpack(table, 1)
    order = np.argsort(uid[row], kind="stable")
    return uid[row][order], doc[row][order], pos[order]


def _mark(s: _Slice, uid: np.ndarray, doc: np.ndarray, known: np.ndarray, places: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Mask over the slice's words that are places."""
    mask = np.zeros(len(s.starts) + 1, bool)
    pu, pd, pp = places
    lo, hi = np.searchsorted(pu, uid, "left"), np.searchsorted(pu, uid, "right")
    for r in np.flatnonzero((hi > lo) & known):
        p = pp[lo[r] : hi[r]][pd[lo[r] : hi[r]] == doc[r]]
        mask[s.first[r] + p] = True
    return mask[:-1]


def _window_entries(hasher: Hasher, doc: np.ndarray, uid: np.ndarray, s: _Slice, near: np.ndarray, window: int, size: int, n: int, salt: int) -> Iterator[tuple]:
    """Full windows that hold a hit block; of those shared within the slice only the smallest document's travel."""
    h = hasher.grams(hasher.words(s.data, s.starts, s.ends), window)
    if not len(h):
        return
    c = np.concatenate(([0], np.cumsum(near)))
    reach = window - size + 1
    holds = c[np.minimum(np.arange(len(h)) + reach, len(c) - 1)] > c[: len(h)]
    at = np.flatnonzero(holds & gram_starts(s.first, window)[: len(h)])
    if not len(at):
        return
    h, row, pos = h[at], s.row[at], s.pos[at]
    order, group = packed.groups(h)
    sizes = np.diff(group, append=len(order))
    d = doc[row[order]]
    later = d > np.repeat(np.minimum.reduceat(d, group), sizes)
    gone, stay = order[later], order[~later]
    yield from packed.pack(np.full(len(gone), salt % n), uid, doc, row[gone], pos[gone], None)
    yield from packed.pack(packed.bucket_of(h[stay], n), uid, doc, row[stay], pos[stay], h[stay], 8)


def _later_windows(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Of one bucket's windows: those that start in a document with a smaller id as well."""
    uid, doc, row, pos, h = packed.unpack(table, 0, 8)
    if not len(h):
        return uid, doc, row, pos
    order, group = packed.groups(h)
    d = doc[row[order]]
    keep = order[d > np.repeat(np.minimum.reduceat(d, group), np.diff(group, append=len(order)))]
    return uid, doc, row[keep], pos[keep]


def _cut(s: _Slice, first_words: np.ndarray, window: int) -> tuple[pa.Array, np.ndarray]:
    """Texts of the slice's rows without the words that windows cover, and how many words went."""
    n = len(s.starts)
    edge = np.zeros(n + window + 1, np.int64)
    np.add.at(edge, np.flatnonzero(first_words), 1)
    np.add.at(edge, np.flatnonzero(first_words) + window, -1)
    keep = np.cumsum(edge)[:n] == 0
    kept = np.flatnonzero(keep)
    last = np.ones(len(kept), bool)
    last[:-1] = s.row[kept[1:]] != s.row[kept[:-1]]
    data = np.append(s.data, np.uint8(0x20))
    step = np.zeros(len(data) + 1, np.int8)
    step[s.starts[kept]] = 1
    step[s.ends[kept]] -= 1
    mask = np.cumsum(step, dtype=np.int8)[:-1].astype(bool)
    gaps = s.ends[kept[~last]]
    data[gaps] = 0x20
    mask[gaps] = True
    lengths = np.bincount(s.row[kept], weights=s.ends[kept] - s.starts[kept] + ~last, minlength=len(s.counts)).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    text = pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[mask].tobytes())])
    return text, np.bincount(s.row[~keep], minlength=len(s.counts)).astype(np.int64)


def substring_dedup(docs: DataFrame, window: int = WINDOW, rejoin: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with text replaced by the words kept, joined by one space, plus n_words and n_removed.

    A column of docs that has one of the two added names is replaced. Without
    rejoin, texts that lose nothing stay as they are.
    """
    spark, size = docs.sparkSession, block_length(window)
    n = buckets(spark)
    schema = T.StructType([f for f in docs.schema.fields if f.name not in ("n_words", "n_removed")])
    docs = docs.select(*[F.col(f"`{f.name}`") for f in schema.fields])
    uid = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), uid.alias("uid"), F.col(text_col).cast("string").alias("text"))

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(1)
        with np.errstate(over="ignore"):
            for b in batches:
                doc, key = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
                for first, end, data, offs in text_slices(b.column(2)):
                    rows = list(_anchor_entries(hasher, doc[first:end], key[first:end], _Slice(data, offs), size, n, int(key[first])))
                    if rows:
                        yield packed.batch(rows)

    def answer(match):  # type: ignore[no-untyped-def]
        def run(table: pa.Table) -> pa.Table:
            rows = list(_route(*match(table), n))
            u, d, r, p, _ = packed.unpack(table, 1)
            rows += _route(u, d, r, p, n)
            return pa.Table.from_batches([packed.batch(rows)])

        return run

    def send_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        hasher, out = Hasher(2), []
        places = _places(right)
        with np.errstate(over="ignore"):
            for b in left.to_batches():
                doc, key = b.column("doc").to_numpy(zero_copy_only=False), b.column("uid").to_numpy(zero_copy_only=False)
                for first, end, data, offs in text_slices(b.column("text")):
                    s, d, k = _Slice(data, offs), doc[first:end], key[first:end]
                    out += _window_entries(hasher, d, k, s, _mark(s, k, d, np.ones(end - first, bool), places), window, size, n, int(k[0]))
        return pa.Table.from_batches([packed.batch(out)])

    names = [f.name for f in schema.fields]
    result = T.StructType([*schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    empty = to_arrow_schema(result).empty_table()

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        places, out = _places(right), []
        for b in left.to_batches():
            ids = b.column("_doc")
            doc, known = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
            key = b.column("_uid").to_numpy(zero_copy_only=False)
            for first, end, data, offs in text_slices(b.column(text_col)):
                s = _Slice(data, offs)
                text, gone = _cut(s, _mark(s, key[first:end], doc[first:end], known[first:end], places), window)
                part = b.slice(first, end - first)
                text = text.cast(pa.string()) if rejoin else pc.if_else(pa.array(gone > 0), text.cast(pa.string()), part.column(text_col))
                cols = [text if c == text_col else part.column(c) for c in names]
                out.append(pa.table([*cols, pa.array(s.counts, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "n_words", "n_removed"]))
        return pa.concat_tables(out) if out else empty

    known = slim.where("doc is not null")
    hits = known.mapInArrow(send_anchors, packed.SCHEMA).groupBy("bucket").applyInArrow(answer(lambda t: _match_anchors(t, size)), packed.SCHEMA)
    hits = materialize(hits, "dedup-hits")
    place = F.pmod("uid", F.lit(n)).cast("int").alias("bucket")
    windows = known.select("*", place).groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(send_windows, packed.SCHEMA)
    removed = materialize(windows.groupBy("bucket").applyInArrow(answer(_later_windows), packed.SCHEMA), "dedup-windows")
    full = docs.select("*", F.col(id_col).cast("long").alias("_doc"), uid.alias("_uid"), F.pmod(uid, F.lit(n)).cast("int").alias("_bucket"))
    return full.groupBy("_bucket").cogroup(removed.select(*packed.NAMES).withColumnRenamed("bucket", "_bucket").groupBy("_bucket")).applyInArrow(cut, result)
