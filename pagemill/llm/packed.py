"""Packed exchange: hash entries of many documents travel as a few binary rows.

A worker hands in entries (document, position, 64-bit hash) of a slice of
documents; they leave as one row per hash bucket holding the documents, their
entry counts, position gaps and hash remainders. Against one row an entry this
cuts a shuffle to 5 to 9 bytes an entry.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: bucket: where the row goes; kind: 0 entries with hashes, 1 places without; uids and docs: keys of the documents present.
SCHEMA = "bucket int, kind int, uids binary, docs binary, counts binary, gaps binary, hashes binary"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
_U = np.uint64


def _squeeze(x: np.ndarray) -> bytes:
    """Bytes by plane, compressed: the high planes of small numbers are all zero."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _widen(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket by the high 32 bits, so that the low ones still tell hashes of a bucket apart."""
    return (((h >> _U(32)) * _U(n)) >> _U(32)).astype(np.int64)


def pack(bucket: np.ndarray, uid: np.ndarray, doc: np.ndarray, row: np.ndarray, pos: np.ndarray, h: np.ndarray | None, width: int = 8) -> Iterator[tuple]:
    """Rows of SCHEMA. uid and doc are by document, the others by entry; width: bytes kept of a hash, from the low end."""
    if not len(bucket):
        return
    order = np.lexsort((pos, row, bucket))
    bucket, row, pos = bucket[order], row[order], pos[order]
    h = None if h is None else h[order].astype("<u4" if width == 4 else "<u8")
    new = np.empty(len(row), bool)
    new[0] = True
    new[1:] = (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])
    gap = pos.copy()
    gap[1:][~new[1:]] -= pos[:-1][~new[1:]]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    first = np.flatnonzero(new)
    first_in = np.searchsorted(first, edges)
    for k in range(len(edges) - 1):
        a, b = edges[k], edges[k + 1]
        f = first[first_in[k] : first_in[k + 1]]
        rows = row[f]
        counts = np.diff(f, append=b)
        yield int(bucket[a]), int(h is None), uid[rows].tobytes(), zlib.compress(np.diff(doc[rows], prepend=0).tobytes(), 1), _squeeze(counts), _squeeze(gap[a:b]), b"" if h is None else h[a:b].tobytes()


def batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES, strict=True)], names=NAMES)


def unpack(table: pa.Table | pa.RecordBatch, kind: int, width: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All entries of a kind: by document uid and doc; by entry index of the document, position and hash."""
    uids, docs, rows, poss, hs, base = [], [], [], [], [], 0
    cols = [table.column(n) for n in NAMES[1:]]
    for i in range(table.num_rows):
        k, uid, doc, counts, gaps, h = (c[i].as_py() for c in cols)
        if k != kind:
            continue
        counts, gap = _widen(counts), _widen(gaps)
        uids.append(np.frombuffer(uid, np.int64))
        docs.append(np.cumsum(np.frombuffer(zlib.decompress(doc), np.int64)))
        starts = np.cumsum(counts) - counts
        run = np.cumsum(gap)
        run -= np.repeat(run[starts] - gap[starts], counts)
        rows.append(np.repeat(np.arange(len(counts)) + base, counts))
        poss.append(run)
        hs.append(np.frombuffer(h, "<u4" if width == 4 else "<u8"))
        base += len(counts)
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    return cat(uids, np.int64), cat(docs, np.int64), cat(rows, np.int64), cat(poss, np.int64), cat(hs, np.uint32 if width == 4 else np.uint64)


def groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, start of each group in it) of equal hashes; the order is stable."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    return order, np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
