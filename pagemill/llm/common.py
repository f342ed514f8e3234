"""Shared pieces: materialised tables, byte-level word splitting, hashing.

Words are found on UTF-8 bytes, a whole slice of rows at a time. Every
separator of the contracts is an ASCII byte, so splitting bytes and splitting
code points give the same words.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Regex (Java and Python) of a whitespace-separated word.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes handled at once in a worker; a longer text is a slice by itself.
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, else one under the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    return at.rstrip("/") if at else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_pagemill"


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, lost executors cost no recomputation.

    Shuffle files of the finished part are released at the next JVM collection,
    so one is asked for; a long job then holds one phase's shuffle, not all.
    """
    spark, path, schema = df.sparkSession, table_path(df.sparkSession, name), df.schema
    df.write.option("compression", "zstd").parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def buckets(spark: SparkSession, per_partition: int = 1) -> int:
    """Number of hash buckets for a packed exchange; follows the shuffle partitions the cluster is set to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * per_partition)


def single_threaded_blas() -> None:
    """One thread a worker for numpy's small products: more of them wait for each other and cost twice the CPU."""
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        lib = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                break


# ---------------------------------------------------------------- words

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ALNUM_SEP = np.zeros(256, bool)  # separators of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
_ALNUM_SEP[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SPACE, ALNUM_SEP = _SPACE, _ALNUM_SEP


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) of slices of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offs, data = column.buffers()
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        yield first, end, data[offs[first] : offs[end]], offs[first : end + 1] - offs[first]
        first = end


def word_bounds(data: np.ndarray, offs: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and per row the index of its first word (one more entry at the end)."""
    inside = np.empty(len(data) + 1, bool)
    inside[:-1] = ~separators[data]
    inside[-1] = False
    start = inside[:-1].copy()
    start[1:] &= ~inside[:-2]
    cuts = offs[1:-1]
    cuts = cuts[cuts < len(data)]
    start[cuts] = inside[cuts]
    stop = inside[:-1] & ~inside[1:]
    cut_ends = cuts[cuts > 0] - 1
    stop[cut_ends] = inside[cut_ends]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offs)


# ---------------------------------------------------------------- hashing

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hasher:
    """64-bit hashes of byte ranges and of word n-grams; another seed gives an independent lane."""

    def __init__(self, seed: int = 1) -> None:
        with np.errstate(over="ignore"):
            self.table = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed * 0x632BE5AB))
            self.p = int(mix(np.array([seed * 77 + 5], _U))[0]) | 1
            self.k = _U(int(mix(np.array([seed * 91 + 7], _U))[0]) | 1)
        self.inv = pow(self.p, -1, 1 << 64)
        self.pw = self.ipw = np.ones(0, _U)

    def _grow(self, n: int) -> None:
        if n > len(self.pw):
            n = max(n, SLICE_BYTES + (1 << 16))
            base = np.full(n, self.p, _U)
            base[0] = 1
            self.pw = np.multiply.accumulate(base)
            base = np.full(n, self.inv, _U)
            base[0] = 1
            self.ipw = np.multiply.accumulate(base)

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Running sums from which spans() hashes any byte ranges."""
        self._grow(len(data) + 1)
        sums = np.empty(len(data) + 1, _U)
        sums[0] = 0
        np.cumsum(self.table[data] * self.pw[: len(data)], out=sums[1:])
        return sums

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.spans(self.sums(data), starts, ends)

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, _U)
        return mix((sums[ends] - sums[starts]) * self.ipw[starts] + (ends - starts).astype(_U))

    def grams(self, words: np.ndarray, n: int) -> np.ndarray:
        """Hash of words[i:i+n] at each i; rows are not told apart."""
        if len(words) < n:
            return np.zeros(0, _U)
        last = len(words) - n + 1
        g = words[:last].copy()
        for j in range(1, n):
            g *= self.k
            g += words[j : j + last]
        return mix(g + _U(n))


def gram_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Mask over word positions: an n-gram starting there ends in the same row."""
    ok = np.ones(int(first[-1]), bool)
    for j in range(1, n):
        at = first[1:] - j
        ok[at[at >= first[:-1]]] = False
    return ok
