"""Whitening of embeddings by TSQR.

Entries c become integers x = floor(64 c) + 1,000,000. Sums of each dimension are exact
integers, so a row is centred as (n x - S) / n with one rounding. Each partition reduces its
centred rows to a triangular factor, a chunk at a time; factors are merged by a tree of
further QRs, FAN at a time; the singular values and right vectors of the last factor give
eigenvalues and components. No covariance is formed on the way; that of the whitened rows is
taken afterwards, to report how far it is from the identity.

One task holds at most FAN factors of d x d and a chunk of rows; the driver sees the d sums
and the kept components.

Defined results: vectors that are null or hold null or non-finite entries are left out;
missing entries of shorter vectors count as 0; null and repeated ids are rows like others;
a component without variance (below rounding) has a null whitened value and no part in
identity_error; an empty table gives no rows. deviation is null beyond 64 bits. Other
columns of the table are ignored. Equal eigenvalues have any basis of their space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, single_threaded_blas

SCALE, SHIFT = 64, 1_000_000
#: Components that are returned.
COMPONENTS = 32
#: Factors merged by one task.
FAN = 8
#: Bytes of centred rows that are reduced at once.
CHUNK_BYTES = 8 << 20

c = F.col


def usable(vector: Column) -> Column:
    """Whether a vector and all its entries are there and finite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def integers(docs: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x array<long>) of the usable rows."""
    whole = F.transform(vector_col, lambda e: F.floor(SCALE * e.cast("double")).cast("long") + SHIFT)
    return docs.where(usable(c(vector_col))).select(c(id_col).cast("long").alias("vec_id"), whole.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list<long> column; missing entries are those of 0."""
    flat, offs = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    lens = np.diff(offs)
    if len(lens) and (lens == d).all():
        return flat.reshape(-1, d)
    out = np.full((len(lens), d), SHIFT, np.int64)
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(offs[:-1] - offs[0], lens)] = flat
    return out


def dimension_sums(rows: DataFrame, d: int) -> DataFrame:
    """(dim, n, s): exact sums of each dimension, added up in the partitions first."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros(d, np.int64)
        for b in batches:
            n, s = n + b.num_rows, s + _matrix(b.column(0), d).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(s)], names=["dim", "n", "s"])

    return rows.select("x").mapInArrow(add, "dim int, n long, s long").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def _chunks(batches: Iterator[pa.RecordBatch], at: int, d: int) -> Iterator[np.ndarray]:
    step = max(1, CHUNK_BYTES // (8 * d))
    for b in batches:
        for i in range(0, b.num_rows, step):
            yield _matrix(b.column(at).slice(i, step), d)


def _triangle(parts: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(parts), mode="r")


def _packed(key: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], names=["part", "r"])


def triangles(rows: DataFrame, n: int, sums: np.ndarray) -> DataFrame:
    """(part, r): the triangular factor of each partition's centred rows."""
    d = len(sums)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        single_threaded_blas()
        r = None
        for x in _chunks(batches, 0, d):
            centred = (n * x - sums) / n
            r = _triangle([centred] if r is None else [r, centred])
        if r is not None:
            yield _packed(TaskContext.get().partitionId(), r)

    return rows.select("x").mapInArrow(reduce, "part long, r binary")


def merged(factors: DataFrame, d: int) -> DataFrame:
    """One level of the tree: the factors of FAN neighbours become one."""
    def merge(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded_blas()
        r = None
        for b in group:
            for raw in b.column(b.schema.get_field_index("r")):
                own = np.frombuffer(raw.as_py()).reshape(-1, d)
                r = own if r is None else _triangle([r, own])
        yield _packed(key[0].as_py(), r)

    parent = F.floor(c("part") / FAN).cast("long")
    return factors.select(parent.alias("up"), "part", "r").groupBy("up").applyInArrow(merge, "part long, r binary")


def components(rows: DataFrame, n: int, sums: np.ndarray, keep: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, component vectors as columns, trace) of the covariance, from the last factor."""
    d = len(sums)
    factors = materialize(triangles(rows, n, sums), "whitening-r")
    top = factors.agg(F.max("part")).first()[0]
    while top > 0:
        factors, top = materialize(merged(factors, d), "whitening-r"), top // FAN

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded_blas()
        for b in batches:
            for raw in b.column(0):
                _, s, vt = np.linalg.svd(np.frombuffer(raw.as_py()).reshape(-1, d), full_matrices=False)
                k = min(keep, len(s))
                yield pa.RecordBatch.from_arrays([pa.array(s[:k] ** 2 / n), pa.array([np.ascontiguousarray(v).tobytes() for v in vt[:k]], pa.binary()), pa.array(np.full(k, (s**2).sum() / n))], names=["e", "v", "trace"])

    # at most keep rows of d numbers
    found = factors.select("r").mapInArrow(split, "e double, v binary, trace double").orderBy(F.desc("e")).collect()
    return np.array([f.e for f in found]), np.array([np.frombuffer(f.v) for f in found]).T, found[0].trace


def _projected(rows: DataFrame, n: int, sums: np.ndarray, axes: np.ndarray) -> DataFrame:
    """(vec_id, x, w array<double>): centred rows on the scaled axes."""
    d, k = axes.shape

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded_blas()
        for b in batches:
            w = [(n * x - sums) / n @ axes for x in _chunks(iter([b]), 1, d)]
            flat = np.concatenate(w).reshape(-1) if w else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(np.arange(0, k * b.num_rows + 1, k, dtype=np.int32), pa.array(flat))], names=["vec_id", "x", "w"])

    return rows.select("vec_id", "x").mapInArrow(project, "vec_id long, x array<long>, w array<double>")


def identity_error(whitened: DataFrame, n: int, live: np.ndarray) -> float:
    """Largest entry of the covariance of w (components in live) minus the identity; centred by the mean before multiplying."""
    k = len(live)
    if not live.any():
        return 0.0

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            yield b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)[:, live]

    m = int(live.sum())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _cells(sum((w.sum(0) for w in rows_of(batches)), np.zeros(m)))

    def _cells(values: np.ndarray) -> pa.RecordBatch:
        flat = values.reshape(-1)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["cell", "v"])

    total = lambda f: {r.cell: r.v for r in whitened.select("w").mapInArrow(f, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()}  # noqa: E731  # m * m cells at most
    mean = total(add)
    mean = np.array([mean[i] for i in range(m)]) / n

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single_threaded_blas()
        yield _cells(sum(((w - mean).T @ (w - mean) for w in rows_of(batches)), np.zeros((m, m))))

    cov = total(products)
    return float(np.abs(np.array([cov[i] for i in range(m * m)]).reshape(m, m) / n - np.eye(m)).max())


def whiten(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = materialize(integers(docs, id_col, vector_col), "whitening-x")
    d = rows.agg(F.max(F.size("x"))).first()[0]
    if not d:
        return docs.sparkSession.createDataFrame([], schema)
    found = {r.dim: r for r in dimension_sums(rows, d).collect()}  # d rows
    n, sums = found[0].n, np.array([found[i].s for i in range(d)])
    e, v, trace = components(rows, n, sums, keep)
    # a null direction comes out at the size of rounding: of the largest singular value, and of a unit of x in n rows
    live = e > max(e.max() * (np.finfo(float).eps * max(d, 8)) ** 2 * n, 1e-18)
    axes = np.where(live, v / np.sqrt(np.where(live, e, 1)), 0)
    out = materialize(_projected(rows, n, sums, axes), "whitening-w")
    off = identity_error(out, n, live)
    away = F.transform("x", lambda x, i: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), x), F.get(F.array(*[F.lit(int(s)) for s in sums]), i)))
    pad = F.sequence(F.lit(0), F.lit(d - 1))
    x = F.when(F.size("x") == d, c("x")).otherwise(F.transform(pad, lambda i: F.coalesce(F.get(c("x"), i), F.lit(SHIFT).cast("long"))))
    deviation = F.aggregate(away, F.lit(0).cast("long"), lambda a, y: F.try_add(a, F.try_multiply(y, y)))
    shares = F.array(*[F.lit(float(s)) for s in (e / trace if trace else np.zeros(len(e)))])
    out = out.withColumn("x", x).select("vec_id", deviation.alias("deviation"), F.posexplode("w").alias("at", "y"))
    alive = F.array(*[F.lit(bool(a)) for a in live])
    return out.select("vec_id", (c("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(F.get(alive, c("at")), c("y")).alias("whitened"), F.get(shares, c("at")).alias("explained"), F.lit(off).alias("identity_error"))
