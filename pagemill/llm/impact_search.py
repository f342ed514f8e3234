"""Exact top-k inner products by an impact-ordered index, score at a time.

Components become integers. The index is cut into shards of vectors; a shard holds, for each
dimension, its postings in falling order of quantised impact (levels of equal width of the
component's size), and the vectors themselves. A level of a dimension is a segment. A query
takes the segments of all dimensions in falling order of |query component| x impact and adds
each member's largest possible contribution to its accumulator. Members of segments not yet
taken can add at most the next segment's impact in each dimension that is left, so every
vector has an upper bound at any time. The query stops once few vectors can still reach its
k-th best exact score; all that can are rescored exactly. What is left out is thus proven
to be worse, and a query whose proof fails goes on, to the last segment if it must.

Queries travel in blocks, to each shard: a task joins one block and one shard, so neither
is ever whole in one place. Each shard's k best are merged by query.

Defined results: vectors that are null or hold null or non-finite components take no part;
missing components of shorter vectors count as 0, so an empty vector scores 0; a row without
an id is a candidate (behind all ids on ties) and no query; rows with equal ids are rows of
their own, and only the query's own row is no candidate of it; a query without candidates
has no rows; an empty table gives none. Scores must fit 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .whitening import usable

SCALE = 256
#: Components of a shard's vectors, and queries of a block.
SHARD_CELLS, BLOCK_ROWS = 1 << 20, 256
#: Impact levels of a dimension in a shard.
LEVELS = 32
#: Shares of a shard's postings after which a query looks whether it can stop.
STOPS = (0.5, 0.65, 0.8, 1.0)
#: It stops when at most this share of the shard can still be among the best.
FEW = 1 / 8

INDEX = "shard int, uids binary, ids binary, vectors binary, places binary, ends binary, width binary"
HITS = "uid long, query_id long, vec_id long, score long"
NO_ID = np.iinfo(np.int64).max

c = F.col


def integers(docs: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(uid, vec_id, x array<long>) of the usable rows; uid tells rows apart."""
    x = F.transform(vector_col, lambda e: F.floor(SCALE * e.cast("double")).cast("long"))
    return docs.where(usable(c(vector_col))).select(c(id_col).cast("long").alias("vec_id"), x.alias("x")).withColumn("uid", F.monotonically_increasing_id())


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, lens = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(lens) and (lens == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(lens), d), np.int64)
    first = np.cumsum(lens) - lens
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(first, lens)] = flat
    return out


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _small(x: np.ndarray) -> bytes:
    """One byte that names the type, and x in the narrowest of three."""
    top = int(np.abs(x).max(initial=0))
    kind = "i2" if top < 1 << 15 else "i4" if top < 1 << 31 else "i8"
    return kind[1].encode() + x.astype(f"<{kind}").tobytes()


def _large(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[:1].decode()}", offset=1).astype(np.int64)


def build_index(rows: DataFrame, shards: int, d: int) -> DataFrame:
    """INDEX: one row a shard."""
    def build(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["uid"].to_numpy(), _ids(table["vec_id"])))
        x = _matrix(table["x"], d)[order]
        size = np.abs(x)
        width = size.max(0, initial=0) // LEVELS + 1
        level = (size // width).astype(np.int64)
        places = np.argsort(-level, axis=0, kind="stable")
        # levels fall from LEVELS - 1 to 0; where each segment ends in its dimension's list
        ends = np.cumsum([(level == v).sum(0) for v in range(LEVELS - 1, -1, -1)], axis=0)
        row = [table["shard"][0].as_py(), table["uid"].to_numpy()[order].tobytes(), _ids(table["vec_id"])[order].tobytes(), _small(x), _small(places.T), _small(ends.T), _small(width)]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), *[pa.binary()] * 6], strict=True)], names=[n.split()[0] for n in INDEX.split(", ")])

    return rows.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, INDEX)


class Shard:
    """A shard's postings, ready for queries."""

    def __init__(self, row: dict, d: int) -> None:
        self.uids, self.ids = np.frombuffer(row["uids"], np.int64), np.frombuffer(row["ids"], np.int64)
        n = len(self.ids)
        self.x = _large(row["vectors"]).reshape(n, d)
        self.places, self.ends, width = _large(row["places"]).reshape(d, n), _large(row["ends"]).reshape(d, LEVELS), _large(row["width"])
        steps = np.arange(LEVELS - 1, -1, -1)
        levels = np.repeat(np.tile(steps, d), np.diff(self.ends, axis=1, prepend=0).reshape(-1)).reshape(d, n)
        low = levels * width[:, None]
        high = low + width[:, None] - 1
        negative = np.take_along_axis(self.x.T, self.places, 1) < 0
        #: largest value of a posting's component, and of its negative, by its quantised impact
        self.most = (np.where(negative, -low, high).astype(np.float64), np.where(negative, high, -low).astype(np.float64))
        self.edge = ((steps[None, :] + 1) * width[:, None] - 1).astype(np.float64)  # upper edge of each segment
        self.top = int(np.abs(self.x).max(initial=0))

    def best(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of the k best, own row excluded, ties to smaller ids."""
        n = len(self.ids)
        dims = np.flatnonzero(q)
        possible = np.arange(n)
        if len(dims) and n > 4 * k and int(np.abs(q).max()) * (self.top + LEVELS + 1) * len(q) ** 2 < 1 << 48:  # bounds are exact in doubles
            possible = self._possible(q, dims, own, k)
        possible = possible[self.uids[possible] != own]
        scores = self.x[possible] @ q
        order = np.lexsort((possible, -scores))[:k]  # rows lie by id
        return possible[order], scores[order]

    def _possible(self, q: np.ndarray, dims: np.ndarray, own: int, k: int) -> np.ndarray:
        """Rows that can be among the k best, proven by upper bounds."""
        n, weight = len(self.ids), np.abs(q[dims]).astype(np.float64)
        impact = (weight[:, None] * self.edge[dims]).reshape(-1)
        sizes = np.diff(self.ends[dims], axis=1, prepend=0).reshape(-1)
        order = np.argsort(-impact, kind="stable")
        done = np.cumsum(sizes[order])
        # bound and number of postings seen in one sum: a posting counts as unit, more than twice any bound
        unit = float(1 << int(2 * weight.sum() * (self.top + LEVELS + 1)).bit_length())
        total = np.zeros(n)
        at, cut = 0, np.zeros(len(dims), np.int64)
        for share in STOPS:
            end = int(np.searchsorted(done, share * done[-1], "left")) + 1
            taken = order[at:end]
            if not len(taken):
                continue
            at = end
            upto = cut.copy()
            np.maximum.at(upto, taken // LEVELS, taken % LEVELS + 1)  # impacts fall along a dimension: a run of segments
            runs = [(j, self.ends[dims[j], cut[j] - 1] if cut[j] else 0, self.ends[dims[j], upto[j] - 1]) for j in np.flatnonzero(upto > cut)]
            cut = upto
            places = np.concatenate([self.places[dims[j], a:b] for j, a, b in runs])
            adds = np.concatenate([self.most[int(q[dims[j]] < 0)][dims[j], a:b] * weight[j] + unit for j, a, b in runs])
            total += np.bincount(places, adds, n)
            seen = np.rint(total / unit)
            rest = impact[order[at]] if at < len(order) else 0.0
            upper = total - seen * unit + rest * (len(dims) - seen)  # no segment that is left has more than rest
            first = np.argpartition(-upper, k)[: k + 1]
            first = first[self.uids[first] != own]
            kth = np.sort(self.x[first] @ q)[-k]
            possible = np.flatnonzero(upper >= kth)
            if len(possible) <= max(4 * k, FEW * n):
                break
        return possible


def search(index: DataFrame, shards: int, queries: DataFrame, blocks: int, k: int, d: int) -> DataFrame:
    """HITS: each shard's k best of each query; queries(block, uid, vec_id, x)."""
    sent = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(asked: pa.Table, own: pa.Table) -> pa.Table:
        uids, ids, hits, scores = [], [], [], []
        for row in own.to_pylist():
            shard = Shard(row, d)
            x = _matrix(asked["x"], d)
            for i, (uid, vec_id) in enumerate(zip(asked["uid"].to_pylist(), asked["vec_id"].to_pylist(), strict=True)):
                found, score = shard.best(x[i], uid, k)
                uids += [uid] * len(found)
                ids += [vec_id] * len(found)
                hits.append(shard.ids[found])
                scores.append(score)
        hit = np.concatenate(hits) if hits else np.zeros(0, np.int64)
        score = np.concatenate(scores) if scores else np.zeros(0, np.int64)
        return pa.Table.from_arrays([pa.array(uids, pa.int64()), pa.array(ids, pa.int64()), pa.array(hit, mask=hit == NO_ID), pa.array(score, pa.int64())], names=["uid", "query_id", "vec_id", "score"])

    return sent.groupBy("shard", "block").cogroup(held.groupBy("shard", "block")).applyInArrow(run, HITS)


def top_k(docs: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each row for which is_query holds."""
    schema = "query_id long, rank int, vec_id long, score long"
    spark = docs.sparkSession
    rows = materialize(integers(docs, id_col, vector_col), "search-x")
    n, d = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    asked = rows.where(F.coalesce(is_query, F.lit(False)))
    asking = asked.count()
    if not asking or n < 2:
        return spark.createDataFrame([], schema)
    shards, blocks = -(-n * max(d, 1) // SHARD_CELLS), -(-asking // BLOCK_ROWS)
    index = materialize(build_index(rows, shards, d), "search-index")
    hits = search(index, shards, asked.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(blocks)).cast("int")), blocks, k, d)
    best = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return hits.withColumn("rank", F.row_number().over(best)).where(c("rank") <= k).select("query_id", "rank", "vec_id", "score")
