"""N-gram Jaccard join with vertical partitioning.

A document is the set of its word n-grams. Equal sets are one class. The global
n-gram order (of their hashes) is cut into fragments; of each candidate pair,
every fragment counts the overlap of its two segments, and the counts are summed per
pair, which gives exact similarities.

Candidates, without loss:
1. A set with a partner of similarity s misses at most n - ceil(s n) of its n-grams
   elsewhere. Half of the n-grams by hash (all of short sets) are counted over all classes;
   classes that miss more are done.
2. Of the others, two sets of similarity s share one of the first n - ceil(s n) + 1
   n-grams of the order (prefix filter). In each list of a prefix n-gram, members
   pair with one leader; the links found make components. A second round has more leaders, for members
   unlike the first ones.
3. The rest meet in lists of signatures: n-grams fall into more parts than two similar sets can
   differ in, so such sets agree in a whole part; the parts' contents are the signatures. Lists that hold several
   components pair all members of different ones. A set's signatures follow from its own size, so their number grows
   with the sets, however often an n-gram occurs, and a common passage makes no long lists.
4. A pair goes on if its sizes fit, if it has no
   earlier list among the last SEEN ones of both, and if parity sketches (a lower bound of the symmetric
   difference, of about two bits an n-gram) allow the similarity. Pairs refused once are not asked again, members of
   one component never pair again: a group of thousands of near copies costs a multiple of its size.

Verification deals pairs to cells by their side of fewer pairs, so a leader of many is copied to
the cells of its members and no cell grows with a group.

Defined results: null and empty texts have n_shingles 0 and link with nothing;
a text of fewer words than n is one n-gram; rows with equal doc_id are documents of
their own; a null doc_id takes part, and counts as component only of groups without
other ids; an empty table gives an empty result; other columns are ignored. n-grams
and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import packed
from .common import LOWER, SPACE, Hasher, buckets, gram_starts, materialize, mix, text_slices, word_bounds
from .components import components

N, PERCENT = 5, 80
#: Sets up to that size have all n-grams counted in step 1; smaller ones' partners are no larger than it.
SHORT = 64
#: Bits of a parity sketch at least and at most; between them about two an n-gram.
SKETCH_BITS = (128, 2048)
#: Members of a list compared at once; pairs whose sketches are compared at once.
BLOCK, PAIR_BLOCK, JUDGED = 512, 1 << 14, 1 << 18
#: Lists of up to so many members are paired all at once.
SMALL = 32
#: Lists of prefix n-grams of up to so many members are compared in step 3 too, and only the classes of longer ones by signatures; 0: all by signatures.
HOT = 0
#: Earlier lists of a member that travel with it.
SEEN = 4
#: Pieces of the global n-gram order.
FRAGMENTS = 4
#: Orders from which the lists of each round take their leaders: at most so many pairs a member.
LEADERS = (4, 32)
_U = np.uint64


def row_shingles(data: np.ndarray, offs: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-grams of a slice's rows, by row and hash."""
    low = LOWER[data]
    starts, ends, first = word_bounds(low, offs, SPACE)
    counts = np.diff(first)
    hasher = Hasher(3)
    words = hasher.words(low, starts, ends)
    row_of = np.repeat(np.arange(len(counts)), counts)
    h = hasher.grams(words, n)
    at = np.flatnonzero(gram_starts(first, n)[: len(h)]) if len(h) else np.zeros(0, np.int64)
    rows, hashes = [row_of[at]], [h[at]]
    for k in range(1, n):
        r = np.flatnonzero(counts == k)
        if len(r):
            rows.append(r)
            hashes.append(hasher.grams(words, k)[first[r]])
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def set_hash(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: a hash of its set, and the set's size."""
    size = np.bincount(row, minlength=rows)
    total = np.concatenate((np.zeros(1, _U), np.cumsum(mix(h ^ _U(0x5851F42D4C957F2D)))))
    last = np.cumsum(size)
    return mix(total[last] - total[last - size] + size.astype(_U)).view(np.int64), size


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """Members that a set of size n shares with a partner at least."""
    return -(-n * percent // 100)


def _sets(batch: pa.RecordBatch, column: int, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for first, end, data, offs in text_slices(batch.column(column)):
        row, h = row_shingles(data, offs, n)
        cls, size = set_hash(row, h, end - first)
        yield first, end, row, h, cls, size


def _short_limit(percent: int) -> int:
    return SHORT * percent // 100


def _sampled(h: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks over n-grams (with their sets' sizes): counted over all classes; decisive for their own set."""
    half = h < _U(1 << 63)
    return half | (size <= SHORT), half | (size <= _short_limit(percent))


def _count_entries(row: np.ndarray, h: np.ndarray, cls: np.ndarray, size: np.ndarray, percent: int, n: int, salt: int) -> Iterator[tuple]:
    """Step 1 entries of a slice, one set a class; position 2j+1 marks n-grams that are counted already or not decisive."""
    _, firsts = np.unique(cls, return_index=True)
    mine = np.zeros(len(cls), bool)
    mine[firsts] = True
    sent, decisive = _sampled(h, size[row], percent)
    use = sent & mine[row]
    row, h, decisive = row[use], h[use], decisive[use]
    if not len(h):
        return
    order, group = packed.groups(h)
    sizes = np.diff(group, append=len(order))
    shared = np.repeat(sizes > 1, sizes)  # one entry a class and n-gram: two are two classes
    local = order[shared]
    found = np.bincount(row[local[decisive[local]]], minlength=len(cls))
    r = np.flatnonzero(found)
    zero = np.zeros(len(cls), np.int64)
    yield from packed.pack(np.full(len(r), salt % n), cls, zero, r, found[r], None)
    send = np.ones(len(h), bool)
    send[local] = False
    heads = order[group[sizes > 1]]
    send[heads] = True
    done = ~decisive
    done[heads] = True
    ordinal = np.arange(len(h)) - np.searchsorted(row, row)
    yield from packed.pack(packed.bucket_of(h[send], n), cls, zero, row[send], (2 * ordinal + done)[send], h[send], 4)


def _found(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(class, n-grams also in other classes) of one bucket's entries."""
    cls, _, row, pos, h = packed.unpack(table, 0, 4)
    if not len(h):
        return cls[:0], row[:0]
    order, group = packed.groups(h)
    r = row[order]
    several = np.minimum.reduceat(cls[r], group) != np.maximum.reduceat(cls[r], group)
    hit = order[np.repeat(several, np.diff(group, append=len(order)))]
    hit = hit[pos[hit] % 2 == 0]
    c, counts = np.unique(cls[row[hit]], return_counts=True)
    return c, counts


def shared_counts(docs: DataFrame, n_gram: int, percent: int) -> DataFrame:
    """(cls, found): how many of a class's decisive n-grams another class has."""
    n = buckets(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                for first, _, row, h, cls, size in _sets(b, 0, n_gram):
                    rows = list(_count_entries(row, h, cls, size, percent, n, int(cls[0])))
                    if rows:
                        yield packed.batch(rows)

    def route(cls: np.ndarray, counts: np.ndarray) -> list[tuple]:
        return list(packed.pack(np.mod(cls, n), cls, np.zeros(len(cls), np.int64), np.arange(len(cls)), counts, None)) if len(cls) else []

    def match(table: pa.Table) -> pa.Table:
        cls, _, row, pos, _ = packed.unpack(table, 1)
        return pa.Table.from_batches([packed.batch(route(*_found(table)) + route(cls[row], pos))])

    def total(table: pa.Table) -> pa.Table:
        cls, _, row, pos, _ = packed.unpack(table, 1)
        c, at = np.unique(cls[row], return_inverse=True)
        return pa.table({"cls": pa.array(c, pa.int64()), "found": pa.array(np.bincount(at, weights=pos, minlength=len(c)).astype(np.int64))})

    matched = docs.mapInArrow(send, packed.SCHEMA).groupBy("bucket").applyInArrow(match, packed.SCHEMA)
    return matched.groupBy("bucket").applyInArrow(total, "cls long, found long")


# ---------------------------------------------------------------- candidates


def sketch_bytes(n: np.ndarray) -> np.ndarray:
    """Bytes of the sketches of sets of these sizes."""
    low, high = SKETCH_BITS
    return (1 << np.ceil(np.log2(np.clip(2 * n, low, high))).astype(np.int64)) // 8


def sketches(row: np.ndarray, h: np.ndarray, size: np.ndarray) -> pa.Array:
    """Parity bitmaps: the bits in which two of them differ are at most the members of one set alone.

    Bits are hashes modulo a power of two, so a longer sketch folds to a shorter one by XOR of its parts.
    """
    width = sketch_bytes(size)
    offset = np.concatenate(([0], np.cumsum(width)))
    bit = 8 * offset[row] + (mix(h) & (8 * width[row] - 1).astype(_U)).astype(np.int64)
    parity = np.bincount(bit, minlength=8 * int(offset[-1])) & 1
    data = np.packbits(parity.astype(np.uint8))
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offset.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


class _Sketches:
    """Sketches of a batch, by their length."""

    def __init__(self, column: pa.Array | pa.ChunkedArray) -> None:
        column = pa.chunked_array([column]) if isinstance(column, pa.Array) else column
        raw = column.to_pylist()
        self.width = np.array([len(x) for x in raw], np.int64)
        self.place = np.zeros(len(raw), np.int64)
        self.of = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))
            self.of[w] = np.frombuffer(b"".join([raw[i] for i in at]), np.uint64).reshape(len(at), -1)

    def folded(self, at: np.ndarray, width: int, to: int) -> np.ndarray:
        x = self.of[width][self.place[at]]
        return x if width == to else np.bitwise_xor.reduce(x.reshape(len(x), -1, to // 8), axis=1)


def _apart(a: _Sketches, x: np.ndarray, b: _Sketches, y: np.ndarray) -> np.ndarray:
    """Bits in which sketches x of a and y of b differ, at the shorter one's length."""
    out = np.zeros(len(x), np.int64)
    for wx in a.of:
        for wy in b.of:
            at = np.flatnonzero((a.width[x] == wx) & (b.width[y] == wy))
            to = min(wx, wy)
            for i in range(0, len(at), PAIR_BLOCK):
                k = at[i : i + PAIR_BLOCK]
                out[k] = np.bitwise_count(a.folded(x[k], wx, to) ^ b.folded(y[k], wy, to)).sum(axis=1, dtype=np.int64)
    return out


def _allowed(apart: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """|A ^ B| <= (na + nb) (100 - p) / (100 + p) where the similarity is reached."""
    return apart * (100 + percent) <= (na + nb) * (100 - percent)


def size_classes(most: int, percent: int) -> np.ndarray:
    """Bounds of size classes: a set's partners are in its own class or the two beside it."""
    bounds = [1]
    while bounds[-1] <= most:
        bounds.append(max(bounds[-1] + 1, (bounds[-1] - 1) * 100 // percent + 1))
    return np.array([*bounds, max(bounds[-1] + 1, (bounds[-1] - 1) * 100 // percent + 1)])


def signatures(row: np.ndarray, h: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) by row: contents of the parts of each set, in the parts of its size class and of the class below.

    Sets of which the smaller is in class c differ in at most d n-grams. Of d + 1 + e parts, e + 1 at
    least hold the same; they are told by their contents. Where two sets agree in parts without
    any alone, both have many of those: such sets are told by their prefix n-grams too.
    """
    bounds = size_classes(int(size.max(initial=1)), percent)
    own = np.searchsorted(bounds, size, "right") - 1
    small = np.maximum(bounds[1:] - 1, 1)
    differ = (small + small * 100 // percent) * (100 - percent) // (100 + percent)
    spare = -(-differ * 8 // 100) + 4
    prefix = np.arange(len(h)) - np.searchsorted(row, row) <= (size - _need(size, percent))[row]
    rows, keys = [], []
    for below in (0, 1):
        c = own - below
        parts = (differ + 1 + spare)[np.maximum(c, 0)]
        use = (c >= 0)[row]
        r, g = row[use], mix(h[use] ^ _U(0x2545F4914F6CDD1D))
        at = r * int(parts.max(initial=1)) + (g % parts[r].astype(_U)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        at, r, g = at[order], r[order], g[order]
        if not len(at):
            continue
        start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        content = np.add.reduceat(mix(g + _U(0x9E3779B97F4A7C15)), start)
        place = (at[start] - r[start] * int(parts.max())).astype(_U)
        filled = np.bincount(r[start], minlength=len(size))
        few = np.flatnonzero(prefix & ((c >= 0) & (parts - filled > spare[np.maximum(c, 0)]))[row])
        rows += [row[few], r[start]]
        keys += [mix(h[few] ^ mix(c[row[few]].astype(_U) + _U(77))), mix(content ^ mix(place * _U(0xD1342543DE82EF95) + c[r[start]].astype(_U)))]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(row, kind="stable")
    return row[order], key[order]


def _leader_pairs(sets: DataFrame, groups: DataFrame, seed: int, leaders: int, percent: int) -> DataFrame:
    """Distinct (a, b, na, nb) with a < b: members of each n-gram's list with a leader of another component.

    Lists take one of so many orders of classes, so that a group meets few leaders, the same in most of
    its lists. Only pairs whose sketches allow the similarity are left.
    """
    lists = sets.select("cls", "n", "grams").join(groups, "cls").select("cls", "n", "comp", F.explode("grams").alias("gram"))
    order = F.struct(F.xxhash64("cls", F.pmod("gram", F.lit(leaders)), F.lit(seed)).alias("o"), "cls", "n", "comp")
    lead = lists.groupBy("gram").agg(F.min(order).alias("l"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
    lead = lead.select("gram", F.col("l.cls").alias("b"), F.col("l.n").alias("nb"), F.col("l.comp").alias("other"))
    pairs = lists.withColumnsRenamed({"cls": "a", "n": "na"}).join(lead, "gram").where("comp <> other").where((F.least("na", "nb") * 100) >= (F.greatest("na", "nb") * percent))
    swap = F.col("a") > F.col("b")
    pick = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
    pairs = pairs.select(pick("a", "b", "a"), pick("b", "a", "b"), pick("na", "nb", "na"), pick("nb", "na", "nb")).distinct()
    sketch = sets.select("cls", "sketch")
    pairs = pairs.join(sketch.withColumnsRenamed({"cls": "a", "sketch": "sa"}), "a").join(sketch.withColumnsRenamed({"cls": "b", "sketch": "sb"}), "b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                every = np.arange(b.num_rows)
                apart = _apart(_Sketches(b.column(4)), every, _Sketches(b.column(5)), every)
                ok = _allowed(apart, b.column(2).to_numpy(), b.column(3).to_numpy(), percent)
                yield b.select(["a", "b", "na", "nb"]).filter(pa.array(ok))

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(near, PAIRS)


def _pool(sets: DataFrame, groups: DataFrame, column: str, hot: int = 0) -> tuple[DataFrame, DataFrame]:
    """(members of lists that hold several components, one row a member and list; (gram) of lists of more than hot members, if hot).

    A row has its rank in the member's lists and the lists before it. Which lists these are is found on bare
    (cls, place, gram) rows; only then do sketches join, so that they travel once.
    """
    lists = sets.select("cls", column).join(groups, "cls").select("cls", "comp", F.posexplode(column).alias("at", "gram"))
    mixed = materialize(lists.groupBy("gram").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("k")).where("x <> y").select("gram", "k"), "ngram-lists")
    short, crowded = (mixed.where(F.col("k") <= hot), mixed.where(F.col("k") > hot)) if hot else (mixed, mixed.limit(0))
    held = lists.join(short.select("gram"), "gram").groupBy("cls", "comp").agg(F.collect_list("at").alias("places"))
    rows = sets.select("cls", "n", "sketch", column).join(held, "cls").select("cls", "n", "sketch", "comp", column, F.explode("places").alias("at"))
    seen = F.slice(column, F.greatest(F.col("at") - (SEEN - 1), F.lit(1)), F.least("at", F.lit(SEEN)))
    return rows.select(F.get(column, "at").alias("gram"), "cls", "n", "sketch", "comp", "at", seen.alias("seen")), crowded.select("gram")


def _candidates(sets: DataFrame, groups: DataFrame, percent: int, hot: int = HOT) -> DataFrame:
    """Distinct (a, b, na, nb), a < b, of members of one list in different components."""
    some, short = sets, None
    if hot:
        short, crowded = _pool(sets, groups, "grams", hot)
        held = sets.select("cls", F.explode("grams").alias("gram")).join(crowded, "gram").select("cls").distinct()
        some = sets.join(materialize(held, "ngram-crowded"), "cls", "left_semi")
    pool = _pool(some, groups, "parts")[0].drop("at").withColumn("rank", F.lit(0))  # signatures have no rank
    if short is not None:
        pool = pool.unionByName(short.withColumnRenamed("at", "rank"))
    pool = pool.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets(sets.sparkSession, 4))))
    return pool.groupBy("bucket").applyInArrow(lambda t: _cross_pairs(t, percent), PAIRS).distinct()


def _may_pair(x: np.ndarray, y: np.ndarray, n: np.ndarray, comp: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """Mask: x and y are in different components, their sizes fit, and behind their ranks enough n-grams are left on both sides."""
    nx, ny = n[x], n[y]
    need = -(-(nx + ny) * percent // (100 + percent))
    return (comp[x] != comp[y]) & (ny * percent <= nx * 100) & (nx * percent <= ny * 100) & (rank[x] <= nx - need) & (rank[y] <= ny - need)


def _list_pairs(starts: np.ndarray, ends: np.ndarray, n: np.ndarray, comp: np.ndarray, rank: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that may be similar of members of one list; lists are runs of rows by ascending size."""
    size = np.repeat(ends - starts, ends - starts)
    stop = np.repeat(ends, ends - starts)
    for d in range(1, SMALL):  # short lists all at once, by distance of their members
        x = np.flatnonzero((size <= SMALL) & (np.arange(len(n)) + d < stop))
        if not len(x):
            break
        x = x[_may_pair(x, x + d, n, comp, rank, percent)]
        yield x, x + d
    for a, b in zip(starts[ends - starts > SMALL].tolist(), ends[ends - starts > SMALL].tolist(), strict=True):
        names, counts = np.unique(comp[a:b], return_counts=True)
        # every pair has a member outside the largest component
        outside = a + np.flatnonzero(comp[a:b] != names[np.argmax(counts)])
        is_outside = np.zeros(b - a, bool)
        is_outside[outside - a] = True
        for i in range(0, len(outside), BLOCK):
            o = outside[i : i + BLOCK]
            low, high = a + np.searchsorted(n[a:b], -(-n[o[0]] * percent // 100)), a + np.searchsorted(n[a:b], n[o[-1]] * 100 // percent, "right")
            for j in range(low, high, BLOCK):
                at = np.arange(j, min(j + BLOCK, high))
                x, y = np.broadcast_to(o[:, None], (len(o), len(at))).ravel(), np.broadcast_to(at[None, :], (len(o), len(at))).ravel()
                ok = _may_pair(x, y, n, comp, rank, percent) & (~is_outside[y - a] | (y > x))
                yield x[ok], y[ok]


def _cross_pairs(table: pa.Table, percent: int) -> pa.Table:
    """Pairs of one bucket's lists in different components whose sketches allow the similarity."""
    gram, cls, n, comp, rank = (table.column(c).to_numpy().astype(np.int64) for c in ("gram", "cls", "n", "comp", "rank"))
    order = np.lexsort((n, gram))
    gram, cls, n, comp, rank = gram[order], cls[order], n[order], comp[order], rank[order]
    table = table.select(["sketch", "seen"]).take(pa.array(order))
    sketch = _Sketches(table.column("sketch"))
    lists = table.column("seen").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    width = lists.value_lengths().to_numpy()
    seen, filled = np.zeros((len(cls), SEEN), np.int64), np.arange(SEEN)[None, :] < width[:, None]
    seen[filled] = lists.flatten().to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    out, waiting = [], []

    def judge() -> None:
        x, y = (np.concatenate(z) for z in zip(*waiting, strict=True))
        waiting.clear()
        # a pair with an earlier list in common is met there
        before = np.zeros(len(x), bool)
        for i in range(SEEN):
            for j in range(SEEN):
                before |= (seen[x, i] == seen[y, j]) & filled[x, i] & filled[y, j]
        x, y = x[~before], y[~before]
        apart = _apart(sketch, x, sketch, y)
        ok = _allowed(apart, n[x], n[y], percent)
        out.append(np.stack([x[ok], y[ok]]))

    count = 0
    for x, y in _list_pairs(starts, np.append(starts[1:], len(gram)), n, comp, rank, percent):
        waiting.append((x, y))
        count += len(x)
        if count >= JUDGED:
            judge()
            count = 0
    if waiting:
        judge()
    at = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    at = np.where(cls[at[0]] < cls[at[1]], at, at[::-1]) if at.shape[1] else at
    pairs = np.unique(np.stack([cls[at[0]], cls[at[1]], n[at[0]], n[at[1]]], axis=1), axis=0) if at.shape[1] else np.zeros((0, 4), np.int64)
    return pa.table({k: pa.array(pairs[:, i], pa.int64()) for i, k in enumerate(("a", "b", "na", "nb"))})


PAIRS = "a long, b long, na long, nb long"

# ---------------------------------------------------------------- verification


def _fragments(row: np.ndarray, h: np.ndarray, rows: int) -> pa.Array:
    """Per row (hashes ascend in it) its segments in the FRAGMENTS pieces of the order, as lists of binaries."""
    piece = (h >> _U(64 - FRAGMENTS.bit_length() + 1)).astype(np.int64)
    ends = np.searchsorted(row * FRAGMENTS + piece, np.arange(rows * FRAGMENTS), "right")
    offsets = np.concatenate(([0], ends)) * 8
    blobs = pa.Array.from_buffers(pa.binary(), rows * FRAGMENTS, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(h.astype("<u8").tobytes())])
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * FRAGMENTS, pa.int32()), blobs)


def _overlaps(seg: pa.Table, ask: pa.Table) -> pa.Table:
    """Of one cell and fragment: (a, b, na, nb, both) of the pairs, both counted within the fragment."""
    a, b = ask.column("a").to_numpy(), ask.column("b").to_numpy()
    both = np.zeros(len(a), np.int64)
    if len(a) and len(seg):
        who = seg.column("cls").to_numpy()
        order = np.argsort(who)
        blobs = seg.column("segment").to_pylist()
        blobs = [blobs[i] for i in order]
        who = who[order]
        size = np.array([len(x) // 8 for x in blobs])
        start = np.concatenate(([0], np.cumsum(size)))
        tok, ids = np.unique(np.frombuffer(b"".join(blobs), "<u8"), return_inverse=True)
        m = max(1, len(tok))
        key = np.repeat(np.arange(len(who)), size) * m + ids  # ascends: tokens do in each segment
        ia, ib = np.searchsorted(who, a), np.searchsorted(who, b)
        done = 0
        while done < len(a) and len(key):
            # as many pairs as ask for some million tokens
            end = max(done + 1, int(np.searchsorted(np.cumsum(size[ia[done:]]), 1 << 22, "right")) + done)
            x, y = ia[done:end], ib[done:end]
            k = size[x]
            of = np.repeat(np.arange(len(x)), k)
            j = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k) + start[x][of]
            want = y[of] * m + ids[j]
            spot = np.minimum(np.searchsorted(key, want), len(key) - 1)
            both[done:end] = np.bincount(of, weights=key[spot] == want, minlength=len(x))
            done = end
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "na": ask.column("na"), "nb": ask.column("nb"), "both": pa.array(both, pa.int64())})


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs with the similarity: overlaps are counted in each fragment and summed per pair."""
    cells = buckets(pairs.sparkSession)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("d"))
    dealt = pairs.join(degree.withColumnsRenamed({"cls": "a", "d": "da"}), "a").join(degree.withColumnsRenamed({"cls": "b", "d": "db"}), "b")
    cell = F.pmod(F.xxhash64(F.when(F.col("da") <= F.col("db"), F.col("a")).otherwise(F.col("b"))), F.lit(cells)).cast("int")
    dealt = materialize(dealt.select("a", "b", "na", "nb", cell.alias("cell")), "ngram-dealt")
    wanted = dealt.select(F.explode(F.array("a", "b")).alias("cls"), "cell").distinct()
    segments = sets.select("cls", "segments").join(wanted, "cls").select("cell", "cls", F.posexplode("segments").alias("fragment", "segment"))
    asked = dealt.select("a", "b", "na", "nb", F.col("cell").alias("at"), F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("piece"))
    partial = segments.groupBy("cell", "fragment").cogroup(asked.groupBy("at", "piece")).applyInArrow(_overlaps, "a long, b long, na long, nb long, both long")
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("both").alias("both"))
    return total.where(F.expr(f"100 * both >= {percent} * (na + nb - both)")).select("a", "b")


def ngram_components(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """docs -> (doc_id, n_shingles, component_id, row_id): row_id is the hash of id and text."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("row_id"), F.col(text_col).cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                for first, end, row, h, cls, size in _sets(b, 2, n):
                    _, decisive = _sampled(h, size[row], percent)
                    asked = np.bincount(row, weights=decisive, minlength=end - first).astype(np.int64)
                    cols = [b.column(0).slice(first, end - first), b.column(1).slice(first, end - first), pa.array(cls), pa.array(size, pa.int64()), pa.array(asked)]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row_id", "cls", "n", "asked"])

    signed = materialize(slim.mapInArrow(sign, "doc_id long, row_id long, cls long, n long, asked long"), "ngram-signed")
    classes = signed.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.min("row_id").alias("rep"), F.first("n").alias("n"), F.first("asked").alias("asked"))
    found = shared_counts(slim.select("text"), n, percent)
    # (n * percent + 99) div 100 members are shared with a partner
    alive = classes.join(found, "cls").where(F.expr(f"asked - found <= n - (n * {percent} + 99) div 100")).select("cls", "rep", "n")
    alive = materialize(alive, "ngram-alive")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(row: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), pa.array(values.view(np.int64)))

        with np.errstate(over="ignore"):
            for b in batches:
                for _, end, row, h, cls, size in _sets(b, 0, n):
                    k = len(cls)
                    use = np.arange(len(h)) - np.searchsorted(row, row) < (size - _need(size, percent) + 1)[row]
                    cols = [pa.array(cls), pa.array(size, pa.int64()), sketches(row, h, size), lists(row[use], h[use], k), lists(*signatures(row, h, size, percent), k), _fragments(row, h, k)]
                    yield pa.RecordBatch.from_arrays(cols, names=["cls", "n", "sketch", "grams", "parts", "segments"])

    # how many are left grows with the input, so they are not broadcast; equal rows have one hash
    texts = slim.join(alive.select(F.col("rep").alias("row_id")).hint("merge"), "row_id").groupBy("row_id").agg(F.first("text").alias("text"))
    sets = materialize(texts.select("text").mapInArrow(describe, "cls long, n long, sketch binary, grams array<long>, parts array<long>, segments array<binary>"), "ngram-sets")
    groups = sets.select("cls", F.col("cls").alias("comp"))
    asked, links = None, None
    for step in [*range(len(LEADERS)), None]:
        pairs = _candidates(sets, groups, percent, hot) if step is None else _leader_pairs(sets, groups, step, LEADERS[step], percent)
        pairs = pairs if asked is None else pairs.join(asked.select("a", "b"), ["a", "b"], "left_anti")
        pairs = materialize(pairs, "ngram-pairs")
        new = materialize(verify(pairs, sets, percent), "ngram-links")
        asked = pairs if asked is None else asked.unionByName(pairs)
        links = new if links is None else links.unionByName(new)
        if step is None or not new.isEmpty():
            found = components(links).withColumnRenamed("node", "cls")
            groups = materialize(sets.select("cls").join(found, "cls", "left").select("cls", F.coalesce("component", "cls").alias("comp")), "ngram-groups")
    every = groups

    joined = materialize(classes.select("cls", "least").join(every, "cls", "left").select("cls", "least", F.coalesce("comp", "cls").alias("comp")), "ngram-classes")
    named = joined.join(joined.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("cls", "component_id")
    out = signed.join(named, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "row_id")
