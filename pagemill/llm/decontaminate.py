"""Benchmark decontamination by SimHash over item-sized windows.

Windows of a document as long as an item get a 128-bit SimHash of their word
shingles. Fingerprints are cut into radius + 1 blocks; two fingerprints within the
radius agree in one block at least, so joining on (length, block, bits) returns
all of them. Blocks are wide, so few others meet. Pairs beyond the radius are found by shingles: of an
item's least ones, one more than a match may lack, a matching window holds one. Candidates are verified by the
exact weighted similarity of their shingles: sum of the smaller counts over sum of the larger.

A window that reaches the threshold shares percent of the item's shingles. Windows are fingerprinted wherever
a document holds FEW percent of the shingles of an item of that length: far fewer than a match, so none is
missed, but not in texts that have nothing of the benchmark. Only built-in functions run.

A window that would run over the end of its document is clipped there, down to the length that can still share enough:
an item that lacks its last words, or is longer than the document, is found.

Defined results: words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; null and empty
texts and items match nothing; an item of under five words is one shingle of its
words; equal rows of documents give one result row, equal item_ids with different texts
are one item that any of them can match; a null doc_id is reported as null;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize

N, PERCENT = 5, 80
#: Bits of a fingerprint, and in how many of them fingerprints of pairs that the index finds differ at most: 10 blocks of 12 or 13 bits.
#: At similarity 0.8 fingerprints differ in 20 +- 6 bits; such pairs are found by their shingles.
BITS, RADIUS = 128, 9
#: Percent of an item's shingles that a document holds within a window that is fingerprinted; at most the threshold.
FEW = 25
#: Shingles of all items up to which they are broadcast; beyond it, both sides are shuffled.
BROADCAST_SHINGLES = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_hashes(text: Column) -> Column:
    words = F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def grams(words: str, n: int) -> Column:
    """Hashes of the n-grams of an array column of word hashes."""
    at = F.sequence(F.lit(0), F.size(words) - n)
    hashed = F.transform(at, lambda i: F.xxhash64(*[F.get(F.col(words), i + j) for j in range(n)]))
    return F.when(F.size(words) >= n, hashed).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: Column) -> Column:
    """BITS bits as an array of longs: each bit is the majority of that bit in the shingles; ties are 0. A lane has hashes of its own."""
    def lane(k: int) -> Column:
        hashed = shingles if k == 0 else F.transform(shingles, lambda x: F.xxhash64(x, F.lit(k)))
        bit = lambda b: F.when(2 * F.aggregate(hashed, F.lit(0), lambda n, x: n + F.call_function("getbit", x, b).cast("int")) > F.size(hashed), F.lit(1)).otherwise(F.lit(0))
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", bit(b).cast("long"), b)))

    return F.array(*[lane(k) for k in range(BITS // 64)])


def hamming(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)


def blocks(fingerprint: Column, radius: int) -> Column:
    """Array of (block, bits): radius + 1 parts of the fingerprint, told by a hash; a part may lie across two longs."""
    cuts, out = [BITS * k // (radius + 1) for k in range(radius + 2)], []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        parts = []
        for word in range(a // 64, (b - 1) // 64 + 1):
            low, high = max(a, 64 * word) - 64 * word, min(b, 64 * word + 64) - 64 * word
            whole = F.shiftrightunsigned(F.get(fingerprint, F.lit(word)), low)
            parts.append(whole if high - low == 64 else whole.bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long")))
        out.append(F.struct(F.lit(k).alias("block"), F.xxhash64(*parts).alias("bits")))
    return F.array(*out)


def as_multiset(shingles: Column) -> Column:
    """Distinct stand-ins: the k-th of equal shingles differs from the others."""
    s = F.sort_array(shingles)
    return F.transform(s, lambda x, i: F.xxhash64(x, i.cast("long") - F.array_position(s, x)))


def _need(n: Column, percent: int) -> Column:
    """Shingles that a window shares with an item of n shingles at least."""
    return F.floor((n * percent + 99) / F.lit(100)).cast("int")


def prepare_items(items: DataFrame, n: int, radius: int) -> DataFrame:
    """(item_id, length, gram, shingles, marked, fingerprint) of items with words; gram: words of a shingle."""
    d = items.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("w")).where(F.size("w") > 0)
    d = d.withColumn("length", F.size("w")).withColumn("gram", F.least("length", F.lit(n)))
    shingle = F.lit(None).cast("array<bigint>")
    for g in range(1, n + 1):
        shingle = F.when(F.col("gram") == g, grams("w", g)).otherwise(shingle)
    d = d.select("item_id", "length", "gram", shingle.alias("shingles"))
    return d.withColumn("marked", as_multiset(F.col("shingles"))).withColumn("fingerprint", simhash(F.col("shingles")))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = N, percent: int = PERCENT, radius: int = RADIUS, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> (doc_id, item_id, similarity, start_word, hamming, row_id): the best window of each pair."""
    items = materialize(prepare_items(items, n, radius), "leak-items")
    keys = items.select("length", "gram", F.explode("shingles").alias("shingle")).distinct()
    keys = materialize(keys.groupBy("shingle").agg(F.collect_set(F.struct("length", "gram")).alias("of")), "leak-keys")
    small = keys.count() <= broadcast_shingles
    sizes = sorted(r[0] for r in items.select("gram").distinct().collect())  # at most n numbers
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row_id"), F.col("text"))
    worded = slim.select("row_id", word_hashes(F.col("text")).alias("w"))
    hits = None
    for g in sizes or [n]:
        one = worded.select("row_id", F.posexplode(grams("w", g)).alias("pos", "shingle"))
        found = one.join(F.broadcast(keys) if small else keys, "shingle").select("row_id", "pos", F.explode("of").alias("of")).select("row_id", "pos", "of.length", "of.gram").where(F.col("gram") == g)
        hits = found if hits is None else hits.unionByName(found)
    # places by document and length; few documents hold something of an item
    at = hits.groupBy("row_id", "length", "gram").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    at = at.withColumn("n", F.col("length") - F.col("gram") + 1).withColumn("need", F.greatest(F.lit(1), _need(F.col("n"), min(FEW, percent))))
    ends = F.transform(F.sequence(F.lit(0), F.size("p") - F.col("need")), lambda i: F.struct(F.get("p", i).alias("a"), F.get("p", i + F.col("need") - 1).alias("b")))
    near = F.filter(ends, lambda e: e["b"] - e["a"] < F.col("n"))
    starts = F.array_distinct(F.flatten(F.transform(near, lambda e: F.sequence(F.greatest(F.lit(0), e["b"] - F.col("n") + 1), e["a"]))))
    at = at.where(F.size("p") >= F.col("need")).withColumn("starts", starts).where(F.size("starts") > 0)
    at = materialize(at.select("row_id", "length", "gram", "n", "starts"), "leak-places")

    held = slim.join(at.select("row_id").distinct(), "row_id").select("row_id", "doc_id", word_hashes(F.col("text")).alias("w"))
    held = held.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.first("w").alias("w"))
    windows = held.join(at, "row_id").withColumn("start", F.explode("starts"))
    # a window that would run over the end is what is left there, while that can share enough shingles
    size = F.least(F.col("length"), F.size("w") - F.col("start"))
    windows = windows.where(size - F.col("gram") + 1 >= _need(F.col("n"), percent)).withColumn("v", F.slice("w", F.col("start") + 1, size))
    shingle = F.lit(None).cast("array<bigint>")
    for g in sizes or [n]:
        shingle = F.when(F.col("gram") == g, grams("v", g)).otherwise(shingle)
    windows = windows.select("row_id", "doc_id", "length", "start", shingle.alias("shingles"))
    windows = materialize(windows.withColumn("print", simhash(F.col("shingles"))), "leak-windows")

    probe = windows.select("row_id", "start", "length", "print", F.explode(blocks(F.col("print"), radius)).alias("k")).select("row_id", "start", "length", "print", "k.*")
    index = items.select("item_id", "length", F.col("fingerprint").alias("item_print"), F.explode(blocks(F.col("fingerprint"), radius)).alias("k")).select("item_id", "length", "item_print", "k.*")
    pairs = probe.join(F.broadcast(index) if small else index, ["length", "block", "bits"]).withColumn("hamming", hamming("print", "item_print")).where(F.col("hamming") <= radius)
    found = ["row_id", "start", "length", "item_id", "item_print", "hamming"]
    some = F.slice(F.array_sort("shingles"), F.lit(1), F.size("shingles") - _need(F.size("shingles"), percent) + 1)
    first = items.select("item_id", "length", F.col("fingerprint").alias("item_print"), F.explode(F.array_distinct(some)).alias("shingle"))
    held_in = windows.select("row_id", "start", "length", "print", F.explode(F.array_distinct("shingles")).alias("shingle"))
    far = held_in.join(F.broadcast(first) if small else first, ["length", "shingle"]).withColumn("hamming", hamming("print", "item_print")).where(F.col("hamming") > radius)
    pairs = pairs.select(*found).unionByName(far.select(*found)).distinct()
    judged = pairs.join(windows, ["row_id", "start", "length"])
    texts_of = items.select("item_id", "length", F.col("fingerprint").alias("item_print"), "marked")
    judged = judged.join(F.broadcast(texts_of) if small else texts_of, ["item_id", "length", "item_print"])
    common = F.size(F.array_intersect(as_multiset(F.col("shingles")), F.col("marked")))
    judged = judged.withColumn("common", common).withColumn("total", F.size("shingles") + F.size("marked") - F.col("common")).where(100 * F.col("common") >= percent * F.col("total"))
    best = F.struct((F.col("common") / F.col("total")).alias("similarity"), (-F.col("start")).alias("back"), (-F.col("hamming")).alias("near"))
    out = judged.groupBy("row_id", "item_id").agg(F.first("doc_id").alias("doc_id"), F.max(best).alias("b"))
    return out.select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.back")).cast("long").alias("start_word"), (-F.col("b.near")).alias("hamming"), "row_id")
