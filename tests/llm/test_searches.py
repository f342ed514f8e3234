"""Brute-force tests of the impact-ordered search, the ranked search and whitening."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import impact_search as IS
from pagemill.llm import ranked_search as RS
from pagemill.llm import whitening as WH

VECTORS = "vec_id long, embedding array<float>"


# ---------------------------------------------------------------- impact-ordered search

def brute_top(rows, k, every):
    """Sorted (query_id, rank, vec_id, score) by plain Python integers."""
    ok = [(i, [math.floor(256 * e) for e in v]) for i, v in rows if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    out = []
    for a, (qid, q) in enumerate(ok):
        if qid is None or qid % every:
            continue
        hits = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), i is None, i or 0) for b, (i, v) in enumerate(ok) if b != a)
        out += [(qid, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(hits[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_top_k_with_ties_nulls_and_repeats(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 6)]) for i in range(80)]
    rows += [(i, rows[i - 100][1]) for i in range(100, 115)]  # copies: ties
    rows += [(10, rows[10][1]), (10, rows[11][1]), (None, rows[20][1]), (200, None), (210, [0.5, None]), (220, [float("nan")] * 6), (230, [float("inf")] * 6), (240, []), (250, [0.5, -0.25]), (260, [0.0] * 6)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("clash")).withColumn("x", F.lit(1)).repartition(3)
    assert found(IS.top_k(df, F.col("vec_id") % 10 == 0)) == brute_top(rows, 5, 10)


def test_top_k_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], VECTORS)
    assert found(IS.top_k(df, F.col("vec_id") == 0)) == [(0, 1, 1, 128 * 256 + 128 * 512), (0, 2, 2, -256 * 256)]
    assert IS.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert IS.top_k(df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0
    assert IS.top_k(df, F.lit(None).cast("boolean")).count() == 0


@pytest.mark.parametrize("shape", ["dense", "sparse", "large", "copies"])
def test_shards_and_blocks_agree_with_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(IS, "SHARD_CELLS", 16 * 300)
    monkeypatch.setattr(IS, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.125, (1200, 16))
    x = {"dense": x, "sparse": np.where(rng.random(x.shape) < 0.8, 0, x), "large": x * 1e6, "copies": np.where(np.arange(1200)[:, None] % 3, x[:1], x)}[shape]
    x = np.floor(256 * x.astype(np.float32).astype(float)) / 256
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in IS.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    whole = np.floor(256 * x).astype(np.int64)
    for q in range(0, 1200, 50):
        s = whole @ whole[q]
        best = [i for i in np.lexsort((np.arange(1200), -s)) if i != q][:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, s[i]) for i in best]


def test_search_stops_before_the_last_segment():
    """Few vectors are like the query: after some segments most cannot reach the best, and are not rescored."""
    rng = np.random.default_rng(7)
    x = np.floor(256 * rng.normal(0, 0.125, (4000, 32))).astype(np.int64)
    x[:8] = x[0] + rng.integers(-3, 4, (8, 32))
    size = np.abs(x)
    width = size.max(0) // IS.LEVELS + 1
    level = size // width
    ends = np.cumsum([(level == v).sum(0) for v in range(IS.LEVELS - 1, -1, -1)], axis=0)
    ids = np.arange(4000)
    row = {"uids": ids.tobytes(), "ids": ids.tobytes(), "vectors": IS._small(x), "places": IS._small(np.argsort(-level, axis=0, kind="stable").T), "ends": IS._small(ends.T), "width": IS._small(width)}
    shard = IS.Shard(row, 32)
    possible = shard._possible(x[0], np.flatnonzero(x[0]), 0, 5)
    assert len(possible) < 500 and set(range(1, 8)) & set(possible.tolist())
    assert set(shard.best(x[0], 0, 5)[0].tolist()) == set(sorted(ids[1:], key=lambda i: (-(x[i] @ x[0]), i))[:5])


# ---------------------------------------------------------------- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {a: a + 32 for a in range(65, 91)}


def brute_ranked(docs, items, k=10):
    terms = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    n, total = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(t for d in terms for t in set(d))
    tf = [Counter(d) for d in terms]
    out = []
    for item, text in items:
        asked = {t for t in TERM.findall((text or "").translate(LOWER)) if t in df}
        scored = []
        for (doc, _), d, f in zip(docs, terms, tf, strict=True):
            if not d:
                continue
            m = 10 + 90 * len(d) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * f[t] // (1000 * f[t] + 8 * m)) for t in asked if t in f)
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def ranked(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("item", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("terms", F.lit(2))
    return sorted((tuple(r) for r in RS.ranked_search(d.repartition(3), i, **how).collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"block_bytes": 60}, {"seed": 1}])
def test_ranked(spark, how):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["naïve", "日本", "A1", "Zz"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, rng.choice([" ", "-", "; "]).join(rng.choices(words, weights, k=rng.randint(1, 40)))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(14)] + [(3, docs[3][1]), (None, docs[3][1]), (300, None), (301, ""), (302, " ,.;"), (303, "W1 w1 W1"), (304, "w5 " * 30_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(8)] + [(8, docs[3][1]), (8, docs[3][1]), (9, None), (10, ""), (11, "unknown words"), (None, "w1 w2 w2")]
    assert ranked(spark, docs, items, **how) == brute_ranked(docs, items)


def test_ranked_empty(spark):
    assert ranked(spark, [], [(1, "a")]) == [] and ranked(spark, [(1, "a b")], []) == [] and ranked(spark, [(1, ""), (2, None)], [(1, "a")]) == []
    assert ranked(spark, [(1, "a b c"), (2, "d")], [(1, "a")]) == brute_ranked([(1, "a b c"), (2, "d")], [(1, "a")])


def test_wand_skips_documents_that_cannot_win():
    """Only one document has the rare term: the common one's postings are skipped, not scored."""
    common = ([*range(1000), RS.END], [10 + (i % 3) for i in range(1000)], 12)
    rare = ([990, RS.END], [100], 100)

    class Counted(list):
        reads = 0

        def __getitem__(self, i):
            Counted.reads += 1
            return list.__getitem__(self, i)

    lists = [(common[0], Counted(common[1]), 12), rare]
    assert RS.wand(lists, 1, 50) == [(110, 990)] and Counted.reads == 1
    assert sorted(RS.wand([common, rare], 3, 0), reverse=True) == [(110, 990), (12, 5), (12, 2)] or sorted(RS.wand([common, rare], 3, 0))[-1] == (110, 990)


def test_wand_agrees_with_scoring_all():
    rng = random.Random(2)
    for _ in range(60):
        lists = []
        for _ in range(rng.randint(1, 6)):
            docs = sorted(rng.sample(range(200), rng.randint(1, 80)))
            impacts = [rng.randint(1, 5) for _ in docs]
            lists.append(([*docs, RS.END], impacts, max(impacts)))
        total = Counter()
        for docs, impacts, _ in lists:
            for d, s in zip(docs, impacts, strict=False):
                total[d] += s
        for floor in (0, 3, 9):
            want = sorted(((s, -d) for d, s in total.items() if s > floor), reverse=True)[:4]
            assert sorted(((s, -d) for s, d in RS.wand(lists, 4, floor)), reverse=True) == want


# ---------------------------------------------------------------- whitening

def brute_white(rows, keep=32):
    ok = [(i, v) for i, v in rows if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    d = max(len(v) for _, v in ok)
    x = np.array([[math.floor(64 * e) + 1_000_000 for e in v] + [1_000_000] * (d - len(v)) for _, v in ok], object)
    n, s = len(x), x.sum(0)
    away = ((n * x - s) ** 2).sum(1)
    cx = ((n * x - s) / n).astype(float)
    e, v = np.linalg.eigh(cx.T @ cx / n)
    return [i for i, _ in ok], away, cx, e[::-1][:keep], v[:, ::-1][:, :keep], e.sum()


@pytest.mark.parametrize("parts", [1, 5, 23])
def test_whitening(spark, parts):
    rng = np.random.default_rng(9)
    base = rng.normal(0, 1, (400, 40)) @ np.diag(np.linspace(3, 0.5, 40)) @ rng.normal(0, 0.2, (40, 40))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 40), (1003, [float("-inf")] * 40), (1004, [0.5] * 7), (1005, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("n", F.lit(0))
    got = WH.whiten(df.repartition(parts)).collect()
    ids, away, cx, e, v, trace = brute_white(rows)
    assert len(got) == 32 * len(ids) and {r.n for r in got} == {len(ids)}
    by = {(r.vec_id, r.component): r for r in got}
    signs = [np.sign(by[0, k + 1].whitened * (cx[0] @ v[:, k])) for k in range(32)]
    for j, i in enumerate(ids):
        assert by[i, 1].deviation == away[j]
        for k in range(32):
            r = by[i, k + 1]
            assert abs(r.whitened - signs[k] * (cx[j] @ v[:, k]) / math.sqrt(e[k])) < 1e-8 and abs(r.explained - e[k] / trace) < 1e-10
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert WH.whiten(spark.createDataFrame([], schema)).count() == 0 and WH.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    one = WH.whiten(spark.createDataFrame([(1, [0.5, 0.25])], schema)).collect()
    assert [(r.vec_id, r.deviation, r.whitened) for r in one] == [(1, 0, None)] and one[0].identity_error == 0
    # one direction of variance: the other is null; equal and null ids are rows of their own
    line = WH.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (1, [1.0, 1.0]), (None, [2.0, 2.0])], schema)).collect()
    assert sorted(r.component for r in line) == [1, 1, 1, 2, 2, 2] and all((r.whitened is None) == (r.component == 2) for r in line)
    assert abs(max(r.whitened for r in line if r.component == 1) - math.sqrt(1.5)) < 1e-12 and abs(line[0].identity_error) < 1e-12
    big = WH.whiten(spark.createDataFrame([(1, [1e8, 0.0]), (2, [-1e8, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert all(r.deviation is None for r in big)  # beyond 64 bits
