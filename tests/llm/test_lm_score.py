import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import attention as A
from pagemill.llm import lm_score as LM
from pagemill.llm.lm_score import lm_score

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    toks = [[*WORDS.findall((t or "").translate(LOW)), None] for _, t in rows]
    train = [d is not None and zlib.crc32(str(d).encode()) % 10 != 0 for d, _ in rows]
    c = Counter(w for ws, use in zip(toks, train, strict=True) if use for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, d is not None and not use, len(ws), sum(w in c for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for (d, _), ws, use in zip(rows, toks, train, strict=True)]


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(lm_score(df, **kw).collect(), key=lambda r: (str(r.doc_id), r.base_score))
    want = sorted(brute(rows), key=lambda r: (str(r[0]), r[5]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5]
        assert g.base_score == pytest.approx(w[5], rel=1e-9)
        assert g.score < 0


@pytest.mark.parametrize("frequent", [200_000, 8])
def test_base_matches_brute_force(spark, frequent):
    rng = random.Random(3)
    rows = [(d, " ".join(rng.choice(["The", "a", f"é{rng.randint(0, 300)}", f"w{rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 90)))) for d in range(70)]
    check(spark, [*rows, rows[5], (71, None), (72, ""), (None, "the lone"), (73, "x " * 3000)], frequent=frequent)


def test_only_held_out_and_empty(spark):
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 10 == 0)
    check(spark, [(held, "a b")])
    assert lm_score(spark.createDataFrame([], "doc_id long, text string, uid int")).count() == 0


def _net(pairs=False):
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, 700).astype(float)
    key, times = np.unique(rng.integers(0, 700 * 700, 9000).astype(np.uint32) // np.uint32(3), return_counts=True)
    net = A.make_net(counts, rng.standard_normal((700, A.TRAITS)), key, times) if pairs else A.make_net(counts)
    for x in net.p.values():
        x += rng.standard_normal(x.shape).astype(np.float32) * 0.3
    return net


@pytest.mark.parametrize("pairs", [False, True])
def test_probabilities_sum_to_one_and_windows_agree(pairs):
    net, rng = _net(pairs), np.random.default_rng(2)
    assert not pairs or (len(net.pair) and len(set(net.cls)) == A.CLASSES)
    prefix = rng.integers(3, 700, 30)
    texts = [np.append(prefix, x) for x in range(700)]
    ids, lengths = np.concatenate(texts), np.full(700, 31)
    base = A.score(net, np.asarray(prefix), np.array([30]))[0]
    assert np.exp(A.score(net, ids, lengths) - base).sum() == pytest.approx(1, abs=1e-3)
    alone = np.array([A.score(net, t, np.array([31]))[0] for t in texts[:20]])
    assert np.allclose(alone, A.score(net, ids, lengths)[:20], atol=1e-3)


def test_matches_direct_attention():
    net, rng = _net(), np.random.default_rng(4)
    p, step = net.p, A.WINDOW - A.OVERLAP
    for size in (1, 7, 24, 25, 60, 100):
        ids = rng.integers(3, 700, size)
        inputs = net.row[np.append(A.START, ids[:-1])]
        total = 0.0
        for t in range(size):
            low = max(0, t // step * step - A.OVERLAP)
            place = np.arange(low, t + 1) - (t // step * step - A.OVERLAP)
            x = p["E"][inputs[low : t + 1]] + p["P"][place]
            s = x @ p["K"] @ (x[-1] @ p["Q"]) / np.sqrt(A.HEAD)
            w = np.exp(s - s.max())
            logits = (w / w.sum()) @ (x @ p["V"]) @ p["A"] + p["E"][inputs[t]] @ p["B"] + p["c"]
            total += logits[net.cls[ids[t]]] - np.log(np.exp(logits).sum()) + net.share[ids[t]]
        assert A.score(net, ids, np.array([size]))[0] == pytest.approx(total, rel=1e-4)


def test_training_beats_counts_on_other_text():
    rng = np.random.default_rng(6)
    follow = rng.permutation(400)
    def make(n):
        x = [3]
        for _ in range(n):
            x.append(int(follow[x[-1]]) if rng.random() < 0.8 else int(rng.integers(400)))
        return np.array(x)
    train, held = make(20000), make(3000)
    counts = np.bincount(train, minlength=700).astype(float)
    net = A.make_net(counts)
    before = A.score(net, held, np.array([len(held)]))[0]
    A.train(net, train, np.array([len(train)]), steps=300)
    assert A.score(net, held, np.array([len(held)]))[0] > before * 0.8


def test_context_is_learned_from_all_rows(spark):
    rng = random.Random(7)
    follow = list(range(60))
    rng.shuffle(follow)
    rows, mixed = [], []
    for d in range(4000):
        x = [rng.randrange(60)]
        while len(x) < 120:
            x.append(follow[x[-1]])
        rows.append((d, " ".join(f"w{i}" for i in x)))
        # the same counts in any order
        mixed.append(rows[-1] if zlib.crc32(str(d).encode()) % 10 == 0 else (d, " ".join(f"w{i}" for i in rng.sample(x, len(x)))))
    mean = lambda rs: np.mean([r.score for r in lm_score(spark.createDataFrame(rs, "doc_id long, text string").repartition(1), frequent=0).collect() if r.held_out])
    assert mean(rows) > mean(mixed) + 1


def test_local_gradients_and_windows():
    net, rng = _net(), np.random.default_rng(8)
    lengths = np.array([5, 70, 1, 40])
    ids = rng.integers(3, 700, lengths.sum())
    local = A.Local(net, 0)
    local.add(ids, lengths)
    assert local.windows == len(A.windows(lengths)[0]) and local.ids == len(ids)
    # total loss without the share of ids in classes
    loss = lambda: -(A.score(net, ids, lengths).sum() - net.share[ids].sum())
    assert local.loss == pytest.approx(loss(), rel=1e-3)
    for name in ("A", "B", "c", "K", "V", "Q", "P"):
        x, g = net.p[name], local.g[name]
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = x[at]
        x[at] = old + 0.01
        up = loss()
        x[at] = old - 0.01
        down = loss()
        x[at] = old
        assert (up - down) / 0.02 == pytest.approx(g[at], rel=0.05), name


def test_beats_the_unigram_on_held_out_rows_in_any_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = []
    for parts in (1, 32):
        rows = lm_score(docs.repartition(parts)).collect()
        held = [r for r in rows if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)
        got.append({r.doc_id: r.score / r.n_tokens for r in rows})
    assert got[0] == pytest.approx(got[1], abs=1e-5)


def test_shards_are_trained_and_averaged(spark, monkeypatch):
    """More than one shard: every window is seen once, in any partitions, and weights agree."""
    monkeypatch.setattr(LM, "SHARD_TOKENS", 3000)
    rng = random.Random(3)
    docs = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 60)))) for i in range(400)]
    run = lambda parts: {r.doc_id: r.score for r in lm_score(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)).collect()}
    assert run(2) == pytest.approx(run(7), abs=1e-3)


def test_pairs_that_the_model_does_not_hold_are_scored_all_the_same(spark):
    rng = random.Random(5)
    rows = [(d, " ".join(rng.choice(["the", "of", f"w{rng.randint(0, 60)}"]) for _ in range(rng.randint(0, 60)))) for d in range(120)]
    docs = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string").repartition(3)
    scores = [sorted((r.doc_id, r.score) for r in lm_score(docs, pairs=pairs).collect()) for pairs in (4_000_000, 40)]
    assert [d for d, _ in scores[0]] == [d for d, _ in scores[1]]
    assert [s for _, s in scores[0]] == pytest.approx([s for _, s in scores[1]], rel=1e-4)


def test_texts_are_cut_once(spark, tmp_path):
    """Training and scoring read what the first pass has stored."""
    log = tmp_path / "read"

    @F.udf("string")
    def noted(text):
        with open(log, "ab") as f:
            f.write(b".")
        return text

    rows = [(d, "some words and more " * (d % 7)) for d in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select("doc_id", noted.asNondeterministic()("text").alias("text"))
    assert len(lm_score(docs).collect()) == 50
    assert log.stat().st_size == 50


def test_context_sums_match_direct_sums():
    rng = np.random.default_rng(9)
    vectors, lengths = A.trait_vectors(40), np.array([1, 70, 32, 5])
    ids, want = rng.integers(0, 40, lengths.sum()), np.zeros((40, A.TRAITS))
    for begin, size in zip(np.cumsum(lengths) - lengths, lengths, strict=True):
        for low in range(begin, begin + size, A.CONTEXT):
            around = ids[low : min(low + A.CONTEXT, begin + size)]
            for i in around:
                want[i] += (vectors[around].sum(axis=0) - vectors[i]) / len(around)
    assert np.allclose(A.context_sums(vectors, ids, lengths), want, atol=1e-4)
