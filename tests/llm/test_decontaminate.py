import random
import re
from collections import Counter

import pytest

from pagemill.llm.decontaminate import RADIUS, decontaminate

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORDS.findall((t or "").translate(LOW))


def bag(ws, n):
    return Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))


def brute(docs, items, percent=80):
    out = {}
    for d, t in docs:
        ws = words(t)
        for i, it in items:
            iw = words(it)
            if not iw:
                continue
            n = min(5, len(iw))
            b = bag(iw, n)
            for s in range(len(ws)):  # windows that run over the end are clipped there
                a = bag(ws[s : s + len(iw)], n)
                both, either = sum((a & b).values()), sum((a | b).values())
                if 100 * both >= percent * either:
                    out[d, i] = max(out.get((d, i), 0), both / either)
    return out


def run(spark, docs, items, **kw):
    out = decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), **kw)
    rows = out.collect()
    assert all(r.hamming <= RADIUS for r in rows)
    return {(r.doc_id, r.item_id): r.similarity for r in rows}


@pytest.mark.parametrize("kw", [{}, {"broadcast_shingles": 0}])
def test_matches_brute_force(spark, kw):
    rng = random.Random(5)
    vocab = [f"t{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([1, 3, 5, 12, 30, 50])))) for i in range(20)] + [(20, "go " * 25)]
    docs = []
    for d in range(60):
        ws = text(rng.randint(0, 80))
        if rng.random() < 0.6:
            leak = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                leak[rng.randrange(len(leak))] = rng.choice(vocab)
            if rng.random() < 0.2:
                leak.insert(rng.randrange(len(leak)), "extra")
            ws += [w.upper() for w in leak] + text(20)
        docs.append((d, " ".join(ws)))
    want = brute(docs, items)
    assert len(want) > 20
    assert run(spark, docs, items, **kw) == want


def test_edge_rows(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = [(1, None), (2, ""), (3, item), (3, item), (4, "x " * 3000 + item), (None, item), (5, "q1 q2")]
    items = [(1, item), (2, None), (3, ""), (1, item)]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, [(9, None)]) == {}
    assert decontaminate(spark.createDataFrame([], "doc_id long, text string, length int"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_matches_beyond_the_radius_are_found(spark):
    rng = random.Random(21)
    item = [f"i{rng.randint(0, 999)}" for _ in range(50)]
    text = [*item[:25], "other", *item[26:]]
    args = spark.createDataFrame([(1, " ".join(text))], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = [decontaminate(*args, radius=r).collect() for r in (RADIUS, 1)]
    assert [(r.doc_id, r.item_id, r.similarity, r.start_word) for rows in got for r in rows] == [(1, 7, 41 / 51, 0)] * 2 and got[0][0].hamming > 1


@pytest.mark.parametrize("kw", [{}, {"broadcast_shingles": 0}])
def test_windows_are_clipped_at_the_end(spark, kw):
    """Items that lack words at an end of a document, and documents shorter than an item."""
    rng = random.Random(8)
    text = lambda n: [f"v{rng.randrange(4000)}" for _ in range(n)]
    items = [(0, text(40)), (1, text(12)), (2, text(5)), (3, text(3)), (4, text(90)), (5, ["go"] * 30)]
    docs = []
    for i, w in items:
        for lost in (0, 1, len(w) // 10, len(w) // 5):
            for part in (w[: len(w) - lost], w[lost:], w[lost // 2 : len(w) - (lost - lost // 2)]):
                for before, after in ((0, 0), (3, 2)):
                    docs.append((len(docs), " ".join([*text(before), *part, *text(after)])))
    items = [(i, " ".join(w)) for i, w in items]
    want = brute(docs, items)
    # clipped windows may lie beyond the radius: they are found by their shingles
    out = decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), **kw)
    got = {(r.doc_id, r.item_id): r.similarity for r in out.collect()}
    assert got == pytest.approx(want) and any(len(d.split()) < 40 and (k, 0) in got for k, d in docs)
