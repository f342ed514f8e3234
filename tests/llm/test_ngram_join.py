import random
import re

import numpy as np
import pytest

from pagemill.llm.components import components
from pagemill.llm import ngram_join
from pagemill.llm.ngram_join import ngram_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    ws = WORDS.findall((text or "").translate(LOW))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows, parts=6, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(df, **options).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(30)]
    rows, d = [], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 6, 20, 60, 150, 300]))]
        if rng.random() < 0.4:
            base = passage + base
        for _ in range(rng.choice([1, 2, 6])):
            ws = list(base)
            for _ in range(rng.randint(0, max(1, len(ws) // 40))):
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
            rows.append((d, " ".join(w.upper() if rng.random() < 0.1 else w for w in ws)))
            d += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    want = brute(rows)
    assert run(spark, rows) == want
    assert any(c != d for d, _, c in want)


def test_signatures_in_place_of_crowded_lists(spark):
    rows = corpus(3)
    assert run(spark, rows, hot=3) == brute(rows)


def test_similar_sets_share_a_signature_and_sketches_bound_from_below():
    rng = np.random.default_rng(5)
    for n in [2, 3, 5, 9, 17, 40, 64, 65, 130, 400, 1500, 5000]:
        for _ in range(30):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            differ = int(rng.integers(0, 2 * n // 9 + 1))
            gone = int(rng.integers(0, differ + 1))
            b = np.concatenate((a[gone:], rng.integers(0, 1 << 63, differ - gone, dtype=np.uint64)))
            similar = 100 * (n - gone) >= 80 * len(np.union1d(a, b))
            row = np.repeat([0, 1], [len(a), len(b)])
            h, size = np.concatenate((np.sort(a), np.sort(b))), np.array([len(a), len(b)])
            with np.errstate(over="ignore"):
                r, key = ngram_join.signatures(row, h, size, 80)
                s = ngram_join._Sketches(ngram_join.sketches(row, h, size))
            apart = ngram_join._apart(s, np.array([0]), s, np.array([1]))
            assert apart[0] <= differ
            if similar:
                assert np.intersect1d(key[r == 0], key[r == 1]).size


def test_unlike_texts_of_one_passage_make_few_pairs(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(4000)}"
    passage, base = [word() for _ in range(300)], [word() for _ in range(900)]
    rows = []
    for i in range(300):
        if i % 2:
            ws = list(base)
            for _ in range(rng.randint(1, 40)):
                ws[rng.randrange(len(ws))] = word()
        else:
            # words of the passage mostly: alive, in its crowded lists, unlike any other
            parts = [passage[k : k + 30] for k in range(0, 300, 30)]
            rng.shuffle(parts)
            ws = [x for p in parts[:6] for x in p] + [word() for _ in range(4)]
        rows.append((i, " ".join(ws)))
    made = []
    real = ngram_join._candidates
    monkeypatch.setattr(ngram_join, "_candidates", lambda *a: made.append(real(*a).count()) or real(*a))
    assert run(spark, rows, hot=64) == brute(rows)
    assert max(made) <= 2 * len(rows)


def test_edge_rows(spark):
    long = " ".join(f"x{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "b a"), (7, long), (8, long + " y"), (8, long), (None, long), (None, "only null id"), (9, "a"), (10, "w " * 600), (11, "w " * 9)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert ngram_components(spark.createDataFrame([], "doc_id long, text string, cls int")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 5), (200, 201), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 21)}, 100: 0, 201: 200}


def test_work_of_a_set_does_not_jump_with_the_members_of_lists(spark, monkeypatch):
    """The entries that the last step explodes follow the sets, also where lists grow past a limit."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join(passage[: 50 + i % 7] + [word() for _ in range(3 + i % 11)] + passage[56:])) for i in range(1500)]
    made = []
    real = ngram_join._pool

    def counted(sets, groups, column, *hot):
        made.append(sum(len(r[0]) for r in sets.select(column).collect()))
        return real(sets, groups, column, *hot)

    monkeypatch.setattr(ngram_join, "_pool", counted)
    totals = []
    for part in (rows[:200], rows[:1000]):
        made.clear()
        run(spark, part)
        totals.append(sum(made))
    assert 0 < totals[0] and totals[1] <= 6 * totals[0]


def test_sets_of_many_empty_parts_meet_by_their_prefix():
    rng = np.random.default_rng(5)
    k, n = 40000, 4
    h = np.sort(rng.integers(0, 1 << 63, (k, n), dtype=np.uint64), axis=1).ravel()
    with np.errstate(over="ignore"):
        _, key = ngram_join.signatures(np.repeat(np.arange(k), n), h, np.full(k, n), 80)
    assert np.unique(key, return_counts=True)[1].max() <= 2  # no set is like another
