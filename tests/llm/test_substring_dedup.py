import hashlib
import random
import re

import pytest

from pagemill.llm.substring_dedup import block_length, substring_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=13):
    words = {i: WORDS.findall(t or "") for i, (_, t) in enumerate(rows)}
    seen = {}
    for i, ws in words.items():
        doc = rows[i][0]
        if doc is not None:
            for k in range(len(ws) - window + 1):
                key = tuple(ws[k : k + window])
                seen[key] = min(seen.get(key, doc), doc)
    out = []
    for i, ws in words.items():
        doc, gone = rows[i][0], set()
        if doc is not None:
            for k in range(len(ws) - window + 1):
                if seen[tuple(ws[k : k + window])] < doc:
                    gone |= set(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((doc, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, parts=5):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in substring_dedup(df).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"wörd{i}" for i in range(60)] + ["a", "b"]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(8, 40))] for _ in range(6)]
    rows = []
    for d in range(60):
        ws = []
        for _ in range(rng.randint(0, 4)):
            ws += [rng.choice(vocab) for _ in range(rng.randint(0, 25))]
            if rng.random() < 0.7:
                p = rng.choice(passages)
                cut = rng.randint(0, 5)
                ws += p[cut:]
        rows.append((d, "".join(w + rng.choice([" ", "\n", "\t ", "  "]) for w in ws)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows)
    assert any(r[2] for r in brute(rows))


def test_edge_rows(spark):
    line = " ".join(f"x{i}" for i in range(20))
    rows = [(1, line), (1, line), (2, line + " tail"), (3, None), (4, ""), (None, line), (5, "\n\t "), (6, "w " * 5000), (7, "w " * 40), (-1, "y " + line)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, 1) == brute(rows)


def test_empty_and_extra_columns(spark):
    schema = "n_words string, doc_id long, uid int, text string, bucket array<int>"
    assert substring_dedup(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([("q", 1, 5, "a  b", [1])], schema)
    out = substring_dedup(df).collect()[0].asDict()
    assert out == {"doc_id": 1, "uid": 5, "text": "a b", "bucket": [1], "n_words": 2, "n_removed": 0}


def test_block_length():
    assert block_length(13) == 7
