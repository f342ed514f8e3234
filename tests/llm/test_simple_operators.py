"""Brute-force tests of mixing, licence scans, quality rules, url filters, toxicity and WARC."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import license_scan as LS
from pagemill.llm import quality_rules as QR
from pagemill.llm import toxicity as TX
from pagemill.llm import url_filters as UF
from pagemill.llm import warc as WA
from pagemill.llm.mixing import mix_sources

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- mixing

def water_fill(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = float(sum(sizes.values())), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        goal = {s: most * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if goal[s] > most * sizes[s] + 1e-9}
        if not over:
            return goal
        capped |= over


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rng = random.Random(seed)
    rows = [(d, "w " * rng.randint(0, 60) + "\n", rng.choice([None, "a", "a", "a", "b", "c", "é"])) for d in range(700)]
    rows += [(1000, None, "tiny"), (1001, "one", "tiny"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(df.repartition(5)).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mix_sources(df.repartition(3)).collect())
    sizes, taken, target = Counter(), Counter(), {}
    for _, t, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    for r in got:
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3 and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = water_fill(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 60
    assert abs(sum(taken.values()) - sum(sizes.values())) < 0.05 * sum(sizes.values())


def test_mix_comes_near_targets_on_skewed_sizes(spark):
    rng = random.Random(11)
    rows = [(d, "w " * int(min(6000, 3 * rng.paretovariate(0.7))), rng.choice("aaaabbc")) for d in range(1500)]
    got = mix_sources(spark.createDataFrame([*rows, (9001, "w " * 9000, "a"), (9002, "w " * 9000, "c")], "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s, goal in target.items():
        assert abs(taken[s] - goal) <= 0.01 * goal, (s, taken[s], goal)


def test_mix_empty(spark):
    schema = "doc_id long, text string, source string, size int"
    assert mix_sources(spark.createDataFrame([], schema)).count() == 0
    assert [r.taken for r in mix_sources(spark.createDataFrame([(1, None, None, 2)], schema)).collect()] == [0]


# ---------------------------------------------------------------- licences

def test_license_scan(spark):
    texts = [
        "CC-BY! x cc  by", "accby cc bye cc by4", "the GNU General Public License, version 3. All rights\nreserved all rights reserved", None, "", "é cc by",
        "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT license.", "released under the mit licence", "Licensed under the Apache License, Version 2.0 (the \"License\")",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "copyright (c) 2020 Some One all rights reserved", "copyright all rights reserved", "w " * 4000 + "cc by",
    ]
    got = {r.doc_id: r for r in LS.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    phrases = {p: p.split() for p in LS.PHRASES}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in enumerate(texts):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
        hits = [(k, LS.PHRASES[p]) for p, pw in phrases.items() for k in range(len(ws)) if ws[k : k + len(pw)] == pw]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(ws), len(hits))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    labels = {i: got[i].labels for i in got}
    assert labels[6] == "gpl,gpl-3.0" and labels[7] == "mit-notice" and labels[8] == "" and labels[9] == "apache-2.0" and labels[10] == "mit"
    assert labels[11] == "copyright-line,reserved" and labels[12] == "reserved"


def test_template_automaton():
    t = LS.Template('a <<beginOptional>>b <<var;match=".{1,2}">><<endOptional>> c')
    accepts = lambda s: t.accepts_at(LS.tokens(s), 0)
    assert accepts("A c") and accepts("a b x c") and accepts("a b x y c") and not accepts("a b c") and not accepts("a b x y z c") and not accepts("a x c")
    with pytest.raises(ValueError):
        LS.Template("<<beginOptional>>x<<endOptional>>")


# ---------------------------------------------------------------- quality

def test_quality_counts(spark):
    rng = random.Random(1)
    texts = [None, "", " \n", "a" * 9 + " b", "x " * 30, "l one\nl one\n l one\n\n#*", "é# ñ|"] + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [" ".join(f"w{i}" for i in range(5000)), "same line of exactly eight words is here\n" * 3]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["s", None])) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in QR.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    for i, t, _, _ in rows:
        t, ws = t or "", WORDS.findall(t or "")
        win = Counter(tuple(ws[k : k + 8]) for k in range(len(ws) - 7))
        covered = {k + j for k in range(len(ws) - 7) if win[tuple(ws[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(ws), sum(map(len, ws)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(covered)), i
        assert r.base_failed == (len(ws) < 20 or 100 * len(covered) > 30 * len(ws)) and not (r.kept and r.base_failed)
    assert QR.quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string, source string, kept int")).count() == 0


def test_quality_adapts_by_group(spark):
    clean = [(i, " ".join(f"word{(i * 7 + k) % 911}" for k in range(60)), "en", "plain") for i in range(80)]
    code = [(100 + i, " ".join(f"f{(i * 3 + k) % 500}$" for k in range(60)), "en", "code") for i in range(80)]
    odd = [(300, " ".join(f"odd{k}$$" for k in range(60)), "en", "plain")]
    kept = {r.doc_id: r.kept for r in QR.quality_rules(spark.createDataFrame(clean + code + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in range(80)) and all(kept[100 + i] for i in range(80)) and not kept[300]


def test_each_quality_rule_rejects_what_the_base_keeps(spark):
    text = lambda i, n=100, end="": [f"w{(i * 13 + k) % 400 + 100}{end}" for k in range(n)]
    again = lambda i, n: " ".join([*text(i), *text(i)[:n]])
    lines = lambda i, n: " ".join(text(i)) + "\nsame line" * (n + 1)
    rows = [(i, " ".join(text(i))) for i in range(300)]
    rows += [(1000 + i, again(i, 8)) for i in range(40)] + [(2000 + i, lines(i, 1)) for i in range(40)]
    odd = {1: " ".join(text(1, end="longer")), 2: " ".join(text(2, 70) + ["*"] * 6 + text(2, 100)[70:]), 3: lines(3, 6), 4: again(4, 16)}
    rows += [(9000 + i, t) for i, t in odd.items()]
    got = {r.doc_id: r for r in QR.quality_rules(spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {9001, 9002, 9003, 9004}


# ---------------------------------------------------------------- urls

def test_url_rules(spark):
    urls = ["https://A.example.ORG/es/1", "http://example.org/en/19", "http://example.org/en/2", "http://org/", "http://x.com/fr/a?b", "x.com/fr/", None, "http://b.com/de/#x", "http://example.org", "ftp://notexample.org/es/", "a://b://c/d", "http://é.org/q"]
    got = {r.page_id: r for r in UF.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in host)
        fit = [(len(h + p), h + p, v) for v, h, p in UF.BASE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, max(fit)[1] if fit else None)
        assert r.verdict in ("allow", "block") and (not fit or r.verdict == max(fit)[2])


def test_url_mining(spark):
    rows = [(f"http://{h}.net/p/{i}", v) for i in range(40) for h, v in (("spam", "block"), ("good", "allow"))]
    labels = spark.createDataFrame(rows, "url string, label string")
    pages = spark.createDataFrame([(1, "http://spam.net/new"), (2, "http://good.net/new"), (3, "http://other.net/")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in UF.url_filter(pages, labels).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}
    rules = UF.mine_rules(labels.select(UF.url_tokens(labels["url"]).alias("tokens"), "label"))[0].collect()
    sets = [(frozenset(r.antecedent), r.label) for r in rules]
    assert sets and not any(a < b and x == y for a, x in sets for b, y in sets)
    assert UF.url_filter(spark.createDataFrame([], "page_id long, url string, tokens int")).count() == 0


def test_tokens_that_always_come_together_are_mined_once(spark):
    path = "/".join(f"part{chr(97 + i)}" for i in range(22))  # 2**22 combinations
    urls = [(f"http://x{i}.test/{path}/{i}", "block") for i in range(60)] + [(f"http://y{i}.test/other/{i}", "allow") for i in range(60)]
    pages = [(0, "http://z.test/partc/9"), (1, "http://z.test/other/9"), (2, "http://z.test/none"), (2, "http://z.test/none"), (3, None), (4, "nothing"), (5, "http://z.test/" + "q/" * 30000)]
    got = UF.url_filter(spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "1 as tokens", "2 as verdict", "3 as rule"), labels=spark.createDataFrame(urls, "url string, label string")).collect()
    verdicts = {r.page_id: r.verdict for r in got}
    assert len(got) == len(pages) and verdicts == {0: "block", 1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "allow"}


def test_no_mined_rule_is_cut(spark):
    n = 2100
    labelled = spark.range(2 * n).selectExpr(f"array(concat('host:h', id % {n})) as tokens", "'block' as label")
    assert UF.mine_rules(labelled, min_support=0.9 / n)[0].count() == n


def brute_rules(rows, min_support, min_confidence):
    """{(antecedent, label): (confidence, support)} of up to three tokens, without those of which a part tells as much."""
    together, alone = Counter(), Counter()
    for tokens, label in rows:
        for k in (1, 2, 3):
            for a in combinations(sorted(tokens), k):
                together[a, label] += 1
                alone[a] += 1
    rules = {(a, v): (n / alone[a], n / len(rows)) for (a, v), n in together.items() if n >= min_support * len(rows) and n / alone[a] >= min_confidence}
    parts = lambda a: [p for k in range(1, len(a)) for p in combinations(a, k)]
    return {(a, v): x for (a, v), x in rules.items() if not any(rules.get((p, v), (0,))[0] >= x[0] for p in parts(a))}


@pytest.mark.parametrize("whole", [10, 4])
def test_mined_rules_are_those_of_all_combinations(spark, whole, monkeypatch):
    monkeypatch.setattr(UF, "WHOLE", whole)
    monkeypatch.setattr(UF, "REPEATS", 7)
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        tokens = sorted(rng.sample([f"t{i}" for i in range(12)], rng.randint(1, 9)))
        rows.append((tokens, "block" if "t1" in tokens and "t2" in tokens and rng.random() < 0.95 else rng.choice(["allow", "allow", "block"])))
    rows += [(["t1", "t2", "t3", "t4", "t5"], "block")] * 30
    got = UF.mine_rules(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.02, 0.7)[0].collect()
    want = brute_rules(rows, 0.02, 0.7)
    assert {(tuple(r.antecedent), r.label) for r in got} == set(want)
    for r in got:
        assert (r.confidence, r.support) == pytest.approx(want[tuple(r.antecedent), r.label])


def test_free_query_keys_do_not_multiply(spark):
    rng = random.Random(5)
    keys = [f"key{chr(97 + i)}" for i in range(25)]
    rows = []
    for i in range(1500):
        bad = i % 2 == 0
        some = [k for k in keys if rng.random() > 0.04]
        rows.append(("http://site.test/p?" + "&".join(f"{k}=1" for k in some + ["evil"] * bad), "block" if bad else "allow"))
    tokens = spark.createDataFrame(rows, "url string, label string").select(UF.url_tokens(F.col("url")).alias("tokens"), "label")
    rules = UF.mine_rules(tokens)[0].collect()
    assert (["query:evil"], "block") in [(r.antecedent, r.label) for r in rules]
    pages = spark.createDataFrame([(1, "http://site.test/p?keya=2&evil=3"), (1, "http://site.test/p?keya=2&evil=3"), (2, "http://else.test/")], "page_id long, url string")
    got = [(r.page_id, r.verdict) for r in UF.url_filter(pages, spark.createDataFrame(rows, "url string, label string")).collect()]
    assert sorted(got) == [(1, "block"), (1, "block"), (2, "allow")]


def test_of_tied_rules_the_longest_and_then_the_largest_id_decides(spark):
    rules = spark.createDataFrame([(5, ["a"], "allow", 0.9, 0.1), (7, ["b"], "block", 0.9, 0.1), (1, ["a", "c"], "allow", 0.9, 0.1)], "rule_id long, antecedent array<string>, label string, confidence double, support double")
    sets = spark.createDataFrame([(["a", "b"],), (["a", "b", "c"],), (["c"],)], "tokens array<string>")
    got = {r.set_id: r.label for r in UF.match_rules(sets, rules).collect()}
    ids = [r.i for r in sets.select(F.xxhash64("tokens").alias("i")).collect()]
    assert [got.get(i) for i in ids] == ["block", "allow", None]


# ---------------------------------------------------------------- toxicity

def toxic_corpus(n=600, seed=4):
    rng = random.Random(seed)
    vocab = [f"n{i}" for i in range(300)]
    docs, labels = [], []
    for d in range(n):
        ws = [rng.choice(vocab) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(2):
                ws.insert(rng.randrange(len(ws)), rng.choice(["vile", "Scum", "lowling", "lowlace", "lowlore"]))
        docs.append((d, " ".join(ws)))
        labels.append((d, 1, int(toxic) if rng.random() > 0.05 else int(not toxic)))
    return docs, labels, [any(w.lower() in ("vile", "scum") or w.startswith("lowl") for w in t.split()) for _, t in docs]


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = toxic_corpus()
    d = spark.createDataFrame([*docs, (9000, None), (9001, ""), (None, "vile scum")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in TX.toxicity(d, lab).collect()}
    assert len(got) == len(docs) + 3
    for i, _ in docs:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == int(got[i].score >= 0.7)
    held = [i for i, _ in docs if got[i].held_out]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert 0 <= got[9000].score == got[9001].score < 0.5 and got[None].predicted == 1 and got[None].held_out is False
    # labels of held-out rows are not learned from
    flipped = lab.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    assert {r.doc_id: r.score for r in TX.toxicity(d, flipped).collect()} == {k: r.score for k, r in got.items()}


def test_lexicon_holds_all_entries(spark):
    rows = [(i, f"n{i} {'xyz'[i % 3]}{i % 100:02d}q m{i}" if i % 2 else f"n{i} plain m{i}") for i in range(4000)]
    labels = [(i, 1, i % 2) for i, _ in rows]
    bad = {f"{'xyz'[i % 3]}{i % 100:02d}" for i in range(1, 4000, 2)}
    model = TX.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    stems = [x.removesuffix("*") for x in model.lexicon]
    assert len(bad) == 150 and all(any(b.startswith(x) or x.startswith(b) for x in stems) for b in bad) and len(stems) > 64


def test_toxicity_repeated_rows_long_texts_and_clashing_columns(spark):
    docs, labels, _ = toxic_corpus()
    plain = {r.doc_id: r.score for r in TX.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    # rows of one id are learned from once: the smallest text of it
    more = [*docs, *docs[:50], *[(0, docs[0][1] + f" z{i}") for i in range(500)], (7000, "n1 " * 400_000 + "vile scum vile"), (7001, "n1 " * 400_000)]
    d = spark.createDataFrame(more, "doc_id long, text string").selectExpr("*", "7D as score", "'x' as predicted", "1 as label", "2 as words")
    rows = TX.toxicity(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == len(more)
    first = {r.doc_id: r.score for r in rows if r.text == dict(docs).get(r.doc_id)}
    assert first == plain
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "vile")], "doc_id long, text string")
    assert [r.score for r in TX.toxicity(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()] == [0.0]
    assert TX.toxicity(d.limit(0), spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")).count() == 0


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(0)
    y = (rng.random(3000) < 0.4).astype(int)
    noisy = lambda acc: np.where(rng.random(3000) < acc, y, 1 - y)
    bad = noisy(0.6)
    votes = np.column_stack([noisy(0.85), noisy(0.8), bad, bad, bad, bad])
    post = TX.label_model(votes, noisy(0.8).astype(float))
    assert np.mean((post > 0.5) == y) > 0.85


# ---------------------------------------------------------------- WARC

def test_warc_round_trip(spark):
    tricky = "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\né"
    rows = [(5, "http://a/\r\nX: y", "same"), (3, "u", "same"), (9, None, "same"), (1, "u", tricky), (2, "u", None), (4, "u", ""), (7, "u", tricky), (8, "u", "b" * 100000), (8, "u", "b" * 100000), (None, "u", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted((tuple(r) for r in WA.roundtrip(df).collect()), key=str)
    first = defaultdict(list)
    for i, _, h in rows:
        if i is not None:
            first[h or ""].append(i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        low = min(first[h or ""])
        again = i != low
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", low if again else None))
    assert got == sorted(want, key=str)
    assert WA.roundtrip(df.limit(0)).count() == 0


def test_warc_long_payloads_hot_digests_and_clashing_columns(spark):
    long = "é\r\n" * 2_000_000
    rows = [(1, long), (2, long + "x"), (3, "\r\n\r\n"), (4, "\r\n"), (5, "\n\r\n\r")] + [(10 + i, "same page") for i in range(10_000)]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'u' as url", "1 as payload", "'x' as record_type").repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.page_id: r for r in WA.roundtrip(df).collect()}
        plan = WA.resolve(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == len(rows)
    for i, t in rows:
        assert got[i].payload_bytes == len(t.encode())
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
        assert got[i].refers_to == (10 if i > 10 else None)
    # payloads are never dealt by their digest alone
    assert "hashpartitioning(payload_digest" not in plan or "payload#" not in plan.split("hashpartitioning(payload_digest")[0][-200:]


def test_warc_blocks_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "<p>é</p>\r\n\r\n"), (2, "u", "z")], "page_id long, url string, html string")
    path = WA.write_archives(WA.resolve(df), str(tmp_path / "w"), compression="none")
    blocks = [b for f in sorted((tmp_path / "w").glob("part-*")) for _, b in WA.parse_archive(f.read_bytes())]
    assert sorted(blocks) == sorted(["<p>é</p>\r\n\r\n".encode(), b"z"]) and path
