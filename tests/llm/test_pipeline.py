import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_ngram_join import brute as components
from tests.llm.test_substring_dedup import brute as cut

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(900)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    item, passage = words(30), words(60)
    docs = [words(rng.randint(20, 120)) for _ in range(260)]
    for d in range(60, 160, 2):
        docs[d][5:5] = [rng.choice(["vile", "scum"]), "awful", rng.choice(["vile", "scum"])]
    docs += [list(docs[1]), docs[3] + ["tail"], docs[7] + passage, docs[9] + passage + words(5), docs[11] + item, words(10) + item + words(10)]
    rows = [(i, " ".join(w), "en", "ab"[i % 2], len(" ".join(w))) for i, w in enumerate(docs)] + [(900, None, None, None, None), (901, "", "en", "a", 0)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(60 <= i < 160 and i % 2 == 0)) for i in range(0, 260)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows


def test_stages(spark, tables, tmp_path):
    at, rows = tables
    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        if name != "mix":
            assert out.columns == corpus_pipeline.COLUMNS and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id: r for r in docs.collect()})
    toxic, near, repeats, leaks, mix = seen
    assert set(toxic) == {r[0] for r in rows} - set(range(60, 160, 2))
    pairs = [(i, r.text) for i, r in toxic.items()]
    linked = {d: c for d, _, c in components(pairs)}
    assert set(near) == {d for d, n, c in components(pairs) if n == 0 or c == d} and 260 not in near and 261 not in near and len(linked) == len(toxic)
    after = cut([(i, r.text) for i, r in near.items()])
    removed = {d: (n, k) for d, n, k, _ in after}
    assert all(hashlib.sha256(repeats[d].text.encode()).hexdigest() == sha for d, n, k, sha in after if 0 < k < n)
    assert set(repeats) == {d for d, (n, k) in removed.items() if k == 0 or k < n} and removed[263][1] >= 60
    assert all(repeats[d].text == near[d].text for d in repeats if removed[d][1] == 0) and repeats[263].n_chars == len(repeats[263].text)
    # the item in 265 was cut as a repeat of 264's
    assert set(repeats) - set(leaks) == {264} and removed[265][1] == 30
    assert set(mix) <= set(leaks) and all(r.copies >= 1 and r.taken == r.size * r.copies for r in mix.values())


def test_run(spark, tables):
    at, _ = tables
    out = corpus_pipeline.run(spark, at)
    assert out.count() > 100 and out.where(F.col("text").contains("vile")).count() == 0


def test_loose_rows_stay_whole(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(None, None, "en", "a", None), (None, None, "fr", "b", None), (None, long, "en", "a", 1), (None, long, "fr", "b", 1), (1, long + " x", "en", "a", 1), (1, long + " x", "en", "a", 1), (2, "", "en", "a", 0), (2, "", "en", "a", 0)]
    out = corpus_pipeline.one_of_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    ids = [r.doc_id for r in out if not r.text]
    assert sorted(ids, key=str) == [2, 2, None, None] and {r.lang for r in out if r.doc_id is None and r.text is None} == {"en", "fr"}
    assert len([r for r in out if r.doc_id == 1]) == 1
