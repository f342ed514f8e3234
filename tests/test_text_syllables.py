"""Syllables of whole texts against single words."""

import random
import re

from pyspark.sql import functions as F

from pagemill.functions import text as T


def test_syllables_of_texts(spark):
    def one(word):
        w = re.sub("[^a-z]", "", word.lower())
        stem = re.sub("([^laeiouy]es|ed|[^laeiouy]e)$", "", w)
        return 0 if not w else 1 if len(w) <= 3 else max(1, len(re.findall("[aeiouy]{1,2}", stem)))

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("aeylsdrtEé1'") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", None, "xxed rhythm boxes hmmm tables 123 a-b", "eeee ed. needed"]], "t string").coalesce(1)
    rows = df.select("t", T.syllables_of(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [sum(map(one, r.t.split(" "))) if r.t else 0 for r in rows]
    # no function over single words
    plan = df.select(T.syllables_of(F.col("t")))._jdf.queryExecution().toString()
    assert "lambda" not in plan and "aggregate(" not in plan
