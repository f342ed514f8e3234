"""Queries opN_<name> and their SQL: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .decontaminate import decontaminate
from .impact_search import top_k
from .license_scan import license_scan
from .lm_score import lm_score
from .mixing import mix_sources
from .ngram_join import ngram_components
from .quality_rules import FEATURES, FENCE, MIN_ROWS, NEAR, OF_ALL, OF_NONZERO, quality_rules
from .ranked_search import ranked_search
from .substring_dedup import substring_dedup
from .toxicity import toxicity
from .url_filters import url_filter
from .warc import roundtrip
from .whitening import whiten


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).drop("source", "row_id")


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read(spark, sf_dir, "documents")).drop("row_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("row_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(read(spark, sf_dir, "pages"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(read(spark, sf_dir, "documents"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring, op2_mix, op3_license, op4_ngram_join, op5_quality, op6_urls, op7_toxicity, op8_decontaminate, op9_warc, op10_lm, op11_topk, op12_ranked, op13_whitening)}

_BIN = "CASE WHEN x < 64 THEN x ELSE (x >> (length(bin(x)) - 6)::INTEGER) << (length(bin(x)) - 6)::INTEGER END"


def _quantiles(name: str, keys: str) -> str:
    """(keys, feature, n, quantiles of all, nz, quantiles of what is not 0) of the sketches merged over the other keys."""
    by = f"{keys}, feature" if keys else "feature"
    of_all = ", ".join(f"min(bin) FILTER (WHERE 100 * seen >= {q} * total) AS q{q}" for q in OF_ALL)
    of_nonzero = ", ".join(f"min(bin) FILTER (WHERE bin > 0 AND 100 * over >= {q} * above) AS nz{q}" for q in OF_NONZERO)
    return f"""{name} AS (SELECT {by}, max(total) AS n, {of_all}, max(above) AS nz, {of_nonzero}
  FROM (SELECT {by}, bin, sum(n) OVER up AS seen, sum(n) OVER same AS total, sum(CASE WHEN bin > 0 THEN n ELSE 0 END) OVER up AS over, sum(CASE WHEN bin > 0 THEN n ELSE 0 END) OVER same AS above FROM (SELECT {by}, bin, count(*) AS n FROM sk GROUP BY {by}, bin) a WINDOW same AS (PARTITION BY {by}), up AS (PARTITION BY {by} ORDER BY bin)) c GROUP BY {by})"""


_QUALITY = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM d, unnest(range(1, len(w) - 6)) AS u(i) WHERE len(w) >= 8) a),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM win WHERE k > 1) b GROUP BY r),
ln AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) a WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT d.r, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep ON rep.r = d.r LEFT JOIN ln ON ln.r = d.r),
g AS (SELECT *, 100 * word_chars // greatest(n_words, 1) AS f1, 1000 * n_symbols // greatest(n_words, 1) AS f2, 1000 * n_dup_lines // greatest(n_words, 1) AS f3, 1000 * n_repeat_words // greatest(n_words, 1) AS f4 FROM f),
long AS (SELECT r, lang, source, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS failed, unnest({list(FEATURES)}) AS feature, unnest({[slack for slack, _ in FEATURES.values()]}) AS slack, unnest([f1, f2, f3, f4]) AS x FROM g),
sk AS (SELECT lang, source, feature, {_BIN} AS bin FROM long WHERE NOT failed),
{_quantiles("own", "lang, source")}, {_quantiles("bylang", "lang")}, {_quantiles("everything", "")},
pick AS (SELECT o.lang, o.source, o.feature, {", ".join(f"CASE WHEN o.n >= {MIN_ROWS} THEN o.q{q} WHEN l.n >= {MIN_ROWS} THEN l.q{q} ELSE a.q{q} END AS q{q}" for q in OF_ALL)}, {", ".join(f"CASE WHEN o.nz >= {MIN_ROWS} THEN o.nz{q} WHEN l.nz >= {MIN_ROWS} THEN l.nz{q} WHEN a.nz >= {MIN_ROWS} THEN a.nz{q} END AS nz{q}" for q in OF_NONZERO)}
  FROM own o JOIN bylang l ON l.lang IS NOT DISTINCT FROM o.lang AND l.feature = o.feature JOIN everything a ON a.feature = o.feature),
lim AS (SELECT lang, source, feature, least(q25 - reach, q5) AS lo, greatest(q75 + (q75 >> 5) + reach, CASE WHEN feature = 'word_length' THEN q90 + (q90 >> 5) WHEN nz10 <= {NEAR} THEN nz90 + (nz90 >> 5) ELSE coalesce(nz10 // 2, 0) END) AS hi FROM (SELECT *, {FENCE} * (q75 + (q75 >> 5) - q25) AS reach FROM pick) a),
ok AS (SELECT x.r, bool_and(x.x <= hi + slack AND (x.feature <> 'word_length' OR x.x >= lo - slack)) AS within FROM long x JOIN lim ON lim.lang IS NOT DISTINCT FROM x.lang AND lim.source IS NOT DISTINCT FROM x.source AND lim.feature = x.feature GROUP BY x.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(within, false) AS kept FROM g LEFT JOIN ok ON ok.r = g.r"""

_WORDS = r"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')"
_SUBSTRING = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(x="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS u(i) WHERE len(w) >= 13),
late AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM win) a WHERE m < doc_id),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM late),
word AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM word WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.r = word.r AND gone.p = word.p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.r = d.r LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) c ON c.r = d.r"""

_NGRAMS = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(x="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sh AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
l AS (SELECT a.r AS x, b.r AS y FROM sh a JOIN sh b ON a.g = b.g AND a.r <> b.r JOIN n na ON na.r = a.r JOIN n nb ON nb.r = b.r GROUP BY a.r, b.r, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, l.y FROM reach JOIN l ON l.x = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id FROM d LEFT JOIN n ON n.r = d.r JOIN (SELECT a, min(e.doc_id) AS m FROM reach JOIN d e ON e.r = reach.b GROUP BY a) c ON c.a = d.r"""

_DIGIT = "substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substring(h, {at}, 10))::BIGINT >> {shift}) & 31) + 1)::BIGINT, 1)"
_WARC = f"""SELECT page_id, octet_length(encode(p))::BIGINT AS payload_bytes, {" || ".join(_DIGIT.format(at=10 * g + 1, shift=5 * k) for g in range(4) for k in range(7, -1, -1))} AS payload_digest, CASE WHEN m < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN m < page_id THEN m END AS refers_to
FROM (SELECT *, sha1(p) AS h, min(page_id) OVER (PARTITION BY p) AS m FROM (SELECT page_id, coalesce(html, '') AS p FROM pages) a) b"""

_TOPK = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, d.vec_id, coalesce(list_sum(list_transform(list_zip(q.x, d.x), lambda z: z[1] * z[2])), 0)::BIGINT AS score FROM v q JOIN v d ON d.r <> q.r WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) a WHERE rank <= 5"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RANKED = f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM t WHERE len(w) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM t) a GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_TERMS}) AS w FROM benchmark),
qt AS (SELECT i, item_id, unnest(w) AS term FROM q),
sc AS (SELECT i, item_id, tf.r, t.doc_id, sum(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(w) * n) // l))))::BIGINT AS score FROM qt JOIN tf ON tf.term = qt.term JOIN df ON df.term = qt.term JOIN t ON t.r = tf.r CROSS JOIN s GROUP BY i, item_id, tf.r, t.doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank FROM sc WHERE score > 0) a WHERE rank <= 10"""

ORACLE_SQL: dict[str, str] = {"op1_substring": _SUBSTRING, "op4_ngram_join": _NGRAMS, "op5_quality": _QUALITY, "op9_warc": _WARC, "op11_topk": _TOPK, "op12_ranked": _RANKED}
