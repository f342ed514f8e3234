"""SQL of the audit over the pages table: the same rows by another engine."""

from __future__ import annotations

SQUEEZE = r"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def squeeze(x: str) -> str:
    return SQUEEZE.format(x=x)


def metrics(text: str, words: str) -> dict[str, str]:
    """Expressions over a squeezed text and its words."""
    stem = "regexp_replace(w2, '([^laeiouy]es|ed|[^laeiouy]e)$', '')"
    syl = f"list_sum(list_transform(list_transform({words}, lambda w: regexp_replace(lower(w), '[^a-z]', '', 'g')), lambda w2: CASE WHEN length(w2) = 0 THEN 0 WHEN length(w2) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all({stem}, '[aeiouy]{{1,2}}'))) END))"
    sent = f"greatest(1, len(regexp_extract_all({text}, '[.!?]+')))"
    level = f"CASE WHEN len({words}) > 0 THEN greatest(0.0::DOUBLE, floor((0.39::DOUBLE * (len({words})::DOUBLE / {sent}) + 11.8::DOUBLE * ({syl}::DOUBLE / len({words})) - 15.59::DOUBLE) * 10 + 0.5) / 10) ELSE 0.0::DOUBLE END"
    return {"words": f"len({words})", "sentences": sent, "syllables": f"coalesce({syl}, 0)::BIGINT", "level": level}


# The words that mark a language, in order of preference.
_LANGUAGES = [("English", ["the", "and", "of", "to", "is", "in"]), ("Spanish", ["el", "la", "de", "que", "y", "los"]), ("French", ["le", "la", "les", "des", "et", "une"]), ("German", ["der", "die", "und", "den", "ist", "das"])]


def language(text: str) -> str:
    part = f"substring(lower({text}), 1, 5000)"
    score = lambda ws: " + ".join(f"(len(string_split({part}, ' {w} ')) - 1)" for w in ws)
    best = "greatest(" + ", ".join(f"({score(ws)})" for _, ws in _LANGUAGES) + ")"
    cases = " ".join(f"WHEN ({score(ws)}) = {best} THEN '{n}'" for n, ws in _LANGUAGES)
    return f"CASE WHEN {best} <= 2 THEN 'Unknown' {cases} END"


DECODE = "replace(replace(replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&')"
_NO_BLOCKS = r"regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body>(.*)$', 1), '(?s)<nav>.*?</nav>|<footer>.*?</footer>|<script>.*?</script>|<style>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
VISIBLE = squeeze(DECODE.format(x=f"regexp_replace({_NO_BLOCKS}, '<[^>]*>', '', 'g')"))
HOST = r"lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
PATH = r"(CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END)"

LOG = r"""
log AS (
  SELECT page_id AS id, url, html AS raw,
    (CASE WHEN page_id % 37 = 0 THEN NULL WHEN page_id % 29 = 0 THEN 500 WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 23 = 0 THEN 301 ELSE 200 END)::INTEGER AS status,
    (page_id * 7919 % 3000)::INTEGER AS ttfb, (page_id * 104729 % 5000)::INTEGER AS dl,
    CASE WHEN page_id % 13 = 0 THEN 3 WHEN page_id % 7 = 0 THEN 2 ELSE 0 END AS chain,
    page_id % 5 <> 0 AS compressed, page_id % 3 = 0 AS hsts, page_id % 19 = 0 AS noindex
  FROM pages),
feat AS (
  SELECT *, CASE WHEN chain > 0 THEN id * 31 % 900 ELSE 0 END AS redirect_ms,
    CASE WHEN chain > 0 THEN chain - 1 + (CASE WHEN status BETWEEN 300 AND 399 THEN 1 ELSE 0 END) ELSE 0 END AS redirects,
    trim(__DECODE_TITLE__) AS title,
    floor(octet_length(encode(html)) / 1024.0::DOUBLE * 10 + 0.5) / 10 AS kb,
    __VISIBLE__ AS visible
  FROM (SELECT *, CASE WHEN status IS NOT NULL THEN raw END AS html FROM log) t),
full_feat AS (
  SELECT *, len(list_filter(string_split(visible, ' '), lambda w: w <> '')) AS words,
    floor(length(visible)::DOUBLE / octet_length(encode(html)) * 100 * 10 + 0.5) / 10 AS ratio,
    CASE WHEN title <> '' THEN count(*) OVER (PARTITION BY CASE WHEN html IS NULL THEN NULL ELSE lower(title) END, html IS NULL) > 1 ELSE false END AS dup
  FROM feat)
""".replace("__VISIBLE__", VISIBLE).replace("__DECODE_TITLE__", DECODE.format(x="regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))

_N = "CASE WHEN {x} = floor({x}) THEN {x}::BIGINT::VARCHAR ELSE {x}::VARCHAR END"


def _say(before: str, x: str, after: str) -> str:
    return f"'{before}' || ({_N.format(x='(' + x + ')')}) || '{after}'"


# (category, severity, field, condition, message, number, text) of the rules that can hold on these pages.
_RULES = [
    ("seo", "warning", "title", "title = ''", "'Missing title tag'", None, None),
    ("seo", "warning", "titleLength", "title <> '' AND length(title) < 30", _say("Title too short (", "length(title)", " chars, <30)"), "length(title)", None),
    ("seo", "warning", "titleLength", "length(title) > 60", _say("Title too long (", "length(title)", " chars, >60)"), "length(title)", None),
    ("seo", "warning", "titlePixelWidth", "length(title) * 6 > 580", _say("Title may truncate in SERP (~", "length(title) * 6", "px)"), "length(title) * 6", None),
    ("seo", "critical", "duplicateTitle", "dup", "'Title duplicated on another page'", None, "title"),
    ("seo", "warning", "metaDescription", "true", "'Missing meta description'", None, None),
    ("seo", "critical", "xRobotsTag", "noindex", "'X-Robots-Tag is noindex'", None, "'noindex'"),
    ("seo", "warning", "canonical", "true", "'Missing canonical tag'", None, None),
    ("seo", "critical", "isIndexable", "true", "'Page is not indexable'", None, None),
    ("seo", "warning", "urlLength", "length(url) > 115", _say("URL very long (", "length(url)", " chars)"), "length(url)", None),
    ("performance", "critical", "ttfb", "ttfb > 2000", _say("Very slow TTFB (", "ttfb", "ms)"), "ttfb", None),
    ("performance", "warning", "ttfb", "ttfb > 800 AND ttfb <= 2000", _say("Slow TTFB (", "ttfb", "ms)"), "ttfb", None),
    ("performance", "warning", "download", "dl > 3000", _say("Slow download (", "dl", "ms)"), "dl", None),
    ("performance", "warning", "redirectTime", "redirect_ms > 500", _say("Slow redirects (", "redirect_ms", "ms)"), "redirect_ms", None),
    ("performance", "critical", "redirects", "redirects > 3", _say("Redirect chain too long (", "redirects", ")"), "redirects", None),
    ("performance", "warning", "redirects", "redirects > 1 AND redirects <= 3", _say("Multiple redirects (", "redirects", ")"), "redirects", None),
    ("performance", "warning", "htmlSize", "kb > 100", _say("Large HTML (", "kb", "KB)"), "kb", None),
    ("performance", "warning", "compression", "NOT compressed", "'Response not compressed'", None, None),
    ("content", "warning", "wordCount", "words < 300", _say("Thin content (", "words", " words, <300)"), "words", None),
    ("content", "warning", "textRatio", "ratio < 10", _say("Low text/HTML ratio (", "ratio", "%)"), "ratio", None),
    ("technical", "critical", "https", "NOT starts_with(url, 'https://')", "'Not served over HTTPS'", None, None),
    ("technical", "warning", "viewport", "true", "'Missing viewport meta'", None, None),
    ("technical", "warning", "favicon", "true", "'No favicon found'", None, None),
    ("technical", "warning", "hsts", "starts_with(url, 'https://') AND NOT hsts", "'Missing HSTS header on HTTPS'", None, None),
    *[("social", s, f, "true", f"'{m}'", None, None) for s, f, m in (("warning", "ogTitle", "Missing og:title"), ("warning", "ogDescription", "Missing og:description"), ("warning", "ogImage", "Missing og:image"), ("warning", "ogType", "Missing og:type"), ("warning", "ogUrl", "Missing og:url"), ("critical", "ogComplete", "Open Graph tags incomplete"), ("warning", "twitterCard", "Missing twitter:card"), ("warning", "structuredData", "No structured data found"))],
]
_ROW = "SELECT id, '{c}' AS category, '{s}' AS severity, '{f}' AS field, {m} AS message, {n}::DOUBLE AS value_num, {t}::VARCHAR AS value_str FROM full_feat WHERE status < 400 AND ({w})"
ISSUES = "issues AS (\n  " + "\n  UNION ALL ".join(_ROW.format(c=c, s=s, f=f, m=m, n=n or "NULL", t=t or "NULL", w=w) for c, s, f, w, m, n, t in _RULES) + """
  UNION ALL SELECT id, 'technical', 'critical', 'request', CASE WHEN status IS NULL THEN 'Timeout' WHEN status = 404 THEN 'HTTP 404 Not Found' ELSE 'HTTP 500 Internal Server Error' END, status::DOUBLE, NULL FROM full_feat WHERE status IS NULL OR status >= 400)"""
_SCORE = "CASE WHEN bool_or(f.status IS NULL OR f.status >= 400) THEN 0 ELSE greatest(0, 100 - 10 * count(*) FILTER (WHERE i.category = '{c}' AND i.severity = 'critical') - 5 * count(*) FILTER (WHERE i.category = '{c}' AND i.severity = 'warning')) END AS {c}_score"
SCORED = "scored AS (\n  SELECT f.id, any_value(f.url) AS url, any_value(f.status) AS status, any_value(f.title) AS title, any_value(f.ttfb) AS ttfb, any_value(f.words) AS words, any_value(f.chain) AS chain, any_value(f.html IS NOT NULL) AS is_html, any_value(f.dup) AS dup, any_value(f.compressed) AS compressed, any_value(f.ratio) AS ratio, any_value(f.hsts) AS hsts,\n    count(i.id) FILTER (WHERE i.severity = 'critical') AS critical, count(i.id) AS total, string_agg(i.message, ' ') AS messages,\n    " + ", ".join(_SCORE.format(c=c) for c in ("seo", "performance", "content", "technical", "social", "images")) + """
  FROM full_feat f LEFT JOIN issues i ON i.id = f.id GROUP BY f.id),
audited AS (
  SELECT *, floor(0.0::DOUBLE + seo_score * 0.35::DOUBLE + performance_score * 0.25::DOUBLE + content_score * 0.15::DOUBLE + technical_score * 0.1::DOUBLE + social_score * 0.1::DOUBLE + images_score * 0.05::DOUBLE + 0.5)::INTEGER AS health,
    CASE WHEN status IS NULL OR status >= 400 THEN 'error' WHEN total > 0 THEN 'warning' ELSE 'ok' END AS row_status,
    CASE WHEN status IS NULL THEN 'errors' WHEN status >= 500 THEN '5xx' WHEN status >= 400 THEN '4xx' WHEN status >= 300 THEN '3xx' ELSE '2xx' END AS status_group
  FROM scored)"""


def audit_sql(select: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{LOG},\n{ISSUES},\n{SCORED}{', ' + more if more else ''}\n{select}"


GRAPH = """
n AS (SELECT count(*) AS n FROM pages),
res AS (SELECT id, 'p' || id AS url, (CASE WHEN id = 0 THEN 0 ELSE 1 + id % 4 END)::INTEGER AS depth, status, health, coalesce(title, '') AS title, chain,
  CASE WHEN id % 11 = 10 THEN []::VARCHAR[] WHEN (id * 3 + 1) % n = (id * 7 + 2) % n THEN ['p' || ((id * 3 + 1) % n)] ELSE ['p' || ((id * 3 + 1) % n), 'p' || ((id * 7 + 2) % n)] END AS links FROM audited, n),
edges AS (SELECT url AS source, unnest(links) AS target FROM res),
inner_edges AS (SELECT source, target FROM edges WHERE source <> target AND target IN (SELECT url FROM res)),
nodes AS (SELECT r.id, r.url, r.depth, r.status, r.health AS health_score, r.title, CASE WHEN r.status IS NULL OR r.status >= 400 THEN 'error' WHEN r.status >= 300 OR r.chain > 0 THEN 'redirect' ELSE 'page' END AS type,
  coalesce(d.k, 0)::BIGINT AS in_degree, len(r.links)::BIGINT AS out_degree FROM res r LEFT JOIN (SELECT target, count(DISTINCT source) AS k FROM inner_edges GROUP BY target) d ON d.target = r.url)"""
