import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions import urls as U
from pagemill.operators.sitemap_gen import auto_priority


def value(spark, column, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize("word, n", [("", 0), ("a", 1), ("the", 1), ("table", 1), ("created", 2), ("queue", 1), ("Réading", 2), ("rhythms", 1), ("boxes", 1), ("123", 0)])
def test_syllables(spark, word, n):
    import re

    w = re.sub("[^a-z]", "", word.lower())
    stem = re.sub("([^laeiouy]es|ed|[^laeiouy]e)$", "", w)
    want = 0 if not w else 1 if len(w) <= 3 else max(1, len(re.findall("[aeiouy]{1,2}", stem)))
    assert value(spark, T.syllables(F.lit(word))) == want


def test_numbers(spark):
    assert value(spark, T.round_half_up(F.lit(2.5))) == 3 and value(spark, T.round_half_up(F.lit(-2.5))) == -2
    assert value(spark, T.number_text(F.lit(100.0))) == "100" and value(spark, T.number_text(F.lit(9.5))) == "9.5"
    assert [auto_priority(d, 0) for d in range(8)] == ["1.0", "0.8", "0.7", "0.6", "0.4", "0.3", "0.1", "0.1"]
    assert auto_priority(3, 2) == "0.8"  # 0.55 + 0.2 lies just below or at 0.75


def test_text_metrics(spark):
    assert value(spark, T.squeeze(F.lit("  a  \n b  "))) == "a b"
    assert value(spark, T.sentences(F.lit("none"))) == 1 and value(spark, T.sentences(F.lit("A... B! C?"))) == 3
    assert value(spark, T.detect_language(F.lit("x the y and z of w"))) == "English"
    assert value(spark, T.detect_language(F.lit("x la u de z"))) == "Unknown"
    assert value(spark, T.detect_language(F.lit("x la y la z la w"))) == "Spanish"  # shared with French, first wins
    assert value(spark, T.reading_level(F.lit(""), T.words(F.lit("")))) == 0.0


@pytest.mark.parametrize(
    "raw, base, want",
    [
        ("HTTP://EX.com:80/A/../b/./c?q=1#f", None, "http://ex.com/b/c?q=1#f"),
        ("/x y", "https://ex.com/a/b", "https://ex.com/x%20y"),
        ("../z", "https://ex.com/a/b/c", "https://ex.com/a/z"),
        ("?p=1", "https://ex.com/a/b?x", "https://ex.com/a/b?p=1"),
        ("#top", "https://ex.com/a?x", "https://ex.com/a?x#top"),
        ("//cdn.ex.com/a", "https://ex.com/", "https://cdn.ex.com/a"),
        ("é", "https://ex.com/", "https://ex.com/%C3%A9"),
        ("https://ex.com", None, "https://ex.com/"),
        ("mailto:a@b", "https://ex.com/", "mailto:a@b"),
        ("nonsense", None, None),
        ("https://a b/", None, None),
        ("https://ex.com:8080/", None, "https://ex.com:8080/"),
    ],
)
def test_parse(raw, base, want):
    got = U.parse(raw, U.parse(base) if base else None)
    assert (got.href if got else None) == want


@pytest.mark.parametrize(
    "raw, keep, want",
    [
        ("https://Ex.com/a/?b=2&a=1#x", False, "https://ex.com/a"), ("https://ex.com/a?b=2&a=1&a=0", True, "https://ex.com/a?a=0&a=1&b=2"), ("https://ex.com", False, "https://ex.com/"),
        ("#x", False, None), ("mailto:x", False, None), ("JavaScript:x", False, None), ("ftp://ex.com/a", False, None), ("https://ex.com/%C3%A9%2Fb", False, "https://ex.com/é%2Fb"), ("https://ex.com/a//", False, "https://ex.com/a/"), ("", False, None),
    ],
)
def test_crawl_key(raw, keep, want):
    assert U.crawl_key(raw, "https://base.com/", keep) == want
    if want:
        assert keep or U.crawl_key(want) == U.crawl_key(U.crawl_key(want))


def test_page_key():
    assert U.page_key("https://ex.com/a/?q#f") == "https://ex.com/a?q" and U.page_key("bad/#x") == "bad" and U.page_key("https://ex.com/") == "https://ex.com/"


@pytest.mark.parametrize(
    "path, pattern, want",
    [
        ("/blog", "/blog/*", True), ("/blog/a/b", "/blog/*", True), ("/blogger", "/blog/*", False), ("/a/b.html", "/*.html", False), ("/b.html", "/*.html", True), ("/a/b/c.html", "/**/*.html", True), ("/c.html", "/**/*.html", True),
        ("/X", "/x", True), ("/a1", "/a[0-9]", True), ("/ab", "/a[!b]", False), ("/b", "/{a,b}", True), ("/a", "/?", True), ("/a", "", False), ("/a", "  ", False), ("/a.b", "/a?b", True), ("/axb", "/a.b", False),
    ],
)
def test_globs(spark, path, pattern, want):
    assert value(spark, U.glob_match(F.lit(path), pattern)) == want


def test_url_columns(spark):
    u = F.lit("https://Blog.Ex.com:8080/a/b?q")
    assert value(spark, U.host_of(u)) == "blog.ex.com:8080" and value(spark, U.path_of(u)) == "/a/b" and value(spark, U.path_group(U.path_of(u))) == "/a"
    assert value(spark, U.host_of(F.lit(None).cast("string"))) == "" and value(spark, U.path_group(F.lit("/"))) == "/"
    assert value(spark, U.is_internal(F.lit("shop.ex.com"), "www.ex.com", True)) and not value(spark, U.is_internal(F.lit("shop.ex.com"), "www.ex.com"))
    assert not value(spark, U.is_internal(F.lit("notex.com"), "www.ex.com", True))


def test_priority_beyond_deep_pages_and_order_of_any_id(spark):
    from pyspark.sql import functions as F

    from pagemill.operators import sitemap_gen as S

    cases = [(d, 10 * t) for d in (0, 1, 2, 3, 5, 7, 11, 29, 31, 40, 60) for t in (0, 1, 2, 3, 7, 9, 44, 45, 46, 61, 90)]
    df = spark.createDataFrame([(i, d, n, "http://a/x") for i, (d, n) in enumerate(cases)], "id long, depth long, inbound long, url string")
    got = df.select("id", S.priority(S.SitemapConfig(priority="auto")).alias("p")).collect()
    assert {r.id: r.p for r in got} == {i: S.auto_priority(d, n // 10) for i, (d, n) in enumerate(cases)}
    ids = [5, 2000, (1 << 30) + 7, (1 << 31) + 9, (1 << 45) + 1, 0]
    placed = S.numbered(spark.createDataFrame([(i,) for i in ids], "id long").select("id", F.lit(1).alias("x")), 2).collect()
    assert {r.id: r.position for r in placed} == {x: k for k, x in enumerate(sorted(ids))}
