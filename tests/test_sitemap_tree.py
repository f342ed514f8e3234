"""Sitemap trees level by level against depth-first search."""

import random

import pytest

from pagemill.sources import sitemap


def index(*urls):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"


def urlset(*urls):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"


def depth_first(docs, children, start, most):
    seen, urls = [], {}
    stack = [start]
    while stack:
        at = stack.pop()
        if at in seen or len(seen) >= most:
            continue
        seen.append(at)
        if at not in docs:
            return [], 0
        urls.update(dict.fromkeys(children[at][0]))
        stack += reversed(children[at][1])
    return list(urls), len(seen)


def run(spark, children, start, most=50, lost=()):
    docs = {k: index(*n) if n else urlset(*u) for k, (u, n) in children.items() if k not in lost}
    asked = spark.sparkContext.accumulator(0)

    def fetch(url):
        asked.add(1)
        return docs[url]

    got = sitemap.resolve_tree(spark, start, sitemap._from_texts(fetch), most=most)
    want = depth_first(docs, children, start, most)
    assert ([r.url for r in got.urls.orderBy("at").collect()], got.sitemap_count) == want and (got.error is None) == bool(want[1])
    return asked.value


def test_index_of_sixty_files_with_a_cycle(spark):
    """More than the cap; an index inside names its parent, an earlier and a later file."""
    files = {f"s{i}": ([f"u{i}", f"u{i % 7}"], []) for i in range(60)}
    tree = files | {"root": ([], [*[f"s{i}" for i in range(10)], "inner", *[f"s{i}" for i in range(10, 60)]]), "inner": ([], ["s40", "root", "s3", "inner", "s59"])}
    asked = run(spark, tree, "root")
    assert asked <= 53  # those the cap keeps, and the few that deeper ones pushed out
    run(spark, tree, "root", most=9, lost=("s3",))
    run(spark, tree, "root", most=9, lost=("s40",))  # beyond the cap: never missed


@pytest.mark.parametrize("seed", [1])
def test_any_graph_is_read_as_depth_first_search_reads_it(spark, seed):
    rng = random.Random(seed)
    names = [f"i{k}" for k in range(8)]
    children = {n: ([], rng.choices([*names, *[f"s{k}" for k in range(12)]], k=rng.randint(1, 5))) for n in names} | {f"s{k}": ([f"u{rng.randint(0, 20)}" for _ in range(3)], []) for k in range(12)}
    for most in (9,):
        run(spark, children, "i0", most)


def test_gzip_that_is_none_is_an_error(spark, tmp_path):
    got = sitemap.resolve(spark, "https://a.com/s.xml.gz", lambda u: urlset("x"))
    assert got["urls"] == [] and got["error"]
    (tmp_path / "i.xml").write_text(index("r1", "r2"))
    docs = {"r1": urlset("a", "b"), "r2": urlset("b", "c")}
    assert sitemap.read_file(spark, str(tmp_path / "i.xml"), docs.__getitem__) == {"urls": ["a", "b", "c"], "sitemap_count": 3, "error": None}
    assert sitemap.read_file(spark, str(tmp_path / "i.xml"))["error"] == "r1 is remote"
