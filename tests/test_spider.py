import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from pagemill.operators import sitemap_gen, views
from pagemill.operators.spider import SpiderConfig, spider
from pagemill.sources.fetch_log import fetch_rows
from pagemill.sources.http import CrawlSettings, enumerate_urls, fetch_all

SITE = {"/": ["/a", "/b", "https://out.org/"], "/a": ["/c", "/"], "/b": ["/c", "/old"], "/c": ["/d"], "/d": []}


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        path = self.path.partition("?")[0]
        if path in ("/old", "/loop"):
            self.send_response(301)
            self.send_header("Location", "/a" if path == "/old" else "/loop")
            self.end_headers()
            return
        known = path in SITE
        self.send_response(200 if known else 404)
        self.send_header("Content-Type", "image/png" if path == "/img" else "text/html; charset=utf-8")
        self.send_header("Last-Modified", "Tue, 02 Jan 2024 03:04:05 GMT")
        self.end_headers()
        self.wfile.write(("<html><title>" + path + "</title>" + "".join(f'<a href="{u}">x</a>' for u in SITE.get(path, []))).encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetch(spark, base):
    urls = enumerate_urls(spark, [f"{base}/a", f"{base}/old", f"{base}/none", f"{base}/loop", f"{base}/img", "http://127.0.0.1:1/", f"{base}/a"])
    got = {r.id: r for r in fetch_rows(fetch_all(urls, CrawlSettings(timeout_ms=3000))).collect()}
    assert len(got) == 6 and got[0].http.status_code == 200 and "<title>/a" in got[0].html and got[0].http.headers["last-modified"].startswith("Tue")
    assert [(h.url.rpartition("/")[2], h.status) for h in got[1].http.redirect_chain] == [("old", 301), ("a", 200)]
    assert got[2].http.status_code == 404 and got[2].http.status_text == "Not Found" and got[3].error == "Too many redirects" and got[4].html is None and got[5].error
    kept = fetch_rows(fetch_all(enumerate_urls(spark, [f"{base}/old"]), CrawlSettings(follow_redirects=False))).first()
    assert kept.http.status_code == 301 and kept.http.redirect_chain == []


def test_spider(spark, base):
    fetch = lambda df: fetch_rows(fetch_all(df))
    pages = {r.url[len(base) :]: r for r in spider(spark, base, fetch).collect()}
    assert set(pages) == {"/", "/a", "/b", "/c", "/old", "/d"} and [pages[u].id for u in ("/", "/a", "/b", "/c", "/old", "/d")] == list(range(6))
    assert pages["/c"].spider.discovered_from == f"{base}/a" and pages["/c"].spider.depth == 2 and pages["/c"].spider.parents == [f"{base}{u}" for u in ("/a", "/b", "/old")]
    assert pages["/d"].spider.is_dead_end and pages["/"].spider.outbound_external == 1 and not pages["/"].spider.is_orphan and pages["/a"].spider.path_group == "/a"
    assert pages["/old"].http.redirect_chain[0].status == 301


def test_spider_limits(spark, base):
    fetch = lambda df: fetch_rows(fetch_all(df))
    urls = lambda **o: {r.url[len(base) :] for r in spider(spark, base, fetch, SpiderConfig(**o)).collect()}
    assert urls(max_pages=3) == {"/", "/a", "/b"} and urls(max_depth=1) == {"/", "/a", "/b"}
    assert urls(robots_txt="User-agent: *\nDisallow: /a\n") == {"/", "/b", "/c", "/old", "/d"} and urls(exclude=("/b",)) == {"/", "/a", "/c", "/d"}
    out = spider(spark, base, fetch, SpiderConfig(max_depth=1))
    assert views.project(out, views.SITE_STRUCTURE).count() == 3 and sitemap_gen.results_of(out).where("depth = 1").count() == 2
