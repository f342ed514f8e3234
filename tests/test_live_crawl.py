"""Live crawls against local servers: delays, robots, deadlines, stops."""

import threading
import time
from collections import defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from pagemill.operators.spider import CANCELLED, COMPLETED, PAUSED, Crawl, SpiderConfig, spider
from pagemill.sources import robots
from pagemill.sources.fetch_log import fetch_rows
from pagemill.sources.http import CrawlSettings, fetch, fetch_all, fetch_bytes, register_source

SITE = {"/": ["/a", "/b", "/private/x"], "/a": ["/c", "/d"], "/b": ["/d", "/e?q=1"], "/c": ["/f"], "/d": [], "/e": ["/f", "/g"], "/f": ["/"], "/g": []}
ROBOTS = "User-agent: *\nDisallow: /private\nCrawl-delay: 0.1\nSitemap: http://x/s.xml\n"


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        port, path = self.server.server_port, self.path.partition("?")[0]
        self.server.seen[self.path].append(time.monotonic())
        self.server.times.append(time.monotonic())
        if path == "/robots.txt":
            text = self.server.robots
            self.send_response(200 if text else 404)
            self.send_header("Content-Type", "text/plain")
            self.end_headers()
            self.wfile.write((text or "").encode())
        elif path.startswith("/slow"):  # four hops of 0.4 s each
            time.sleep(0.4)
            step = int(path[5:] or 0)
            self.send_response(302 if step < 4 else 200)
            self.send_header("Location", f"/slow{step + 1}")
            self.send_header("Content-Type", "text/html")
            self.end_headers()
        elif path == "/drip":
            self.send_response(200)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            try:
                for _ in range(60):
                    self.wfile.write(b"<p>x")
                    self.wfile.flush()
                    time.sleep(0.1)
            except OSError:
                pass
        elif path == "/hop":
            self.send_response(301)
            self.send_header("Location", "/d")
            self.end_headers()
        elif path == "/flaky" and len(self.server.seen[self.path]) == 1:
            self.connection.close()
        else:
            self.send_response(200 if path in SITE or path == "/flaky" else 404)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write((f"<html><title>{port}{path}</title>" + "".join(f'<a href="{u}">x</a>' for u in SITE.get(path, []))).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    made = []

    def start(text=None):
        s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        s.seen, s.times, s.robots = defaultdict(list), [], text
        threading.Thread(target=s.serve_forever, daemon=True).start()
        made.append(s)
        return s, f"http://127.0.0.1:{s.server_port}"

    yield start
    for s in made:
        s.shutdown()


def gaps(s):
    return [b - a for a, b in zip(sorted(s.times), sorted(s.times)[1:], strict=False)]


def test_hosts_are_asked_in_turn(spark, server):
    """Three hosts over four partitions: two have a delay, hops and retries included; the third is not held up."""
    (one, a), (two, b), (three, free) = server(), server(), server()
    rows = [(i, f"{a}/{p}", 120) for i, p in enumerate(["a", "b", "hop", "c", "flaky"])] + [(10 + i, f"{b}/{p}", 60) for i, p in enumerate("abcdefg")] + [(20 + i, f"{free}/{p}?{i}", 0) for i, p in enumerate("abcdefg")]
    urls = spark.createDataFrame(rows, "id long, url string, delay_ms long").repartition(4)
    got = {r.id: r for r in fetch_rows(fetch_all(urls, CrawlSettings(timeout_ms=3000), partitions=4)).collect()}
    assert set(got) == {r[0] for r in rows} and all(r.http.status_code in (200, 404) for r in got.values())
    assert got[2].http.redirect_chain[0].status == 301 and got[4].http.status_code == 200 and len(one.seen["/flaky"]) == 2
    assert len(one.times) == 7 and min(gaps(one)) >= 0.12 and min(gaps(two)) >= 0.06 and max(three.times) - min(three.times) < 5


def test_one_deadline_over_all_hops(spark, server):
    _, base = server()
    register_source(spark)
    source = lambda ms: spark.read.format("pagemill_fetch").option("urls", f"{base}/slow0\n{base}/drip\n{base}/a").option("timeoutMs", ms).option("retryOnce", "false").option("partitions", 3).load()
    for path in ("slow0", "drip"):
        began = time.monotonic()
        assert fetch(0, f"{base}/{path}", CrawlSettings(timeout_ms=1000))[4] == "Timeout" and 0.9 < time.monotonic() - began < 1.5
    got = {r.url.rpartition("/")[2]: r for r in source(1000).collect()}
    assert got["slow0"].error == got["drip"].error == "Timeout" and got["a"].status_code == 200 and "/a</title>" in got["a"].html
    kept = source(6000).where(F.col("url").endswith("slow0")).first()
    assert kept.status_code == 200 and len(kept.redirect_chain) == 5 and kept.redirect_time_ms >= 1500


def test_source_deals_hosts_and_empty_lists(spark, server):
    (one, a), (two, b) = server(), server()
    register_source(spark)
    urls = "\n".join(f"{h}/{p}" for p in "abcd" for h in (a, b))
    df = spark.read.format("pagemill_fetch").option("urls", urls).option("delayMs", 80).option("partitions", 2).load()
    assert df.count() == 8 and min(gaps(one)) >= 0.08 and min(gaps(two)) >= 0.08
    assert spark.read.format("pagemill_fetch").load().count() == 0


def test_robots_table(spark, server):
    (_, a), (_, b) = server("User-agent: *\nDisallow: /p\nAllow: /p/ok$\nDisallow: /*?s=\nCrawl-delay: 1.5\n"), server()
    origins = spark.createDataFrame([(a,), (b,), ("http://127.0.0.1:1",)], "origin string")
    table = robots.rules_table(origins, lambda df: fetch_bytes(df, CrawlSettings(timeout_ms=2000), 3), "pagemill")
    urls = spark.createDataFrame([(f"{h}{p}",) for h in (a, b, "http://127.0.0.1:1") for p in ("/p/x", "/p/ok", "/p/ok/", "/q?s=1", "")], "url string")
    got = {(r.url, r.allowed): r.delay_ms for r in robots.judge(urls, table).collect()}
    assert {u[len(a) :] for u, ok in got if ok and u.startswith(a)} == {"/p/ok", ""} and all(ok for u, ok in got if not u.startswith(a))
    assert {ms for (u, _), ms in got.items() if u.startswith(a)} == {1500} and {ms for (u, _), ms in got.items() if not u.startswith(a)} == {0}


def live(df):
    return fetch_rows(fetch_all(df, CrawlSettings(timeout_ms=3000), partitions=4))


def live_robots(df):
    return fetch_bytes(df, CrawlSettings(timeout_ms=3000), 3)


def test_spider_asks_for_robots_once_and_keeps_the_delay(spark, server):
    s, base = server(ROBOTS)
    crawl = Crawl(spark, base, live, SpiderConfig(max_depth=2), live_robots)
    assert crawl.run() == COMPLETED
    pages = {r.url[len(base) :] for r in crawl.results().select("url").collect()}
    assert pages == {"/", "/a", "/b", "/c", "/d", "/e"} and len(s.seen["/robots.txt"]) == 1 and not s.seen["/private/x"]
    assert min(gaps(s)) >= 0.1 and [tuple(r) for r in crawl.sitemaps().collect()] == [(base, "http://x/s.xml")]


COLUMNS = ["id", "url", "spider.depth", "spider.discovered_from", "spider.parents", "spider.is_orphan", "health_score"]


def test_a_stopped_crawl_goes_on(spark, server, tmp_path):
    """Stopped before any level: by pause, by a fetch that fails, and by another object on the same folder."""
    _, base = server()
    want = sorted(map(tuple, spider(spark, base, live).select(*COLUMNS).collect()))
    assert len(want) == 9
    for stop in range(4):
        seen = []

        def failing(df, stop=stop, seen=seen):
            seen.append(1)
            if len(seen) == stop + 1:
                raise RuntimeError("lost")
            return live(df)

        folder = str(tmp_path / f"c{stop}")
        with pytest.raises(RuntimeError, match="lost"):
            Crawl(spark, base, failing, folder=folder).run()
        again = Crawl(spark, base, live, folder=folder)
        assert (again.pages() is None) == (stop == 0)
        again.pause()
        assert again.run() == PAUSED and again.resume() == COMPLETED
        assert sorted(map(tuple, Crawl(spark, base, live, folder=folder).results().select(*COLUMNS).collect())) == want
    with pytest.raises(ValueError, match="other settings"):
        Crawl(spark, base, live, SpiderConfig(max_depth=1), folder=folder)


def test_cancel_keeps_whole_levels(spark, server):
    _, base = server()
    crawl = Crawl(spark, base, live)

    def cancelling(df):
        if df.where("url like '%/a'").count():  # level 1: someone cancels meanwhile
            crawl.cancel()
        return live(df)

    crawl.fetch = cancelling
    assert crawl.run() == CANCELLED and crawl.run() == CANCELLED
    assert {r.url[len(base) :] for r in crawl.results().select("url").collect()} <= {"/", "/a", "/b", "/private/x"}
