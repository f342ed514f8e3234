"""Live fetches: hosts are dealt to partitions, each host has a queue and a due time, one deadline covers all hops.

Rows have the shape that fetch_rows() takes. Where pages are already fetched, none of this is needed.

A host with a crawl delay is in one partition, asked by one request at a time, and the next one starts no sooner than
its delay after the last was answered; a task waits the delay before its first request too, as another
stage may have asked the host just before. Hops of a redirect wait for their host as well, as far as this partition knows it.
A task that Spark runs again fetches again.
"""

from __future__ import annotations

import gzip
import heapq
import http.client
import socket
import threading
import time
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from contextlib import suppress
from dataclasses import dataclass, replace
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.urls import host_of, parse
from .fetch_log import MAX_BODY_BYTES, MAX_REDIRECTS

RAW = "id long, url string, status_code int, status_text string, error string, redirect_chain array<struct<url:string,status:int>>, ttfb_ms int, total_download_ms int, redirect_time_ms int, content_type string, http_version string, headers map<string,string>, html string"
#: As RAW, with the body of any type.
RAW_BYTES = RAW.replace("html string", "content binary")
_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.struct([("url", pa.string()), ("status", pa.int32())])), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]
_NAMES = [x.split()[0] for x in ("id long, url string, status_code int, status_text string, error string, redirect_chain a, ttfb_ms int, total_download_ms int, redirect_time_ms int, content_type string, http_version string, headers m, html string").split(", ")]
#: Urls that a task holds in its queues, and rows of a batch that it returns.
MAX_WAITING, BATCH = 100_000, 64


@dataclass(frozen=True)
class CrawlSettings:
    concurrency: int = 10
    timeout_ms: int = 15_000
    user_agent: str = "Mozilla/5.0 (compatible; pagemill/1.0)"
    follow_redirects: bool = True
    retry_once: bool = True
    delay_ms: int = 0
    max_hops: int = MAX_REDIRECTS
    any_body: bool = False

    def workers(self) -> int:
        return max(1, min(50, self.concurrency))


class _Hop:
    """One request; at the end of its time the socket is shut, whatever it waits for."""

    def __init__(self, seconds: float) -> None:
        self.seconds, self.expired, self.con, self.sock = seconds, False, None, None
        self.timer = threading.Timer(seconds, self._cut)
        self.timer.daemon = True

    def _cut(self) -> None:
        self.expired = True
        with suppress(OSError, AttributeError):
            self.sock.shutdown(socket.SHUT_RDWR)

    def ask(self, url: str, s: CrawlSettings) -> http.client.HTTPResponse:
        u = urlsplit(url)
        kind = http.client.HTTPSConnection if u.scheme == "https" else http.client.HTTPConnection
        self.con = kind(u.hostname, u.port, timeout=self.seconds)
        self.timer.start()
        self.con.connect()
        self.sock = self.con.sock  # the connection lets go of it where the body ends with it
        self.con.request("GET", (u.path or "/") + (f"?{u.query}" if u.query else ""), headers={"User-Agent": s.user_agent, "Accept": "text/html,application/xhtml+xml,*/*;q=0.8", "Accept-Encoding": "gzip, deflate"})
        response = self.con.getresponse()
        if self.expired:
            raise TimeoutError
        return response

    def body(self, response: http.client.HTTPResponse) -> bytes:
        parts, size = [], 0
        while size < MAX_BODY_BYTES and (part := response.read1(min(1 << 16, MAX_BODY_BYTES - size))):
            parts.append(part)
            size += len(part)
        if self.expired:
            raise TimeoutError
        raw = b"".join(parts)
        kind = (response.headers.get("content-encoding") or "").lower()
        if kind == "gzip":
            raw = zlib.decompressobj(31).decompress(raw, MAX_BODY_BYTES) if raw[:2] == b"\x1f\x8b" else gzip.decompress(raw)
        elif kind == "deflate":
            raw = zlib.decompressobj().decompress(raw, MAX_BODY_BYTES)
        return raw

    def close(self) -> None:
        self.timer.cancel()
        if self.con is not None:
            self.con.close()


def fetch(row_id: int, url: str, s: CrawlSettings, turn: Callable[[str], None] = lambda host: None, asked: Callable[[str], None] = lambda host: None) -> tuple:
    """One raw row; errors are rows too. At most max_hops requests within one timeout; every status is a result.

    turn is called before each request and may wait, which does not count; asked when it has been answered.
    """
    def failed(text: str) -> tuple:
        return (row_id, url, None, None, text, [], 0, 0, 0, None, None, [], None)

    chain: list[dict] = []
    at, redirect_ms, left = url, 0.0, s.timeout_ms / 1000
    for _ in range(s.max_hops):
        host = getattr(parse(at), "host", "")
        turn(host)
        began, hop = time.monotonic(), _Hop(left)
        try:
            r = hop.ask(at, s)
            asked(host)
            target = r.headers.get("location")
            if 300 <= r.status < 400 and target and s.follow_redirects:
                chain.append({"url": at, "status": r.status})
                took = time.monotonic() - began
                redirect_ms, left = redirect_ms + took * 1000, left - took
                following = parse(target, parse(at))
                if following is not None:
                    if left <= 0:
                        return failed("Timeout")
                    at = following.href
                    continue
            ttfb = (time.monotonic() - began) * 1000
            kind = r.headers.get("content-type") or ""
            raw = hop.body(r) if s.any_body or "text/html" in kind.lower() else None
        except (OSError, http.client.HTTPException, ValueError, zlib.error, EOFError) as e:
            asked(host)
            return failed("Timeout" if hop.expired or isinstance(e, TimeoutError) else str(e) or type(e).__name__)
        finally:
            hop.close()
        total = (time.monotonic() - began) * 1000
        full = [*chain, {"url": at, "status": r.status}] if chain else []
        headers = list({k.lower(): v for k, v in r.headers.items()}.items())
        body = raw if raw is None or s.any_body else raw.decode("utf-8", "replace")
        return (row_id, url, r.status, r.reason, None, full, int(ttfb), int(total), int(redirect_ms), kind, "1.1" if r.version == 11 else "1.0", headers, body)
    return failed("Too many redirects")


class _Turns:
    """Due times of the hosts that have a delay."""

    def __init__(self) -> None:
        self.lock, self.delays, self.due = threading.Lock(), {}, {}

    def know(self, host: str, delay: float) -> None:
        with self.lock:
            if delay > 0 and host not in self.delays:
                self.delays[host], self.due[host] = delay, time.monotonic() + delay

    def take(self, host: str) -> None:
        """Wait for the host's turn and reserve the next."""
        if host not in self.delays:
            return
        with self.lock:
            at = max(time.monotonic(), self.due[host])
            self.due[host] = at + self.delays[host]
        time.sleep(max(0.0, at - time.monotonic()))

    def answered(self, host: str) -> None:
        if host in self.delays:
            with self.lock:
                self.due[host] = max(self.due[host], time.monotonic() + self.delays[host])


def fetch_in_turn(rows: Iterator[tuple[int, str, float]], s: CrawlSettings) -> Iterator[tuple]:
    """Raw rows of (id, url, delay in seconds), as they come; failures are tried once more, in their host's next turn."""
    turns, queues, ready, order = _Turns(), {}, [], 0
    waiting, busy, more = 0, {}, True

    def queue(host: str, row: tuple) -> None:
        nonlocal order, waiting
        waiting += 1
        if host not in queues:
            queues[host] = deque()
            order += 1
            heapq.heappush(ready, (turns.due.get(host, 0.0), order, host))
        queues[host].append(row)

    with ThreadPoolExecutor(s.workers()) as pool:
        while more or waiting or busy:
            while more and waiting < MAX_WAITING:
                row = next(rows, None)
                if row is None:
                    more = False
                    break
                host = getattr(parse(row[1]), "host", "")
                turns.know(host, row[2])
                queue(host, (row[0], row[1], False))
            while ready and len(busy) < s.workers() and ready[0][0] <= time.monotonic():
                _, _, host = heapq.heappop(ready)
                row = queues[host].popleft()
                waiting -= 1
                polite = host in turns.delays
                busy[pool.submit(fetch, row[0], row[1], s, turns.take, turns.answered)] = (host, row, polite)
                if queues[host] and not polite:
                    order += 1
                    heapq.heappush(ready, (0.0, order, host))
                elif not queues[host] and not polite:
                    del queues[host]
            pause = max(0.0, ready[0][0] - time.monotonic()) if ready and len(busy) < s.workers() else None
            done: set[Future] = wait(busy, timeout=pause, return_when=FIRST_COMPLETED).done if busy else set()
            if not busy and pause:
                time.sleep(pause)
            for f in done:
                host, row, polite = busy.pop(f)
                if polite:  # its queue was held back until now
                    left = queues.pop(host)
                    for x in left:
                        waiting -= 1
                        queue(host, x)
                if f.result()[4] and s.retry_once and not row[2]:
                    queue(host, (row[0], row[1], True))
                else:
                    yield f.result()


def _batches(rows: Iterator[tuple], s: CrawlSettings) -> Iterator[pa.RecordBatch]:
    types, names = (_TYPES[:-1] + [pa.binary()], _NAMES[:-1] + ["content"]) if s.any_body else (_TYPES, _NAMES)
    held: list[tuple] = []
    pack = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names=names)
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pack()
            held = []
    if held:
        yield pack()


def fetch_all(urls: DataFrame, settings: CrawlSettings = CrawlSettings(), partitions: int | None = None) -> DataFrame:
    """urls(id, url[, delay_ms]) -> raw fetch rows.

    Urls of a host with a delay are in one partition, others are spread; without any delay rows stay where they are
    unless partitions are asked for.
    """
    delay = F.coalesce(F.col("delay_ms"), F.lit(settings.delay_ms)) if "delay_ms" in urls.columns else F.lit(settings.delay_ms)
    asked = urls.select(F.col("id").cast("long"), F.col("url").cast("string"), (delay / 1000).cast("double").alias("delay"))
    if "delay_ms" in urls.columns or settings.delay_ms:
        host = F.regexp_replace(host_of(F.col("url")), ":(80|443)$", "")
        place = F.when(F.col("delay") > 0, F.xxhash64(host)).otherwise(F.xxhash64("id"))
        asked = asked.repartition(partitions or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")), place)
    elif partitions:
        asked = asked.repartition(partitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[col.to_pylist() for col in b.columns], strict=True))
        return _batches(fetch_in_turn(rows, settings), settings)

    return asked.mapInArrow(run, RAW_BYTES if settings.any_body else RAW)


def fetch_bytes(urls: DataFrame, settings: CrawlSettings = CrawlSettings(), max_redirects: int = 5) -> DataFrame:
    """urls(id, url[, delay_ms]) -> (id, url, content, error): bodies of any type; every status but 200 to 399 is an error."""
    got = fetch_all(urls, replace(settings, any_body=True, max_hops=max_redirects + 1, retry_once=False))
    bad = F.when(~F.col("status_code").between(200, 399), F.concat(F.lit("Request failed with status code "), F.col("status_code").cast("string")))
    return got.select("id", "url", F.coalesce("error", bad).alias("error"), F.when(bad.isNull(), F.col("content")).alias("content"))


# ---------------------------------------------------------------- data source

@dataclass
class _Dealt(InputPartition):
    rows: list[tuple[int, str]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.urls = list(dict.fromkeys(u for u in options.get("urls", "").split("\n") if u.strip()))
        self.parts = int(options.get("partitions", 8))
        self.settings = CrawlSettings(int(options.get("concurrency", 10)), int(options.get("timeoutms", 15_000)), options.get("useragent", CrawlSettings.user_agent), options.get("followredirects", "true") == "true", options.get("retryonce", "true") == "true", int(options.get("delayms", 0)))

    def partitions(self) -> list[InputPartition]:
        """All urls of a host in one partition where there is a delay, else dealt in turn."""
        dealt: list[list[tuple[int, str]]] = [[] for _ in range(max(1, self.parts))]
        for i, url in enumerate(self.urls):
            place = zlib.crc32(getattr(parse(url), "host", "").encode()) if self.settings.delay_ms else i
            dealt[place % len(dealt)].append((i, url))
        return [_Dealt(rows) for rows in dealt if rows] or [_Dealt([])]

    def read(self, partition: _Dealt) -> Iterator[pa.RecordBatch]:
        rows = ((i, url, self.settings.delay_ms / 1000) for i, url in partition.rows)
        return _batches(fetch_in_turn(rows, self.settings), self.settings)


class FetchSource(DataSource):
    """spark.read.format("pagemill_fetch").option("urls", "a url a line"): raw fetch rows of a list of urls.

    Options: urls, partitions, concurrency, timeoutMs (one deadline over all hops), userAgent, followRedirects, retryOnce,
    delayMs (between requests to a host). Larger lists are tables: fetch_all.
    """

    @classmethod
    def name(cls) -> str:
        return "pagemill_fetch"

    def schema(self) -> str:
        return RAW

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def register_source(spark: SparkSession) -> None:
    spark.dataSource.register(FetchSource)


def enumerate_urls(spark: SparkSession, urls: list[str]) -> DataFrame:
    """(id, url) of a list of urls, distinct, in order."""
    return spark.createDataFrame(list(enumerate(dict.fromkeys(urls))), "id long, url string")
