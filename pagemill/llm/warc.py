"""WARC archives with revisit resolution.

Digests are computed where the pages are; headers (page_id, url, digest, length) are
shuffled by digest. The smallest page_id of equal payloads is the response, all others
become revisit records that refer to it and are written from their headers. Payloads stay
where they are while the list of revisits can be broadcast; beyond that they
are dealt by page_id and digest, so no payload that many pages share is a hot key.
Archives are written by Spark's own text writer, so any Hadoop file system and its commit
protocol serve, and read back as a stream, record by record, by Content-Length: neither
side holds more than a batch of records. A file is one gzip stream.

Defined results: a null payload is empty; equal page_ids with equal payloads are
one response each (a record never revisits its own page_id); a null page_id is
never a response that others refer to, and revisits one if there is one; empty tables give
no records; other columns of the input are ignored; a payload is bounded by what one row may hold (2 GB).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table_path

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Rows of one archive file.
RECORDS_PER_FILE = 2000
#: Behind each record, as between headers and block.
_GAP = b"\r\n\r\n"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string column's UTF-8 bytes: 160 bits are 32 digits of 5, in 4 groups of 40 bits."""
    hexed = F.sha1(text.cast("binary"))
    alphabet = F.lit(_B32)
    digits = []
    for group in range(4):
        value = F.conv(F.substring(hexed, group * 10 + 1, 10), 16, 10).cast("long")
        for k in range(7, -1, -1):
            digits.append(F.substring(alphabet, F.shiftright(value, 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)))
    return F.concat(*digits)


def resolve(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to); payload only of responses.

    min_bytes: smaller payloads are always responses. Page ids are carried by
    digest with a map-side minimum first, so a payload that a third of the
    pages share costs one row per task.
    """
    key = ["payload_digest", "payload_bytes"]
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    headers = materialize(rows.drop("payload"), "warc-headers")
    first = headers.where(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= min_bytes)).groupBy(*key).agg(F.min("page_id").alias("first_id"))
    revisits = headers.where(F.col("payload_bytes") >= min_bytes).join(first, key).where(~F.col("page_id").eqNullSafe(F.col("first_id")))
    revisits = materialize(revisits, "warc-revisits")
    gone = revisits.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).distinct()
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes"))
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest"]
    responses = rows.join(gone, same, "left_anti").select(*columns, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return responses.unionByName(revisits.withColumn("payload", F.lit("")).select(*columns, F.lit("revisit").alias("record_type"), F.col("first_id").alias("refers_to")))


def record_text(date: str) -> Column:
    """One record without its closing blank lines; a revisit has no payload."""
    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    uri = lambda c: F.concat(F.lit("<urn:pagemill:page:"), c.cast("string"), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    # a line break in a url would end its header early
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", uri(F.coalesce(F.col("page_id").cast("string"), F.lit("none")))),
        header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", url),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        header("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), header("WARC-Refers-To", uri(F.col("refers_to"))))).otherwise(""),
        header("Content-Type", F.lit("text/html; charset=utf-8")),
        header("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("payload")),
    )


def write_archives(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip", records_per_file: int = RECORDS_PER_FILE) -> str:
    """Write WARC files under path; each record ends with two CRLFs."""
    resolved.select(record_text(date).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path)
    return path


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record; raises on a broken record."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {}
        for line in lines[1:]:
            name, _, value = line.partition(b":")
            headers[name.decode().lower()] = value.strip().decode()
        size = int(headers["content-length"])
        block = content[end + 4 : end + 4 + size]
        at = end + 4 + size
        if len(block) != size or content[at : at + 4] != b"\r\n\r\n":
            raise ValueError("record is cut short")
        at += 4
        yield headers, block


def _page_of(uri: str | None) -> int | None:
    number = (uri or "").strip("<>").rpartition(":")[2]
    return int(number) if number.lstrip("-").isdigit() else None


def _described(headers: dict[str, str], block: bytes) -> tuple:
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
        raise ValueError(f"payload of {headers['warc-record-id']} does not have its digest")
    return _page_of(headers["warc-record-id"]), int(headers["x-payload-length"]), digest, headers["warc-type"], _page_of(headers.get("warc-refers-to"))


def stream_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of files that were split at empty lines; holds one record."""
    headers: dict[str, str] = {}
    need, held = -1, bytearray()  # need: bytes of the block, -1 between records
    for piece in pieces:
        held += piece
        held += _GAP
        while need >= 0 or held:
            if need < 0:
                # the record's last line breaks, and one gap more where a file ended
                del held[: len(held) - len(held.lstrip(b"\r\n"))]
                end = held.find(_GAP)
                if end < 0:
                    break
                lines = bytes(held[:end]).split(b"\r\n")
                if not lines[0].startswith(b"WARC/"):
                    raise ValueError("no WARC record where one should begin")
                headers = {k.decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines[1:])}
                need = int(headers["content-length"])
                del held[: end + len(_GAP)]
            if len(held) < need:
                break
            yield headers, bytes(held[:need])
            del held[:need]
            need = -1
    if need >= 0 or held.strip(b"\r\n"):
        raise ValueError("record is cut short")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    rows: list[tuple] = []

    def send() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
        rows.clear()
        return out

    for headers, block in stream_records(x.as_py() for b in batches for x in b.column(0)):
        rows.append(_described(headers, block))
        if len(rows) >= RECORDS_PER_FILE:
            yield send()
    yield send()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, from headers and blocks as stored; digests of blocks are verified. Files are gzip, which Spark does not split."""
    pieces = spark.read.option("lineSep", _GAP.decode()).text(path).select(F.col("value").cast("binary"))
    return pieces.mapInArrow(_read, RESULT)


def roundtrip(pages: DataFrame) -> DataFrame:
    """Write deduplicated archives of pages to the shared folder and read them back."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(resolve(pages), table_path(spark, "warc")))
