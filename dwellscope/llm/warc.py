"""Content-addressed WARC archive.

An archive is two Parquet tables in one folder: ``payloads`` holds each
distinct payload once (compressed, under its SHA-1 and SHA-256), ``headers``
holds for each record its exact header bytes (WARC header, blank line and HTTP
header) and the payload's digests. Payloads are equal only if both digests
are, so a SHA-1 collision never merges two of them. Reading joins the headers
with the payloads and rebuilds every record; lengths and both digests are
checked. Records of frequent payloads are dealt over tasks.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with
the largest page_id is a ``response``, the others ``revisit`` it; smaller ones
are all responses.

Defined cases: a null html is the empty payload; a null url becomes
``urn:page:<id>``; a null page_id loses against any other id; repeated rows
(same id and payload) share their record type; an empty table gives an empty
archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, shared_dir, slices, spread_join, table

MIN_BYTES = 0
#: The date that record headers carry, unless another is given.
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_PAYLOAD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("sha1", pa.binary()), ("sha256", pa.binary()), ("n", pa.int64()), ("payload", pa.binary())])
_PAYLOAD_DDL = "page_id long, url string, sha1 binary, sha256 binary, n long, payload binary"
_META = pa.schema([f for f in _PAYLOAD if f.name != "payload"])
_META_DDL = _PAYLOAD_DDL.removesuffix(", payload binary")
_HEADER = pa.schema([("page_id", pa.int64()), ("sha1", pa.binary()), ("sha256", pa.binary()), ("header", pa.binary())])
_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_BYTES = pa.schema([("page_id", pa.int64()), ("record", pa.binary())])


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, sha1: bytes) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{sha1.hex()}')}"


def _pages(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for rows in slices(batches, 64):
            raw = [h.encode("utf-8", "surrogatepass") for h in rows["html"]]
            out = {
                "page_id": rows["page_id"],
                "url": rows["url"],
                "sha1": [hashlib.sha1(x).digest() for x in raw],
                "sha256": [hashlib.sha256(x).digest() for x in raw],
                "n": [len(x) for x in raw],
            }
            if with_payload:
                yield batch_of({**out, "payload": [pack.compress(x) for x in raw]}, _PAYLOAD)
            else:
                yield batch_of(out, _META)

    return run


def header_bytes(page_id: int | None, url: str | None, sha1: bytes, n: int, keep_id: int | None, revisit: bool, date: str = DATE) -> bytes:
    """WARC and HTTP header of a record; the payload, if any, follows directly."""
    http = HTTP + f"Content-Length: {n}\r\n\r\n".encode()
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id, sha1)}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest_text(sha1)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) if revisit else len(http) + n}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <{record_id(keep_id, sha1)}>", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {keep_id}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + http


def _headers(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 1024):
            args = zip(rows["page_id"], rows["url"], rows["sha1"], rows["n"], rows["keep_id"], rows["revisit"], strict=True)
            yield batch_of({k: rows[k] for k in ("page_id", "sha1", "sha256")} | {"header": [header_bytes(*a, date) for a in args]}, _HEADER)

    return run


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str = DATE) -> None:
    """Write the archive of pages (page_id, url, html) under ``path``."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    # equal payloads meet in partial aggregates first, so a hot payload moves once for each task
    rows.mapInArrow(_pages(True), _PAYLOAD_DDL).groupBy("sha1", "sha256").agg(
        F.max("page_id").alias("keep_id"), F.count(F.lit(1)).alias("records"), F.first("n").alias("n"), F.first("payload").alias("payload")
    ).write.parquet(f"{path}/payloads")
    keepers = pages.sparkSession.read.schema("sha1 binary, sha256 binary, keep_id long, records long").parquet(f"{path}/payloads")
    meta = rows.mapInArrow(_pages(False), _META_DDL)
    typed = spread_join(meta, keepers.drop("records"), ["sha1", "sha256"], keepers.select("sha1", "sha256", F.col("records").alias("n"))).withColumn("revisit", (F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("keep_id")))
    typed.mapInArrow(_headers(date), "page_id long, sha1 binary, sha256 binary, header binary").write.parquet(f"{path}/headers")


def parse_header(header: bytes) -> tuple[dict[str, str], bytes]:
    """Fields of the WARC header (names in lower case) and the HTTP header that follows it."""
    head, _, http = header.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}, http


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[tuple[bytes, bytes]]]]:
    unpack = zstandard.ZstdDecompressor()
    for rows in slices(batches, 64):
        yield rows, [(h, unpack.decompress(p)) for h, p in zip(rows["header"], rows["payload"], strict=True)]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, records in _rebuilt(batches):
        out: dict[str, list] = {f.name: [] for f in _RECORD}
        for page_id, strong, (header, payload) in zip(rows["page_id"], rows["sha256"], records, strict=True):
            fields, http = parse_header(header)
            revisit = fields["warc-type"] == "revisit"
            digest = digest_text(hashlib.sha1(payload).digest())
            if hashlib.sha256(payload).digest() != strong or fields["warc-payload-digest"] != f"sha1:{digest}" or int(fields["content-length"]) != len(http) + (0 if revisit else len(payload)):
                raise ValueError(f"record of page {page_id} is damaged")
            refers = fields.get("x-refers-to-page")
            for k, v in (("page_id", page_id), ("payload_bytes", len(payload)), ("payload_digest", digest), ("record_type", fields["warc-type"]), ("refers_to", int(refers) if refers not in (None, "None") else None)):
                out[k].append(v)
        yield batch_of(out, _RECORD)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, records in _rebuilt(batches):
        kinds = [parse_header(h)[0]["warc-type"] for h, _ in records]
        yield batch_of({"page_id": rows["page_id"], "record": [h + (p if k != "revisit" else b"") + b"\r\n\r\n" for (h, p), k in zip(records, kinds, strict=True)]}, _BYTES)


def _joined(spark: SparkSession, path: str) -> DataFrame:
    headers = spark.read.schema("page_id long, sha1 binary, sha256 binary, header binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("sha1 binary, sha256 binary, records long, payload binary").parquet(f"{path}/payloads")
    joined = spread_join(headers, payloads.drop("records"), ["sha1", "sha256"], payloads.select("sha1", "sha256", F.col("records").alias("n")))
    return joined.select("page_id", "sha256", "header", "payload")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, checked."""
    return _joined(spark, path).mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def record_bytes(spark: SparkSession, path: str) -> DataFrame:
    """page_id and the whole WARC record; concatenated, the records are a WARC file."""
    return _joined(spark, path).mapInArrow(_records, "page_id long, record binary")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path)


_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v[{i + 1}] >> {s}) & 31), 1)" for i in range(8) for s in (15, 10, 5, 0))
OP9_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), k AS (
  SELECT h, max(page_id) AS keep_id, [CAST('0x' || substr(sha1(h), 1 + 5 * i, 5) AS INTEGER) for i in range(0, 8)] AS v FROM p GROUP BY h
)
SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN p.page_id = k.keep_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = k.keep_id THEN NULL ELSE k.keep_id END AS refers_to
FROM p JOIN k USING (h)
"""
