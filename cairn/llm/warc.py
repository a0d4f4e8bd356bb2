"""Operator 5: pages in WARC archives, and captures assembled from request, response and metadata records.

The writer makes one gzip archive per task: for each page a request, a response (or a revisit without payload) and a
metadata record, the request and the metadata tied to the capture by WARC-Concurrent-To. The reader streams archives
record by record; assembly joins the three kinds through those identifiers into one nested row per capture.

Defined results: null html is an empty payload; a page without id gets an identifier of its own, and null as page_id;
among equal payloads of 1000 bytes or more those with the largest page_id are responses (so rows that repeat it are
all responses, and null ids are only if all are null); empty tables give no archive.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import AtomicFile, file_system, new_folder, staged

LEAST_BYTES = 1000
_KINDS = {"request": 1, "capture": 2, "metadata": 3}
RECORD = "record_id string, kind string, concurrent_to string, refers_to string, uri string, digest string, body binary, body_bytes long, body_sha1 string"


def record_id(kind: str, page_id: int | None, row: int) -> str:
    """A URN whose last 64 bits are the page's id; pages without one are told apart by the row."""
    high = (_KINDS[kind] << 60) | (row & ((1 << 56) - 1) if page_id is None else 1 << 56)
    low = 0 if page_id is None else page_id & ((1 << 64) - 1)
    return f"<urn:uuid:{uuid.UUID(int=(high << 64) | low)}>"


def page_of(record: str | None) -> int | None:
    """The page id inside a URN made by ``record_id``."""
    if not record:
        return None
    value = uuid.UUID(record[10:-1]).int
    if not (value >> 120) & 1:
        return None
    low = value & ((1 << 64) - 1)
    return low - (1 << 64) if low >> 63 else low


def record(headers: list[tuple[str, str | None]], body: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _one_line(text: str | None) -> str | None:
    return None if text is None else " ".join(text.split())


def capture_records(page_id: int | None, row: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """Request, response or revisit, and metadata of one page, each compressed by itself as the format asks."""
    own = record_id("capture", page_id, row)
    sha1 = hashlib.sha1(payload, usedforsecurity=False).hexdigest()
    uri = _one_line(url)
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    parts = [
        record(
            [("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", page_id, row)), ("WARC-Concurrent-To", own), ("WARC-Target-URI", uri), ("Content-Type", "application/http;msgtype=request")],
            f"GET {uri or '/'} HTTP/1.1\r\n\r\n".encode(),
        ),
        record(
            [
                ("WARC-Type", "revisit" if revisit else "response"),
                ("WARC-Record-ID", own),
                ("WARC-Target-URI", uri),
                ("WARC-Payload-Digest", f"sha1:{sha1}"),
                ("WARC-Refers-To", record_id("capture", refers_to, 0) if revisit else None),
                ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
                ("Content-Type", "application/http;msgtype=response"),
            ],
            http + (b"" if revisit else payload),
        ),
        record(
            [("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", page_id, row)), ("WARC-Concurrent-To", own), ("WARC-Target-URI", uri), ("Content-Type", "application/warc-fields")],
            f"payload-bytes: {len(payload)}\r\n".encode(),
        ),
    ]
    return b"".join(_gzip(p) for p in parts)


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def revisits(pages: DataFrame) -> DataFrame:
    """Digests of payloads that stand in several pages and are large enough, with the largest page_id."""
    sized = pages.select("page_id", "payload_sha1", "payload_bytes").filter(F.col("payload_bytes") >= LEAST_BYTES)
    many = sized.groupBy("payload_sha1").agg(F.max("page_id").alias("first_page"), F.count("*").alias("n"))
    return many.filter("n > 1").select("payload_sha1", "first_page")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every page; returns the paths of the archives, one for each task that had rows."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.withColumns({"payload_sha1": F.sha1("payload"), "payload_bytes": F.length("payload")})
    decided = keyed.join(revisits(keyed), "payload_sha1", "left").select(
        F.coalesce("page_id", F.lit(0)).alias("page_id"),
        F.col("page_id").isNull().alias("no_id"),
        "url",
        "payload",
        F.coalesce("first_page", F.lit(0)).alias("refers_to"),
        (F.col("first_page").isNull() | F.col("page_id").eqNullSafe(F.col("first_page"))).alias("fresh"),
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, n, first = None, 0, TaskContext.get().partitionId() << 32
        for pdf in batches:
            if len(pdf) and out is None:
                out = AtomicFile(folder, "pages", ".warc.gz")
            for page, none, url, body, to, fresh in zip(
                *(pdf[c].tolist() for c in ("page_id", "no_id", "url", "payload", "refers_to", "fresh")), strict=True
            ):
                out.write(capture_records(None if none else page, first + n, url, body, None if fresh else to))
                n += 1
        if out is not None:
            yield pd.DataFrame({"path": [out.commit()], "n_pages": [n]})

    return staged(decided.mapInPandas(write, "path string, n_pages long"), "archives")


def read_records(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of each record of a gzip archive, one record in memory at a time."""
    z, raw, buffer = zlib.decompressobj(31), b"", bytearray()

    def more() -> bool:
        nonlocal z, raw
        while True:
            if not raw:
                raw = stream.read(1 << 18)
                if not raw:
                    return False
            if z.eof:
                z = zlib.decompressobj(31)
            data = z.decompress(raw)
            raw = z.unused_data if z.eof else b""
            if data:
                buffer.extend(data)
                return True

    def until(n: int) -> None:
        while len(buffer) < n:
            if not more():
                raise ValueError("the archive ends inside a record")

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError("the archive ends inside a header")
                return
        lines = bytes(buffer[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        until(end + 8 + size)
        body = bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 8 + size]
        yield headers, body


def read_archives(paths: DataFrame, *, bodies: bool = True) -> DataFrame:
    """A row per record; body_bytes and body_sha1 are of the HTTP payload. ``bodies=False`` leaves the bytes behind."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for pdf in batches:
            for uri in pdf["path"]:
                fs, path = file_system(uri)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for h, body in read_records(stream):
                        if h["WARC-Type"] in ("response", "revisit"):
                            body = body.partition(b"\r\n\r\n")[2]
                        keep = bodies or h["WARC-Type"] == "metadata"
                        sha1 = hashlib.sha1(body, usedforsecurity=False).hexdigest()
                        rows.append((h["WARC-Record-ID"], h["WARC-Type"], h.get("WARC-Concurrent-To"), h.get("WARC-Refers-To"), h.get("WARC-Target-URI"), h.get("WARC-Payload-Digest"), body if keep else None, len(body), sha1))
                        held += len(body) if keep else 0
                        if len(rows) >= 5000 or held > 16_000_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    n = max(1, min(paths.count(), 100_000))
    return paths.select("path").repartition(n, "path").mapInPandas(read, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, its requests and its metadata."""
    nested = F.struct("record_id", "uri", "body", "body_bytes")
    by_capture = (
        records.filter(F.col("concurrent_to").isNotNull())
        .groupBy(F.col("concurrent_to").alias("capture_id"))
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("kind") == "request", nested))).alias("requests"),
            F.sort_array(F.collect_list(F.when(F.col("kind") == "metadata", nested))).alias("metadata"),
        )
    )
    main = records.filter(F.col("kind").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), F.struct("kind", "uri", "refers_to", "digest", "body", "body_bytes", "body_sha1").alias("capture")
    )
    return main.join(by_capture.hint("merge"), "capture_id", "left")


@F.pandas_udf(T.LongType())
def _page(ids: pd.Series) -> pd.Series:
    return pd.Series(pd.array([page_of(x) for x in ids], dtype="Int64"))


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 5 over the whole of ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    paths = write_archives(pages, new_folder(spark, "warc"))
    rows = captures(read_archives(paths, bodies=False))
    counted = F.regexp_extract(F.element_at("metadata", 1)["body"].cast("string"), r"payload-bytes: (\d+)", 1).cast("long")
    return rows.select(
        _page("capture_id").alias("page_id"),
        counted.alias("payload_bytes"),
        F.when(F.col("capture.kind") == "response", F.col("capture.body_sha1")).otherwise(F.regexp_replace("capture.digest", "^sha1:", "")).alias("payload_digest"),
        F.col("capture.kind").alias("record_type"),
        _page("capture.refers_to").alias("refers_to"),
    )


#: Payload rules of contract 5 straight from ``pages``.
WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS first_page FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_page IS NULL OR first_page = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_page <> page_id THEN first_page END AS refers_to
FROM d LEFT JOIN m USING (payload_digest)
"""
