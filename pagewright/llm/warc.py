"""WARC derivatives: for each response a linked metadata record and a plain-text conversion."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import slices
from pagewright.llm.html import visible_text

#: Name space of record ids: an id is derived from what the record holds, so reruns give equal ids.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-derivatives")
WARC_DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, block_digest string, content_length long, http_headers string, block binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(map(str, parts)))}>"


def _response(page_id: int | None, url: str | None, source: str | None, warc_date: str) -> tuple:
    body = (source or "").encode("utf-8", "surrogatepass")
    headers = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    block, payload = headers.encode() + body, digest(body)
    return (page_id, "response", record_id("response", page_id, url, payload), None, url or "", warc_date, "application/http; msgtype=response", payload, digest(block), len(block), headers, block)


def _derived(response: tuple) -> Iterator[tuple]:
    """The metadata and the conversion record of a response."""
    page_id, _, source, _, uri, date, _, payload, whole, _, _, block = response
    block, uri, date = block or b"", uri or "", date or ""
    head, _, body = block.partition(b"\r\n\r\n")
    head, payload = head.decode("latin-1"), payload or digest(body)
    text = visible_text(body.decode("utf-8", "replace")).encode("utf-8", "replace")
    conversion = record_id("conversion", source)
    fields = [f"source-record-id: {source}", f"source-block-digest: {whole or digest(block)}", f"source-payload-digest: {payload}", f"conversion-record-id: {conversion}"]
    fields += [f"http-header: {h}" for h in head.split("\r\n") if h]
    meta, own = ("\r\n".join(fields) + "\r\n").encode(), digest(text)
    yield (page_id, "metadata", record_id("metadata", source), source, uri, date, "application/warc-fields", payload, digest(meta), len(meta), head, meta)
    yield (page_id, "conversion", conversion, source, uri, date, "text/plain; charset=utf-8", own, own, len(text), head, text)


_TYPES = (pa.int64(), *[pa.string()] * 8, pa.int64(), pa.string(), pa.binary())
_NAMES = [c.split()[0] for c in RECORD.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_TYPES)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def _page_columns(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))


def response_records(pages: DataFrame, warc_date: str = WARC_DATE) -> DataFrame:
    """WARC response records of pages (page_id, url, html): HTTP headers and body as the block.

    Null html is an empty body, a null url an empty target. Equal rows give equal records; other
    columns are left out; an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            yield _batch([_response(*row, warc_date) for row in zip(*(c.to_pylist() for c in b.columns))])

    return _page_columns(pages).mapInArrow(run, RECORD)


def derivatives(responses: DataFrame) -> DataFrame:
    """metadata and conversion records of response records; other records have none.

    Both refer to the response by its id and keep its target, date and payload digest; metadata
    lists the source's HTTP headers and digests, the conversion holds the visible text. Null blocks
    count as empty; bytes of a body that are not UTF-8 become U+FFFD in the conversion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            yield _batch([d for row in zip(*(c.to_pylist() for c in b.columns)) for d in _derived(row)])

    return responses.where("warc_type = 'response'").select(*_NAMES).mapInArrow(run, RECORD)


def page_derivatives(pages: DataFrame, warc_date: str = WARC_DATE) -> DataFrame:
    """What derivatives(response_records(pages)) gives, in one pass: bodies go through one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            yield _batch([d for row in zip(*(c.to_pylist() for c in b.columns)) for d in _derived(_response(*row, warc_date))])

    return _page_columns(pages).mapInArrow(run, RECORD)


def serialise(record: dict) -> bytes:
    """One record in WARC 1.1 form, as a gzip member of its own."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {record['warc_type']}",
        f"WARC-Record-ID: {record['record_id']}",
        f"WARC-Date: {record['warc_date']}",
        f"WARC-Target-URI: {record['target_uri']}",
        f"WARC-Block-Digest: {record['block_digest']}",
        f"WARC-Payload-Digest: {record['payload_digest']}",
        *([f"WARC-Refers-To: {record['refers_to']}", f"WARC-Refers-To-Target-URI: {record['target_uri']}", f"WARC-Refers-To-Date: {record['warc_date']}"] if record["refers_to"] else []),
        f"Content-Type: {record['content_type']}",
        f"Content-Length: {record['content_length']}",
    ]
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + (record["block"] or b"") + b"\r\n\r\n", 6, mtime=0)


def warc_members(records: DataFrame) -> DataFrame:
    """page_id, warc_type, record_id and member: each record's gzip member. Members joined in any
    order are a WARC file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            rows = b.to_pylist()
            yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in (("page_id", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()))] + [pa.array([serialise(r) for r in rows], pa.binary())], names=["page_id", "warc_type", "record_id", "member"])

    return records.select(*_NAMES).mapInArrow(run, "page_id long, warc_type string, record_id string, member binary")


def report(pages: DataFrame) -> DataFrame:
    """All derivative records of pages, with their text in place of the block."""
    d = page_derivatives(pages)
    return d.select(*(c for c in _NAMES if c != "block"), F.decode("block", "utf-8").alias("text"))
