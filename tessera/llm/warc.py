"""Reassembly of segmented WARC records (WARC 1.1, section 7), and decoding of chunked HTTP bodies.

`parse_warc` reads the records of a WARC file's bytes (`read_warc` those of files, gzipped or not) as (record_id,
origin_id, segment_number, total_length, url, payload), from the headers WARC-Record-ID, WARC-Segment-Origin-ID,
WARC-Segment-Number, WARC-Segment-Total-Length and WARC-Target-URI. The first segment has number 1 and no origin_id; continuation records carry the record_id of the first as their origin_id, and the last one
has the total length. A record without a segment number isn't segmented.

Segments are grouped by origin, ordered by segment number, joined, and checked against the total length. A payload
is an HTTP message: its header ends at the first empty line; where that says chunked transfer coding, the
body's framing is decoded, with chunk extensions and trailers; otherwise the rest is the body.

Scale: records that aren't segmented are decoded where they are read; only segments are shuffled, once, by
origin, and stream through sorted partitions one origin at a time.

Defined results, in the column `status`: ok; missing_segment (a number is absent, or no last
segment says the total); length_mismatch; bad_framing (chunks that don't add up; the body is null); orphan (no first
segment); no_header (no empty line; the body is the whole payload). The body is null unless the status is
ok or no_header. A record without a payload (null) has the status no_payload and a null body. Segments repeated with the same number and payload count once; with another payload the result is
length_mismatch or, if the lengths agree, the first by payload counts. Records with a null id and no
origin are each on their own; unsegmented records that share an id have a row each. Null payloads of segments are empty.
Other columns are ignored. Bytes that are no WARC record are skipped up to the next "WARC/" at the start of a line.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import map_arrow, text_slices, whole_groups

RECORDS = "record_id string, origin_id string, segment_number int, total_length long, url string, payload binary"
RESULT = "record_id string, url string, segments int, n_bytes long, status string, body binary"
_CHUNK = re.compile(rb"[ \t]*([0-9A-Fa-f]{1,15})[ \t]*(?:;[^\r\n]*)?\r?\n")
_CHUNKED = re.compile(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked[ \t]*\r?$")


def decode_chunked(body: bytes) -> bytes | None:
    """The content of a chunked body, or None where its framing is wrong."""
    out, at = [], 0
    while True:
        m = _CHUNK.match(body, at)
        if not m:
            return None
        size, at = int(m[1], 16), m.end()
        if not size:
            # trailers up to an empty line; nothing may follow
            return b"".join(out) if re.fullmatch(rb"(?:[^\r\n]+\r?\n)*\r?\n?", body[at:]) else None
        out.append(body[at : at + size])
        at += size
        if body[at : at + 2] == b"\r\n":
            at += 2
        elif body[at : at + 1] == b"\n":
            at += 1
        else:
            return None


def decode_message(payload: bytes) -> tuple[str, bytes | None]:
    """(status, body) of an HTTP message."""
    end = re.search(rb"\r?\n\r?\n", payload)
    if not end:
        return "no_header", payload
    header, body = payload[: end.start()], payload[end.end() :]
    if not _CHUNKED.search(header):
        return "ok", body
    content = decode_chunked(body)
    return ("bad_framing", None) if content is None else ("ok", content)


def join_segments(rows: list[tuple[int | None, int | None, bytes]]) -> tuple[str, int, bytes]:
    """(status, segments, payload) of the segments (number, total length, payload) of one origin."""
    by: dict[int, bytes] = {}
    total = None
    for number, length, payload in sorted(((n or 0, t, p or b"") for n, t, p in rows), key=lambda x: (x[0], x[2])):
        by.setdefault(number, payload)
        total = length if length is not None else total
    payload = b"".join(by[n] for n in sorted(by))
    if 1 not in by:
        return "orphan", len(by), payload
    if total is None or sorted(by) != list(range(1, len(by) + 1)):
        return "missing_segment", len(by), payload
    return ("ok" if len(payload) == total else "length_mismatch"), len(by), payload


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["record_id", "url", "segments", "n_bytes", "status", "body"])


def _result(record: str | None, url: str | None, segments: int, status: str, payload: bytes | None) -> tuple:
    body = None
    if payload is None:
        status = "no_payload"
    if status == "ok":
        status, body = decode_message(payload)
    return record, url, segments, None if body is None else len(body), status, body


def reassemble(records: DataFrame) -> DataFrame:
    """(record_id, url, segments, n_bytes, status, body): one row for each record or origin."""
    names = ("record_id", "origin_id", "segment_number", "total_length", "url", "payload")
    kinds = dict(x.split(" ") for x in RECORDS.split(", "))
    rows = records.select(*(F.col(n).cast(kinds[n]).alias(n) for n in names))
    # the first segment of an origin has no origin_id; what has neither number nor origin stands alone
    origin = F.coalesce("origin_id", "record_id")
    alone = F.col("origin_id").isNull() & (F.col("segment_number").isNull() | F.col("record_id").isNull())

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "payload", 16_000_000):
                yield _batch([_result(r, u, 1, "ok", p) for r, u, p in zip(*(part.column(c).to_pylist() for c in ("record_id", "url", "payload")))])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (x for b in batches for x in text_slices(b, "payload", 16_000_000))
        for group in whole_groups(small, "origin"):
            out: list[tuple] = []
            held: list[tuple] = []
            last, url = None, None
            for row in group.to_pylist() + [{"origin": None}]:
                if row["origin"] != last and held:
                    status, n, payload = join_segments(held)
                    out.append(_result(last, url, n, status, payload))
                    held, url = [], None
                if row["origin"] is not None:
                    held.append((row["segment_number"], row["total_length"], row["payload"]))
                    url = url if url is not None else row["url"]
                last = row["origin"]
            yield _batch(out)

    segments = rows.where(~alone).select(origin.alias("origin"), "segment_number", "total_length", "url", "payload")
    sorted_rows = segments.repartition("origin").sortWithinPartitions("origin", "segment_number")
    return map_arrow(rows.where(alone).select("record_id", "url", "payload"), single, RESULT).unionByName(map_arrow(sorted_rows, grouped, RESULT))


_HEADER = re.compile(rb"(?m)^WARC/\d+\.\d+\r?\n")
_RECORD = ("record_id", "origin_id", "segment_number", "total_length", "url", "payload")


def parse_warc(data: bytes) -> Iterator[tuple[str | None, str | None, int | None, int | None, str | None, bytes | None]]:
    """The records of a WARC file's bytes, in the order of RECORDS; an empty block with WARC-Truncated is a null payload."""
    at = 0
    while m := _HEADER.search(data, at):
        end = re.compile(rb"\r?\n\r?\n").search(data, m.end() - 1)
        if not end:
            return
        fields: dict[str, str] = {}
        for line in re.split(r"\r?\n(?![ \t])", data[m.end() : end.start()].decode("utf-8", "replace")):
            name, colon, value = line.partition(":")
            if colon:
                fields.setdefault(name.strip().lower(), re.sub(r"\r?\n[ \t]+", " ", value).strip())
        size = fields.get("content-length", "")
        if not size.isdigit():
            at = m.end()
            continue
        payload: bytes | None = data[end.end() : end.end() + int(size)]
        at = end.end() + int(size)
        if not payload and "warc-truncated" in fields:
            payload = None
        number, total = (int(x) if (x := fields.get(k, "")).isdigit() else None for k in ("warc-segment-number", "warc-segment-total-length"))
        yield fields.get("warc-record-id"), fields.get("warc-segment-origin-id"), number, total, fields.get("warc-target-uri"), payload


def write_warc(records: list[tuple]) -> bytes:
    """WARC bytes of records in the order of RECORDS."""
    out = []
    for record, origin, number, total, url, payload in records:
        fields = [("WARC-Type", "continuation" if origin else "response"), ("WARC-Record-ID", record), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total), ("WARC-Target-URI", url), ("WARC-Truncated", "unspecified" if payload is None else None), ("Content-Length", len(payload or b""))]
        out.append("".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields if v is not None), "\r\n"]).encode() + (payload or b"") + b"\r\n\r\n")
    return b"".join(out)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, types)], names=list(_RECORD))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, plain or gzipped (also by record); a file is read by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                rows, held = [], 0
                for r in parse_warc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    rows.append(r)
                    held += len(r[5] or b"")
                    if held > 16_000_000:
                        yield _record_batch(rows)
                        rows, held = [], 0
                yield _record_batch(rows)

    return map_arrow(spark.read.format("binaryFile").load(path).select("content"), run, RECORDS)


def to_records(pages: DataFrame, segment_bytes: int = 8192, chunk_bytes: int = 2048) -> DataFrame:
    """Records of pages as a crawler would have written them, read from WARC bytes; the inverse of reassemble.

    Pages are chunked HTTP responses, cut into segments where longer than segment_bytes. Each row is a record of its own,
    <urn:page:PAGE_ID:ROW>, also where rows share a page_id or have none; a null html is a record without a payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "html"):
                rows = []
                for i, url, html, row in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "_row"))):
                    first = f"<urn:page:{'null' if i is None else i}:{row}>"
                    if html is None:
                        rows.append((first, None, None, None, url, None))
                        continue
                    body = html.encode("utf-8", "surrogatepass")
                    chunks = [b"%x\r\n%s\r\n" % (len(c), c) for c in (body[a : a + chunk_bytes] for a in range(0, len(body), chunk_bytes))]
                    payload = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + b"".join(chunks) + b"0\r\n\r\n"
                    if len(payload) <= segment_bytes:
                        rows.append((first, None, None, None, url, payload))
                        continue
                    cut_at = range(0, len(payload), segment_bytes)
                    for k, a in enumerate(cut_at, 1):
                        rows.append((first if k == 1 else f"{first[:-1]}:{k}>", None if k == 1 else first, k, len(payload) if k == len(cut_at) else None, url if k == 1 else None, payload[a : a + segment_bytes]))
                yield _record_batch(list(parse_warc(write_warc(rows))))

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.monotonically_increasing_id().alias("_row"))
    return map_arrow(rows, run, RECORDS)
