"""WARC archives of pages: segmented, chunked records written by Spark and read back whole.

A page becomes one record: a response with its whole payload, or a revisit that names the
response with an equal payload. A response's HTTP block uses chunked transfer framing and is cut into
segments: a first record and continuation records that carry its identifier and their number. Reading
groups continuations by origin, orders them by number, verifies the total length and decodes the framing.

Payloads are never shuffled: only digests are counted, and those that occur more than once, few as a rule, are
joined back to the pages. Records are framed in Arrow batches and written as bytes by Spark's text sink.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, new_path

CRLF = "\r\n"
CHUNK_BYTES, SEGMENT_BYTES, RECORDS_PER_FILE = 4096, 16384, 8192
#: Parts in which a payload's copies are joined where the repeated digests are too many for a broadcast.
SALTS = 16
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1 of ``payload``."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def repeated_payloads(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``sha`` (hex SHA-1) and ``last`` (largest page_id) of the payloads that occur more than once, a written table."""
    keys = pages.where(F.octet_length(_payload()) >= min_bytes).select(F.sha1(_payload()).alias("sha"), "page_id")
    return materialize(keys.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("sha", "last"), "warc-repeated")


def _payload() -> Column:
    """The html in UTF-8; null is empty."""
    return F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")


def decide_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``payload`` with ``sha`` and ``refers_to``: the largest page_id of an equal payload, null for responses.

    Null html is an empty payload. Payloads under ``min_bytes`` are never revisits. Rows
    that repeat a page_id with an equal payload are alike: all responses or all revisits. Null page_ids are
    responses if no other page has their payload.
    """
    shared = repeated_payloads(pages, min_bytes)
    payload = _payload()
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha"))
    if shared.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(shared), "sha", "left")
    else:
        # copies of one payload are dealt to several tasks
        salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["sha", "salt"], "left")
    revisit = F.col("last").isNotNull() & (F.octet_length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select("page_id", "url", "payload", "sha", F.when(revisit, F.col("last")).alias("refers_to"))


def _chunked(payload: bytes, chunk: int) -> bytes:
    out = []
    for at in range(0, len(payload), chunk):
        part = payload[at : at + chunk]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


_CONTROLS = re.compile(r"[\x00-\x1f\x7f]")


def page_records(row: int, page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, segment: int, chunk: int) -> Iterator[bytes]:
    """The WARC records of one page: one, or a first segment and its continuations."""
    digest = base64.b32encode(bytes.fromhex(sha)).decode()
    name = f"urn:page:{'' if page_id is None else page_id}:{digest}:{row}"
    target = "" if url is None else f"WARC-Target-URI: {_CONTROLS.sub('', url)}{CRLF}"
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
    kind, more = "response", ""
    if refers_to is not None:
        kind, block = "revisit", f"{http}Content-Length: {len(payload)}{CRLF}{CRLF}".encode()
        more = f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: <urn:page:{refers_to}:{digest}>{CRLF}"
    else:
        block = f"{http}Transfer-Encoding: chunked{CRLF}{CRLF}".encode() + _chunked(payload, chunk)
    n = -(-len(block) // segment)
    for i in range(n):
        part = block if n == 1 else block[i * segment : (i + 1) * segment]
        head = f"WARC/1.1{CRLF}WARC-Type: {kind if not i else 'continuation'}{CRLF}WARC-Record-ID: <{name}{f':{i}' if i else ''}>{CRLF}WARC-Date: {DATE}{CRLF}{target}"
        if not i:
            head += f"WARC-Payload-Digest: sha1:{digest}{CRLF}Content-Type: application/http; msgtype=response{CRLF}{more}"
        if n > 1:
            head += f"WARC-Segment-Number: {i + 1}{CRLF}"
            if i:
                head += f"WARC-Segment-Origin-ID: <{name}>{CRLF}"
            if i == n - 1:
                head += f"WARC-Segment-Total-Length: {len(block)}{CRLF}"
        yield f"{head}Content-Length: {len(part)}{CRLF}{CRLF}".encode() + part


def write_archives(decided: DataFrame, path: str, *, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write the rows of :func:`decide_records` as gzipped WARC files under ``path``.

    A file holds ``records_per_file`` records of one segment at most, which bounds its size. Urls lose their
    control characters; a null url or page_id is left out of the header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                cols = [c.to_pylist() for c in batch.slice(at, 256).columns]
                records = [r for row in zip(*cols, strict=True) for r in page_records(*row, segment_bytes, chunk_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["value"])

    # revisits' payloads count by their length alone
    numbered = decided.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "payload", "sha", "refers_to")
    records = numbered.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    # a record ends in two line ends, which the text sink writes after each row; its bytes are written as they are
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", records_per_file).text(path)


class _Plain:
    """The plain bytes of a WARC file, gzipped or not, a part at a time."""

    def __init__(self, data: bytes, size: int = 1 << 22) -> None:
        self._rest, self._size, self._held = data, size, b""
        self._member = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def more(self) -> bytes:
        """Further bytes; none at the end."""
        while self._rest:
            if self._member is None:
                out, self._rest = self._rest, b""
                return out
            out = self._member.decompress(self._rest, self._size)
            self._rest = self._member.unconsumed_tail
            if self._member.eof:
                self._rest = self._member.unused_data
                self._member = zlib.decompressobj(31)
            if out:
                return out
        return b""


def _field(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + name + rb":[ \t]*([^\r\n]*)", head)
    return found[1].strip().decode() if found else None


def split_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Head and block of the records of one WARC file, by the lengths that their heads state."""
    plain, held, at = _Plain(data), b"", 0

    def upto(n: int) -> bool:
        nonlocal held, at
        while len(held) - at < n:
            more = plain.more()
            if not more:
                return False
            held, at = held[at:] + more, 0
        return True

    while upto(1):
        while (end := held.find(b"\r\n\r\n", at)) < 0 and upto(len(held) - at + 1):
            pass
        if end < 0 or not held.startswith(b"WARC/", at):
            raise ValueError("bytes that are no WARC record")
        head = held[at:end]
        stated = _field(head, b"content-length")
        if stated is None:
            raise ValueError("a WARC record without its length")
        start, length = end + 4 - at, int(stated)
        if not upto(start + length + 4) or held[at + start + length : at + start + length + 4] != b"\r\n\r\n":
            raise ValueError(f"record {_field(head, b'warc-record-id')} is cut short")
        yield head, held[at + start : at + start + length]
        at += start + length + 4


def _is_segment(head: bytes) -> bool:
    return b"\nwarc-segment-number:" in head.lower()


def record_fields(head: bytes) -> dict:
    """id (the first segment's for continuations), kind, url, digest, refers_to, number and total of a record's head."""
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split(CRLF)[1:])}
    total = fields.get("warc-segment-total-length")
    return {
        "id": fields.get("warc-segment-origin-id") or fields["warc-record-id"],
        "kind": fields["warc-type"],
        "url": fields.get("warc-target-uri"),
        "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "refers_to": fields.get("warc-refers-to"),
        "number": int(fields.get("warc-segment-number", 0)),
        "total": None if total is None else int(total),
    }


_LENGTH, _CHUNKED = re.compile(rb"(?im)^content-length:\s*(\d+)"), re.compile(rb"(?im)^transfer-encoding:\s*chunked")


def decode_http(block: bytes) -> tuple[bytes, int | None]:
    """The payload of an HTTP block, chunked or not, and the length that its header states."""
    head, _, body = block.partition(b"\r\n\r\n")
    if not _CHUNKED.search(head):
        stated = _LENGTH.search(head)
        return body, int(stated[1]) if stated else None
    at, out = 0, []
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out), None
        chunk = body[end + 2 : end + 2 + size]
        if len(chunk) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(chunk)
        at = end + 4 + size


_SEGMENT = pa.schema([("id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("block", pa.binary())])
_SEGMENT_DDL = "id string, kind string, url string, digest string, refers_to string, number long, total long, block binary"
_WHOLE = pa.schema([("id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
_WHOLE_DDL = "id string, kind string, url string, digest string, refers_to string, payload_bytes long, payload binary"


def _decoded(record: dict, block: bytes) -> dict:
    """The record with its payload, whose digest must be the one that its head states; a revisit's is stated only."""
    payload, stated = decode_http(block)
    digest, size = record["digest"], stated
    if record["kind"] != "revisit":
        digest, size = payload_digest(payload), len(payload)
        if record["digest"] not in (None, digest):
            raise ValueError(f"the payload of {record['id']} has another digest than its head states")
    return {k: record[k] for k in ("id", "kind", "url", "refers_to")} | {"digest": digest, "payload_bytes": size, "payload": payload}


def _in_batches(records: Iterator[dict], schema: pa.Schema, rows: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for record in records:
        held.append(record)
        if len(held) == rows:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that aren't cut into segments, decoded."""
    yield from _in_batches((_decoded(record_fields(head), block) for batch in batches for content in batch.column("content") for head, block in split_records(content.as_py()) if not _is_segment(head)), _WHOLE)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _in_batches((record_fields(head) | {"block": block} for batch in batches for content in batch.column("content") for head, block in split_records(content.as_py()) if _is_segment(head)), _SEGMENT)


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            segments = row["segments"]
            block = b"".join(s["block"] for s in segments)
            if [s["number"] for s in segments] != [*range(1, len(segments) + 1)] or segments[-1]["total"] != len(block):
                raise ValueError(f"segments of {row['id']} are not whole")
            yield pa.RecordBatch.from_pylist([_decoded(segments[0] | {"id": row["id"]}, block)], _WHOLE)


def join_segments(segments: DataFrame) -> DataFrame:
    """Records put together from their segments: grouped by origin (a group is one record), in the order of their numbers."""
    parts = F.struct("number", "kind", "url", "digest", "refers_to", "total", "block")
    return segments.groupBy("id").agg(F.sort_array(F.collect_list(parts)).alias("segments")).mapInArrow(_reassemble, _WHOLE_DDL)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Whole records of the WARC files under ``path``: id, kind, url, digest, refers_to, payload_bytes, payload.

    The job fails if a record is cut short, a segment is missing, segments' bytes aren't the total that the last one states, or a
    payload's digest isn't the stated one. A revisit's payload is empty; its digest and length are those that its headers state.
    Files are unpacked and scanned twice, for whole records and for segments, as only the few segments are shuffled. No files, no rows.
    """
    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(path).select("content")
    return files.mapInArrow(_whole_records, _WHOLE_DDL).unionByName(join_segments(files.mapInArrow(_segments, _SEGMENT_DDL)))


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(decide_records(pages, min_bytes), path)
    return read_archives(spark, path)


def page_summary(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of records that were read back."""
    page = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '^<urn:page:(-?[0-9]*):', 1), '') as bigint)")
    return records.select(page("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), page("refers_to").alias("refers_to"))
