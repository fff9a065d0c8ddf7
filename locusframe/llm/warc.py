"""WARC archives: write records, read them back, reassemble segments.

A record whose block is longer than ``segment_bytes`` is written as a first
segment and *continuation* records (WARC 1.1, "record segmentation"). Reading
groups continuations by the record they continue, orders them by segment
number, verifies the total length and decodes chunked transfer framing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, join_counted, stored

CRLF = b"\r\n"
#: Longest block of a record in an archive, payload bytes of a chunk of transfer framing, and bytes of an archive before compression.
SEGMENT, CHUNK, ARCHIVE = 4 << 10, 1 << 10, 128 << 20
RECORD = "record_id string, record_type string, target_uri string, page_id bigint, origin_id string, segment int, total_length bigint, block binary"
PAYLOAD = "record_id string, record_type string, target_uri string, page_id bigint, payload binary, intact boolean"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1, as in WARC-Payload-Digest."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(x), x) for i in range(0, len(payload), size) if (x := payload[i : i + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; null if its framing is broken or cut off."""
    out, at = [], 0
    while (end := body.find(CRLF, at)) >= 0:
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if n == 0:
            return b"".join(out)
        if n < 0 or body[at + n : at + n + 2] != CRLF:
            return None
        out.append(body[at : at + n])
        at += n + 2
    return None


def http_payload(block: bytes) -> bytes | None:
    """The body of an HTTP response block, without transfer framing."""
    head, gap, body = block.partition(CRLF + CRLF)
    if not head.startswith(b"HTTP/") or not gap:
        return block
    for line in head.split(CRLF)[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"transfer-encoding" and b"chunked" in value.lower():
            return dechunked(body)
    return body


def _uri(url: str | None, page_id: int | None) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url)


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block + CRLF  # the writer's line end is the second CRLF


def page_records(page_id: int | None, url: str | None, html: str | None, mark: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    payload = (html or "").encode("utf-8")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    name = f"<urn:page:{page_id}:{mark}>"
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Target-URI", _uri(url, page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    if len(block) <= segment_bytes:
        yield _record(fields, block)
        return
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    yield _record([*fields, ("WARC-Segment-Number", 1)], parts[0])
    for i, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{i}>"), ("WARC-Target-URI", _uri(url, page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", i)]
        if i == len(parts):
            more.append(("WARC-Segment-Total-Length", len(block)))
        yield _record(more, part)


def write_warc(pages: DataFrame, path: str, segment_bytes: int = SEGMENT, chunk_bytes: int = CHUNK) -> None:
    """Write one response record per row of ``pages(page_id, url, html)``.

    Null html is an empty payload; a null url becomes ``urn:page:<id>``. Rows
    with equal or null ids stay apart by a mark of split and position. Extra
    columns are ignored. Long pages are segmented, so a bound on the records
    of an archive bounds its bytes too. Spark's file committer writes the archives, so a lost
    executor leaves no half-written record behind.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, size = [], 0
            for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for x in page_records(page_id, url, html, f"{part}-{n}", segment_bytes, chunk_bytes):
                    out.append(x)
                    size += len(x)
                n += 1
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(records, "value binary")
    # A cast of binary to string keeps the bytes as they are.
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, ARCHIVE // (segment_bytes + 1024))).text(path)


def parse_archive(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        length = int(head["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"record {head.get('warc-record-id')} is cut off")
        yield head, block


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives (plain or gzip) below a path, one row each, segments still apart."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("origin_id", pa.string()), ("segment", pa.int32()), ("total_length", pa.int64()), ("block", pa.binary())])
        number = lambda x: int(x) if x is not None else None
        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(content.as_buffer())
                packed = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                rows, size = [], 0
                for head, block in parse_archive(gzip.GzipFile(fileobj=raw) if packed else raw):
                    get = lambda k: head.get(k)  # noqa: B023, E731
                    rows.append((get("warc-record-id"), get("warc-type"), get("warc-target-uri"), number(get("x-page-id")), get("warc-segment-origin-id"), number(get("warc-segment-number")), number(get("warc-segment-total-length")), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where("length > 0").select("content").mapInArrow(parse, RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole blocks: segments joined by origin in order of segment number.

    Only segmented records are shuffled, by the id of the record that they
    continue, so a group is one record. Repeated segments count once.
    ``intact`` is false if a segment is missing or the length differs from the
    total that the last segment states; the block is then null.
    """
    whole = records.where("segment is null").select("record_id", "record_type", "target_uri", "page_id", "block", F.lit(True).alias("intact"))
    parts = (
        records.where("segment is not null")
        .groupBy(F.coalesce("origin_id", "record_id").alias("record_id"))
        .agg(
            F.max(F.when(F.col("segment") == 1, F.struct("record_type", "target_uri", "page_id"))).alias("head"),
            F.max("total_length").alias("total_length"),
            F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("parts"),
        )
        # A cast between binary and string keeps the bytes as they are; joined strings grow in linear time.
        .withColumn("block", F.array_join(F.transform("parts.block", lambda x: x.cast("string")), "").cast("binary"))
        .withColumn("intact", F.coalesce(F.col("head").isNotNull() & (F.octet_length("block") == F.col("total_length")) & (F.element_at("parts", -1)["segment"] == F.size("parts")), F.lit(False)))
        .select("record_id", "head.record_type", "head.target_uri", "head.page_id", F.when(F.col("intact"), F.col("block")).alias("block"), "intact")
    )
    return whole.unionByName(parts)


def payloads(records: DataFrame) -> DataFrame:
    """Payload of every reassembled record; null where segments or framing are broken."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                body = [None if x is None else http_payload(x) for x in part.column("block").to_pylist()]
                digest = [None if x is None else payload_digest(x) for x in body]
                size = [None if x is None else len(x) for x in body]
                yield pa.RecordBatch.from_arrays([part.column("record_id"), part.column("target_uri"), part.column("page_id"), part.column("intact"), pa.array(body, pa.binary()), pa.array(size, pa.int64()), pa.array(digest, pa.string())], ["record_id", "target_uri", "page_id", "intact", "payload", "payload_bytes", "payload_digest"])

    schema = "record_id string, target_uri string, page_id bigint, intact boolean, payload binary, payload_bytes bigint, payload_digest string"
    return reassemble(records).mapInArrow(decode, schema)


def revisits(found: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Tell first captures from revisits among records with equal payloads.

    Of equal payloads of at least ``least_bytes`` the record with the largest
    page_id (then record_id) is the response, all others revisit it; smaller
    payloads are all responses, and so are records without a whole payload.
    ``found`` should be stored. Digests are pre-aggregated before they meet,
    and a payload that is very common is joined where its records are.
    """
    keys = ["payload_digest", "payload_bytes"]
    large = F.coalesce(F.col("payload_bytes") >= least_bytes, F.lit(False))
    order = F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("order"), "record_id", "page_id")
    first = stored(found.where(large).groupBy(*keys).agg(F.max(order).alias("first"), F.count("*").alias("n")), "first-captures")
    again = F.col("first")["record_id"] != F.col("record_id")
    told = join_counted(found.where(large), first, keys).withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first")["page_id"])).drop("first", "n")
    return told.unionByName(found.where(~large).withColumn("record_type", F.lit("response")).withColumn("refers_to", F.lit(None).cast("bigint")))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder, read them back and resolve revisits.

    page_id, payload_bytes, payload_digest, record_type and refers_to of every
    row. Null html is an empty payload, and all empty payloads are equal. Rows
    with equal ids and payloads are one response and its revisits; null ids
    come last. Pages of any length are segmented and joined again; extra
    columns, whatever their names, are ignored; an empty table gives an empty
    one. Archives are read and digested once, and the digests stored.
    """
    path = fresh_path(spark, "warc")
    write_warc(pages, path)
    found = stored(payloads(read_records(spark, path)).select("record_id", "page_id", "payload_bytes", "payload_digest"), "digests")
    return revisits(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
