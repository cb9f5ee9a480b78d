"""WARC files: one gzip member a record, revisit records for repeated payloads, and a splittable reader.

Writers are map tasks: each partition becomes one file. Readers get byte ranges. A task looks for gzip magic from the start
of its range, takes a place for a record only if what is decoded there begins with a WARC header that is complete and
agrees with the member's length, and owns the records that start inside its range, reading beyond its end where needed.
After a record the next one is known to follow; only the first of a range is searched for.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folimetry.llm.pieces import trimmed
from folimetry.llm.scratch import filesystem, numbered, shared_folder, write_atomically, written

MAGIC = b"\x1f\x8b\x08"
LEAST_PAYLOAD = 100
SPLIT_BYTES = 4 << 20
READ_BYTES = 1 << 18
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digests of repeated payloads are broadcast up to this many (some 20 MB); beyond, the join shuffles.
BROADCAST_REPEATS = 200_000


def record_id(page: int | None, row: int) -> str:
    name = hashlib.md5(f"{page}/{row}".encode()).hexdigest()
    return f"<urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:]}>"


def quoted_uri(url: str) -> str:
    return quote(url, safe="".join(map(chr, range(33, 127))))


def record(page: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, row: int, refers_to: int | None, refers_row: int | None, refers_url: str | None) -> bytes:
    """One gzip member. A revisit holds the HTTP header alone, whose Content-Length is that of the full payload, and names
    the response with its record, page and address."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page, row)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page is not None:
        lines.append(f"X-Page-Id: {page}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {quoted_uri(url)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, refers_row)}", f"WARC-Refers-To-Date: {DATE}"]
        lines += [f"WARC-Refers-To-Target-URI: {quoted_uri(refers_url)}"] if refers_url is not None else []
        lines += [f"X-Refers-To-Page-Id: {refers_to}"] if refers_to is not None else []
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    made = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return made.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + made.flush()


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def parse_record(offset: int, data: bytes) -> Record | None:
    """The record in decoded bytes, or None if they aren't exactly one."""
    if not data.startswith(b"WARC/1."):
        return None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    headers = _headers(data[:end])
    length = headers.get("content-length", "")
    if not length.isdigit() or len(data) != end + 4 + int(length) + 4 or not data.endswith(b"\r\n\r\n"):
        return None
    block = data[end + 4 : -4]
    head = block.find(b"\r\n\r\n")
    return Record(offset, headers, _headers(block[:head]), block[head + 4 :]) if head >= 0 else Record(offset, headers, {}, block)


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _member(source, offset: int) -> tuple[bytes, int] | None:
    """Decoded bytes of the gzip member at an offset and where it ends; None if it isn't one of a WARC record."""
    source.seek(offset)
    tool, out, used = zlib.decompressobj(31), [], 0
    first = True
    while not tool.eof:
        data = source.read(READ_BYTES)
        if not data:
            return None
        used += len(data)
        try:
            out.append(tool.decompress(data))
        except zlib.error:
            return None
        if first and out[-1]:
            if not out[-1].startswith(b"WARC/1."[: len(out[-1])]):
                return None
            first = False
    return b"".join(out), offset + used - len(tool.unused_data)


def records_between(source, start: int, end: int) -> Iterator[Record]:
    """Records that start in [start, end)."""
    at = start
    while at < end:
        found = _member(source, at) if _magic_at(source, at) else None
        record_ = parse_record(at, found[0]) if found else None
        if record_ is None:
            at = _next_magic(source, at + 1, end)
            continue
        yield record_
        at = found[1]


def _magic_at(source, at: int) -> bool:
    source.seek(at)
    return source.read(len(MAGIC)) == MAGIC


def _next_magic(source, at: int, end: int) -> int:
    """First place from `at` on that has the magic and is before `end`; `end` if there is none."""
    while at < end:
        source.seek(at)
        data = source.read(min(READ_BYTES, end - at) + len(MAGIC) - 1)
        found = data.find(MAGIC)
        if 0 <= found and at + found < end:
            return at + found
        at += READ_BYTES
    return end


def repeats(pages: DataFrame) -> DataFrame:
    """(digest, keeper) of payloads of LEAST_PAYLOAD bytes or more that several rows of (row_id, page_id, url, digest, bytes) have."""
    keeper = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "row_id", "url")
    return (
        pages.filter(F.col("bytes") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min(keeper).alias("keeper"), F.count("*").alias("n"))
        .filter("n > 1").select("digest", "keeper")
    )


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of pages(page_id, url, html); returns (path, size), a row a file.

    Null html is an empty payload. Of equal payloads of at least LEAST_PAYLOAD bytes the row of smallest page_id is the
    response, of rows that repeat that page_id too one; null page_ids come after all others.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = numbered(pages.select("page_id", "url", "html"), "row_id").select("page_id", "url", payload.alias("payload"), "row_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    found = written(repeats(rows.drop("payload")))
    known = F.broadcast(found) if found.count() <= BROADCAST_REPEATS else found
    marked = rows.join(known, "digest", "left").withColumn("revisit", F.coalesce(F.col("bytes") >= LEAST_PAYLOAD, F.lit(False)) & F.coalesce(F.col("keeper.row_id") != F.col("row_id"), F.lit(False)))
    of_keeper = (F.col(f"keeper.{c}").alias(n) for c, n in (("page_id", "refers_to"), ("row_id", "refers_row"), ("url", "refers_url")))
    dealt = marked.select("page_id", "url", "payload", "digest", "row_id", "revisit", *of_keeper)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/pages-{TaskContext.get().partitionId():06d}.warc.gz"

        def members() -> Iterator[bytes]:
            names = ("page_id", "url", "payload", "digest", "revisit", "row_id", "refers_to", "refers_row", "refers_url")
            for b in batches:
                for k in range(0, b.num_rows, 256):
                    part = b.slice(k, 256)
                    for row in zip(*(part.column(n).to_pylist() for n in names), strict=True):
                        yield record(*row)

        size = write_atomically(path, members())
        yield pa.RecordBatch.from_pydict({"path": [path], "size": [size]}, pa.schema([("path", pa.string()), ("size", pa.int64())]))

    return written(dealt.mapInArrow(trimmed(write), "path string, size long"))


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Records of files(path, size) by byte ranges; payload is null for revisits, and for all if not asked for.

    A response whose payload doesn't have the digest in its header is an error.
    """
    spark = files.sparkSession
    ranges = files.filter("size > 0").select("path", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(split_bytes))).alias("start"), "size")
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, "size").alias("end"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                where, inner = filesystem(path)
                with where.open_input_file(inner) as source:
                    rows, held = [], 0
                    for r in records_between(source, start, end):
                        rows.append(_row(r, payloads))
                        held += len(r.payload) if payloads else 64
                        if held > 8 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                    yield _rows(rows)

    return ranges.repartition(parts).mapInArrow(trimmed(read), RECORDS)


def _row(r: Record, payloads: bool) -> tuple:
    kind, digest = r.headers["warc-type"], r.headers["warc-payload-digest"].removeprefix("sha256:")
    size = len(r.payload)
    if kind == "response":
        if hashlib.sha256(r.payload).hexdigest() != digest:
            raise ValueError(f"the record at {r.offset} doesn't have its payload's digest")
    else:
        size = int(r.http["content-length"])
    page, refers = r.headers.get("x-page-id"), r.headers.get("x-refers-to-page-id")
    return page and int(page), r.headers.get("warc-target-uri"), kind, refers and int(refers), size, digest, r.payload if payloads and kind == "response" else None


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = [re.split(" ", f)[0] for f in RECORDS.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    files = write_warc(pages, shared_folder(spark))
    return read_warc(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), q AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS least FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> least THEN least END AS refers_to
FROM q
"""
