"""WARC archives: write a record for each page, and read archives back with a salvage reader.

Writing: records are WARC/1.1. Of rows with equal payloads of `min_revisit_bytes` or more, those with the largest
page_id are response records, the others revisit records that refer to it and repeat length and digest of the payload
in their headers. Spark's text writer, which retries and commits tasks like any other, puts the raw bytes of records
into files of the shared folder, by default each record in a gzip member of its own. Only ids, digests and sizes are
grouped; pages are shuffled only where over `BROADCAST_DIGESTS` payloads repeat. Null html is an empty payload, a null
url leaves its header out; null page_ids are the smallest. Equal rows are records of their own, of which one is the
response: that of the first row, by no order that matters, as they are equal. An empty table gives an empty archive.
Other columns, whatever their names, are not read.

Reading: each file is checked record by record (version line, headers, length, end mark, block digest), plain or in
gzip members. After a failed check the reader searches for the next version line or member that passes all checks,
goes on there, and logs the bytes between as a gap with the reason. Files have at most `RECORDS_PER_FILE` records, and
fewer where records are so long that a file could pass `FILE_BYTES`; a longer record has a file of its own.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import written

CRLF = "\r\n"
DATE = "2025-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 1000
RECORDS_PER_FILE = 2048
#: A file is one row of binaryFile, and then of Arrow.
FILE_BYTES = 1 << 26
MEMBER_BLOCK = 1 << 14
#: Repeated payloads up to which their digests are broadcast, some 100 bytes each.
BROADCAST_DIGESTS = 1 << 17
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_CANDIDATE = re.compile(rb"WARC/1\.|\x1f\x8b\x08")
RECORD_SCHEMA = "file string, offset long, length long, problem string, record_type string, page_id string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def _headers(lines: list[tuple[str, Column]]) -> Column:
    """Header lines; those with a null value are left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in lines])


def with_records(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) to one column `value`: the record without its end mark."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html")).withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha1(F.col("html"))})
    sized = rows.filter(F.col("size") >= min_revisit_bytes).select("page_id", "digest")
    repeated = written(sized.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first"), "warc-repeated")
    rows = rows.join(F.broadcast(repeated) if repeated.count() <= BROADCAST_DIGESTS else repeated, "digest", "left")
    revisit = F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull())
    rows = rows.withColumn("is_revisit", revisit)
    body = F.when(F.col("is_revisit"), F.lit("")).otherwise(F.col("html"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    rows = rows.withColumn("block", F.concat(http, body))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = _headers(
        [
            ("WARC-Type", F.when(F.col("is_revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", name(F.col("page_id"))),
            ("WARC-Date", F.lit(DATE)),
            ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(F.col("block")))),
            ("WARC-Profile", F.when(F.col("is_revisit"), F.lit(PROFILE))),
            ("WARC-Refers-To", F.when(F.col("is_revisit"), name(F.col("first")))),
            ("X-Payload-Length", F.col("size").cast("string")),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.octet_length("block").cast("string")),
        ]
    )
    return rows.select(F.concat(F.lit(f"WARC/1.1{CRLF}"), head, F.lit(CRLF), F.col("block")).alias("value"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = pa.array([gzip.compress(x.as_py() + b"\r\n\r\n", 6, mtime=0) for x in batch.column(0)], pa.binary())
        yield pa.RecordBatch.from_arrays([packed], names=["value"])


def write_archives(pages: DataFrame, path: str, compress: bool = True, **options) -> None:
    """One gzip member for each record, or with compress=False plain records. The text writer ends every value with its
    line separator: an empty gzip member behind a member, the end mark behind a plain record."""
    records = with_records(pages, **options)
    if compress:
        records = records.select(F.col("value").cast("binary")).mapInArrow(_members, "value binary").select(F.col("value").cast("string"))
    end = gzip.compress(b"", mtime=0).decode("latin-1") if compress else CRLF * 2
    longest = pages.agg(F.max(F.octet_length("html")).alias("n")).first().n or 0
    most = max(1, min(RECORDS_PER_FILE, FILE_BYTES // (longest + 4096)))
    records.write.option("lineSep", end).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", most).text(path)


class Damaged(Exception):
    """A record or member that fails a check."""


def _record(data: memoryview, raw: bytes, at: int) -> tuple[int, dict]:
    """(end, fields) of the record that begins at `at`."""
    if not _VERSION.match(raw, at):
        raise Damaged("no version line")
    fields, place = {}, raw.find(b"\r\n", at) + 2
    # Line by line, whatever their length; what is no header ends the search.
    while (stop := raw.find(b"\r\n", place)) != place:
        if stop < 0:
            raise Damaged("headers do not end")
        key, colon, value = raw[place:stop].partition(b":")
        if not colon:
            raise Damaged("a header without a colon")
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        place = stop + 2
    if not re.fullmatch("[0-9]{1,15}", fields.get("content-length", "")):
        raise Damaged("no length")
    begin = stop + 2
    end = begin + int(fields["content-length"])
    if end > len(data):
        raise Damaged("the file ends inside the record")
    if bytes(data[end : end + 4]) != b"\r\n\r\n" and end != len(data):
        raise Damaged("no end mark behind the record")
    block = data[begin:end]
    said = fields.get("warc-block-digest", "")
    if said.startswith("sha1:") and hashlib.sha1(block).hexdigest() != said[5:]:
        raise Damaged("block digest differs")
    body = raw.find(b"\r\n\r\n", begin, end)
    payload = data[body + 4 : end] if fields.get("content-type", "").startswith("application/http") and body >= 0 else block
    fields["payload"] = payload
    return min(end + 4, len(data)), fields


def _member(raw: bytes, at: int) -> tuple[int, bytes]:
    """(end, content) of the gzip member at `at`. It is read in blocks and no further than the block in which it ends:
    what lies behind a member is never copied."""
    unzip, data, parts = zlib.decompressobj(31), memoryview(raw), []
    try:
        while not unzip.eof and at < len(raw):
            parts.append(unzip.decompress(data[at : at + MEMBER_BLOCK]))
            at = min(at + MEMBER_BLOCK, len(raw))
    except zlib.error as e:
        raise Damaged(f"gzip: {e}") from None
    if not unzip.eof:
        raise Damaged("the gzip member does not end")
    return at - len(unzip.unused_data), b"".join(parts)


def salvage(raw: bytes) -> Iterator[tuple[int, int, str | None, dict]]:
    """(offset, length, problem, fields): records have no problem, gaps have no fields. A gap runs from the first
    failed check to the next record or member that passes."""
    data, at, gap = memoryview(raw), 0, None
    while at < len(raw):
        try:
            if raw[at : at + 2] == b"\x1f\x8b":
                end, inner = _member(raw, at)
                found = list(salvage(inner))
                if inner and all(p for _, _, p, _ in found):
                    raise Damaged("no record in the gzip member")
            elif raw[at : at + 5] == b"WARC/":
                end, fields = _record(data, raw, at)
                found = [(0, 0, None, fields)]
            elif gap is None and raw[at : at + 1] in (b"\r", b"\n"):
                at += 1
                continue
            else:
                raise Damaged("neither a version line nor a gzip member")
        except Damaged as e:
            gap = gap or (at, str(e))
            m = _CANDIDATE.search(raw, at + 1)
            at = m.start() if m else len(raw)
            continue
        if gap:
            yield gap[0], at - gap[0], gap[1], {}
            gap = None
        for _, _, problem, fields in found:
            yield at, end - at, problem, fields
        at = end
    if gap:
        yield gap[0], len(raw) - gap[0], gap[1], {}


def _page_of(name: str | None) -> str | None:
    m = re.fullmatch(r"<urn:page:(.+)>", name or "")
    return m[1] if m else None


def _rows(path: str, raw: bytes, with_payload: bool) -> Iterator[tuple]:
    for offset, length, problem, f in salvage(raw):
        if problem:
            yield path, offset, length, problem, None, None, None, None, None, None, None
            continue
        kind, payload = f.get("warc-type"), f["payload"]
        said = f.get("warc-payload-digest", "").removeprefix("sha1:")
        whole = kind != "revisit"
        digest = hashlib.sha1(payload).hexdigest() if whole else said
        if whole and said and digest != said:
            problem = "payload digest differs"
        said_size = f.get("x-payload-length", "")
        size = len(payload) if whole else int(said_size) if re.fullmatch("[0-9]{1,15}", said_size) else None
        yield path, offset, length, problem, kind, _page_of(f.get("warc-record-id")), f.get("warc-target-uri"), size, digest, _page_of(f.get("warc-refers-to")), bytes(payload) if with_payload and whole else None


def write_gaps(records: DataFrame, path: str) -> None:
    """The log of quarantined bytes (file, offset, length, problem) of what read_archives found, as JSON lines."""
    records.filter("record_type is null").select("file", "offset", "length", "problem").write.mode("append").json(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each record, and for each gap (problem set, record_type null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = list(_rows(name.as_py(), content.as_py(), with_payload))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, RECORD_SCHEMA)
