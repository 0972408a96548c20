"""WARC archives: written by Spark's own text sink, read back by a salvage reader.

A record is headers, CRLF, block and the CRLF CRLF that ends it. With gzip each record is a
member of its own, as the standard asks, so damage to one never reaches the next. Tasks gzip
the records; the text sink writes them as they are, with a line separator of one zero byte,
which is the last byte of each member. So each part file is a WARC file on any file system
Spark writes to. Of equal payloads of `least` bytes or more the smallest id is a
response and the others revisit it; rows that share that id all are responses.

The reader takes whole files (`binaryFile`, up to 2 GB each), follows Content-Length and checks each record,
a response's payload by its WARC-Payload-Digest (SHA-1) and WARC-Payload-Length, where given;
where a check fails it searches the next version line or gzip member, logs the bytes between as
quarantined and goes on, so one broken record costs itself only. Files hold at most
`per_file` records.

Null html is an empty payload, a null url leaves the target header out, control characters in
a url are percent-encoded, a null id is written as `null` and read back as null. Repeated rows
are records of their own. Extra columns are ignored, an empty table gives no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "1970-01-01T00:00:00Z"
VERSION = b"WARC/1.1\r\n"
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_DIGEST = re.compile(r"(?:sha1:)?([A-Z2-7]{32})")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each five hex digits are four letters."""
    digest = F.sha1(payload)
    parts = []
    for i in range(8):
        value = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(ALPHABET), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def records(pages: DataFrame, least: int = 0, date: str = DATE) -> DataFrame:
    """One row a page: page_id, record_type, refers_to and the record's text."""
    html = F.coalesce(pages["html"], F.lit(""))
    own = pages.select(pages["page_id"], pages["url"], html.alias("html"), F.octet_length(html).cast("long").alias("size"), base32_sha1(html.cast("binary")).alias("digest"), F.sha2(html, 256).alias("same"))
    # ids and digests alone tell which rows revisit; the pages themselves are dealt by id, not by payload
    first = own.filter(F.col("size") >= least).groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).filter("first IS NOT NULL AND rows > 1")
    again = own.select("page_id", "same").join(first.select("same", "first"), "same").distinct().select(F.col("page_id").alias("__id"), F.col("same").alias("__same"), "first")
    own = own.join(again, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("same") == F.col("__same")), "left")
    revisit = F.coalesce((F.col("size") >= least) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    own = own.withColumn("revisit", revisit)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = F.concat(F.lit(head), F.when(F.col("revisit"), "").otherwise(F.col("html")))
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), name(F.col("first")))), F.when(F.col("revisit"), "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("size").cast("string")), F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return own.select("page_id", F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"), F.when(F.col("revisit"), F.col("first")).alias("refers_to"), F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block).alias("record"))


#: An empty gzip member; like that of a record under 16 MB, its last byte (of its size) is zero.
_EMPTY = gzip.compress(b"", mtime=0)


def _member_row(record: bytes) -> bytes:
    """A gzip member less its last byte, zero; after a longer record an empty member ends it."""
    made = gzip.compress(record, 6, mtime=0)
    return (made if made[-1] == 0 else made + _EMPTY)[:-1]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in by_bytes(batch, 0, 1 << 22):
            yield pa.RecordBatch.from_arrays([pa.array(map(_member_row, part.column(0).to_pylist()), pa.binary())], names=["record"])


def write(pages: DataFrame, path: str, least: int = 0, per_file: int = 500, compression: str = "gzip") -> None:
    """compression: gzip (a member a record), or none."""
    if compression not in ("gzip", "none"):
        raise ValueError(f"compression {compression}: gzip or none")
    rows, end = records(pages, least).select("record"), "\r\n\r\n"
    if compression == "gzip":
        whole = rows.select(F.concat("record", F.lit(end)).cast("binary").alias("record"))
        rows, end = whole.mapInArrow(_members, "record binary").select(F.col("record").cast("string")), "\0"
    rows.write.option("lineSep", end).option("maxRecordsPerFile", per_file).option("compression", "none").text(path)


def _member(data: bytes, at: int) -> tuple[bytes, int | None]:
    """(content, end) of the gzip member at `at`; a broken one has the content before its damage
    and no end."""
    d, out, pos = zlib.decompressobj(31), [], at
    try:
        while not d.eof and pos < len(data):
            out.append(d.decompress(data[pos : pos + (1 << 12)]))
            pos = min(len(data), pos + (1 << 12))
    except zlib.error:
        return b"".join(out), None
    return b"".join(out), pos - len(d.unused_data) if d.eof else None


def _record(data: bytes, at: int) -> tuple[dict, bytes, int] | None:
    """(headers, block, end) of the record at `at`, or None if a check fails."""
    if data[at : at + 8] not in (b"WARC/1.0", b"WARC/1.1") or (stop := data.find(b"\r\n\r\n", at)) < 0:
        return None
    head: dict[str, str] = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        head[key.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = head.get("content-length", "")
    if not re.fullmatch(r"\d{1,18}", length) or "warc-type" not in head:
        return None
    begin, end = stop + 4, stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    return (head, data[begin:end], end + 4) if _intact(head, data[begin:end]) else None


def _intact(head: dict, block: bytes) -> bool:
    """Whether a response has the SHA-1 and length its headers give its payload. A payload in a
    transfer encoding is not judged, nor another kind of digest."""
    if head["warc-type"] != "response" or re.search(rb"(?im)^transfer-encoding:", block.partition(b"\r\n\r\n")[0]):
        return True
    payload = payload_of(head, block)
    length, (kind, _, value) = head.get("warc-payload-length"), head.get("warc-payload-digest", "").partition(":")
    if length is not None and length != str(len(payload)):
        return False
    own = hashlib.sha1(payload)
    return kind.lower() != "sha1" or value.upper() in (base64.b32encode(own.digest()).decode(), own.hexdigest().upper())


def salvaged(data: bytes) -> Iterator[tuple[int, dict | None, bytes | int]]:
    """Records as (offset, headers, block) and gaps as (offset, None, bytes), as they are found.
    A record inside a gzip member has the member's offset; of a broken member the records before
    its damage are recovered, and the member is a gap. Gaps and what was read cover the whole
    data."""
    at = 0
    while at < len(data):
        stop = None
        if data[at : at + 3] == b"\x1f\x8b\x08":
            content, end = _member(data, at)
            lost = end is None or not content or content[:2] == b"\x1f\x8b"
            if content[:2] != b"\x1f\x8b":
                for _, head, block in salvaged(content):
                    if head is None:
                        lost = True
                    else:
                        yield at, head, block
            if not lost or end is not None:
                if lost and end - at != len(_EMPTY):
                    yield at, None, end - at
                at = end
                continue
        elif own := _record(data, at):
            yield at, own[0], own[1]
            at = own[2]
            continue
        nxt = _START.search(data, at + 1)
        stop = nxt.start() if nxt else len(data)
        yield at, None, stop - at
        at = stop


def salvage(data: bytes) -> tuple[list[tuple[int, dict, bytes]], list[tuple[int, int]]]:
    """All records, and all gaps, those that touch each other as one."""
    found, gaps = [], []
    for at, head, own in salvaged(data):
        if head is not None:
            found.append((at, head, own))
        elif gaps and sum(gaps[-1]) == at:
            gaps[-1] = gaps[-1][0], gaps[-1][1] + own
        else:
            gaps.append((at, own))
    return found, gaps


def payload_of(head: dict, block: bytes) -> bytes:
    if head.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


_READ = "path string, offset long, record_id string, record_type string, target_uri string, refers_to string, digest string, payload_length long, payload binary, gap long"


def _salvaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _READ.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64()]

    def rows(path: str, data: bytes) -> Iterator[tuple]:
        gap: tuple[int, int] | None = None
        for at, head, own in salvaged(data):
            if head is None:
                if gap and sum(gap) == at:
                    gap = gap[0], gap[1] + own
                    continue
                if gap:
                    yield path, gap[0], *[None] * 7, gap[1]
                gap = at, own
            else:
                digest, length = _DIGEST.fullmatch(head.get("warc-payload-digest", "")), head.get("warc-payload-length", "")
                yield path, at, head.get("warc-record-id"), head["warc-type"], head.get("warc-target-uri"), head.get("warc-refers-to"), digest and digest[1], int(length) if length.isdigit() else None, payload_of(head, own), None
        if gap:
            yield path, gap[0], *[None] * 7, gap[1]

    for batch in batches:
        for k in range(len(batch)):  # records leave as they are found: a whole archive's are never held
            held, size = [], 0
            for row in rows(batch.column(0)[k].as_py(), batch.column(1)[k].as_py()):
                held.append(row)
                size += len(row[8] or b"")
                if size >= 1 << 22 or len(held) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of records (gap null) and of quarantined gaps (gap: bytes; the rest null)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_salvaged, _READ)


def digests(read_back: DataFrame, kind: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of archives that `write`
    made; a response's size and digest are those of the payload read, a revisit's those it names."""
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(.*)>$", 1)
    response = F.col("record_type") == "response"
    return read_back.filter("gap IS NULL").select(
        F.expr(f"try_cast({'regexp_extract(record_id, ' + repr('^<urn:page:(.*)>$') + ', 1)'} AS {kind})").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, base32_sha1(F.col("payload"))).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        number(F.col("refers_to")).try_cast(kind).alias("refers_to"),
    )


_HEX = "sha1(coalesce(html, ''))"
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS size,
  list_aggregate(list_transform(range(32), lambda i: substr('{ALPHABET}', ((('0x' || substr({_HEX}, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), 'string_agg', '') AS digest
  FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f
"""
