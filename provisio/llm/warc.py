"""Legacy archive conversion: ARC records become WARC records.

ARC files (versions 1 and 2) are a version block and records, each a header line in the version's fields,
then as many bytes as the line declares. The converter parses them and makes for each an equivalent WARC
record: an identifier derived from its content and place, the timestamp in ISO form, digests of payload and block, and
its type. Of records with equal payloads the one of the smallest page is a response; the others are revisits
without the payload, which name the first one's identifier, URI and date.

The query writes pages as a table of ARC segments in the shared folder, converts them and writes WARC files: Spark's
text writer puts the records out with CRLF CRLF between them, which is the WARC framing, gzipped file by file.
A first parse gives each record's digest, a grouped minimum the first copies, a second parse the records. Records of
like size share files (CLASSES), so no file is over about 128 MB unpacked unless one record is. The files are read
back by their declared lengths, and a revisit finds its page by the identifier that it names.

Defined results: null html is an empty payload; a null url gets urn:page:<id>; other urls are percent-encoded
where ARC's header line can't hold them. Repeated rows of one page_id have equal types. A page_id of null is never the
first copy, and payloads that only such rows have are responses. Payloads under LEAST bytes are all responses. Very
long payloads stay whole. An empty table gives an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.llm.common import new_path, table, written

LEAST = 100
# Record sizes in bytes and how many records of such a size a file holds at most.
CLASSES = ((128 << 10, 1000), (8 << 20, 16), (1 << 62, 1))
SEGMENT_RECORDS = 64
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's namespace of URLs
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REVISIT, RESPONSE = "revisit", "response"


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    content_type: str
    body: bytes


def arc_segment(records: list[ArcRecord], version: int, name: str) -> bytes:
    """An ARC file: the version block, then the records."""
    about = f"{version} 0 provisio\n{' '.join(FIELDS[version])}\n".encode()
    tail = "" if version == 1 else f" 200 - - 0 {name}"
    out = [f"filedesc://{name} 0.0.0.0 20240101000000 text/plain{tail} {len(about)}\n".encode(), about, b"\n"]
    at = sum(map(len, out))
    for r in records:
        tail = "" if version == 1 else f" 200 {zlib.crc32(r.body):08x} - {at} {name}"
        head = f"{r.url} {r.ip} {r.date} {r.content_type}{tail} {len(r.body)}\n".encode()
        out += [head, r.body, b"\n"]
        at += len(head) + len(r.body) + 1
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file; its version block tells the fields of header lines."""
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        fields = data[at:end].decode().split(" ")
        length = int(fields[-1])
        body = data[end + 1 : end + 1 + length]
        if len(body) != length:
            raise ValueError(f"record at {at} declares {length} bytes, {len(body)} are there")
        at = end + 1 + length
        if version is None:
            if not fields[0].startswith("filedesc://"):
                raise ValueError("no version block")
            version = int(body.split(b" ", 1)[0])
            continue
        if len(fields) != len(FIELDS[version]):
            raise ValueError(f"{len(fields)} fields in a version {version} header line")
        yield ArcRecord(*fields[:4], body)


def http(payload_length: int, extra: dict[str, object]) -> bytes:
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {payload_length}", *(f"{k}: {v}" for k, v in extra.items() if v is not None)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def headers(block: bytes) -> tuple[dict[str, str], int]:
    """Header fields by lower-case name, and where the body starts."""
    end = block.index(b"\r\n\r\n")
    lines = block[:end].decode().split("\r\n")[1:]
    return {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}, end + 4


def record_id(url: str, date: str, page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{url} {date} {page_id} {digest}')}>"


def iso(date: str) -> str:
    return datetime.strptime(date, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def warcinfo() -> bytes:
    body = b"software: provisio\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, 'provisio')}>", f"WARC-Date: {EPOCH:%Y-%m-%dT%H:%M:%SZ}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + body


def to_warc(r: ArcRecord, first: tuple[str | None, str, str] | None = None) -> bytes:
    """The WARC record of an ARC record, without the CRLF CRLF that ends it. first: page, URI and ARC date of the record it repeats."""
    fields, at = headers(r.body)
    digest = hashlib.sha256(memoryview(r.body)[at:]).hexdigest()
    page = fields.get("x-page-id")
    block = r.body[:at] if first else r.body
    lines = [
        "WARC/1.1",
        f"WARC-Type: {REVISIT if first else RESPONSE}",
        f"WARC-Record-ID: {record_id(r.url, r.date, page, digest)}",
        f"WARC-Date: {iso(r.date)}",
        f"WARC-Target-URI: {r.url}",
        f"WARC-IP-Address: {r.ip}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page is not None:
        lines.append(f"X-Page-Id: {page}")
    if first:
        known, uri, date = first
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(uri, date, known, digest)}", f"WARC-Refers-To-Target-URI: {uri}", f"WARC-Refers-To-Date: {iso(date)}"]
    return ("\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by declared length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        length = int(fields["content-length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) != length or data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"record at {at} is cut short")
        at = end + 8 + length
        yield fields, block


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pages as ARC segments of both versions."""
    k = 0
    for batch in batches:
        for at in range(0, batch.num_rows, SEGMENT_RECORDS):
            own = []
            for page, url, text in zip(*(c.to_pylist() for c in batch.slice(at, SEGMENT_RECORDS).columns), strict=True):
                payload = text or b""
                date = (EPOCH + timedelta(seconds=(page or 0) % 86_400_000)).strftime("%Y%m%d%H%M%S")
                place = quote(url, safe="%/:?#[]@!$&'()*+,;=~") if url else f"urn:page:{page}"
                own.append(ArcRecord(place, "192.0.2.1", date, "text/html", http(len(payload), {"X-Page-Id": page}) + payload))
            version = 1 + k % 2
            yield pa.RecordBatch.from_arrays([pa.array([arc_segment(own, version, f"segment-{k}.arc")], pa.binary())], ["arc"])
            k += 1


ENTRY = [("page", pa.string()), ("url", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("size", pa.int64()), ("length", pa.int64())]
BODY = [("ip", pa.string()), ("content_type", pa.string()), ("body", pa.binary())]


def _parsed(whole: bool, low: int = 0, high: int = 1 << 62):
    """ARC bytes to rows of ENTRY, and of BODY if whole; only records of low to high - 1 bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = ENTRY + (BODY if whole else [])
        for batch in batches:
            for arc in batch.column(0):
                out = []
                for r in read_arc(arc.as_py()):
                    if low <= len(r.body) < high:
                        fields, at = headers(r.body)
                        out.append((fields.get("x-page-id"), r.url, r.date, hashlib.sha256(memoryview(r.body)[at:]).hexdigest(), len(r.body) - at, len(r.body), *((r.ip, r.content_type, r.body) if whole else ())))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True), kinds, strict=True)], [n for n, _ in kinds])

    return rows


ENTRY_SCHEMA = "page string, url string, date string, digest string, size long, length long"
BODY_SCHEMA = f"{ENTRY_SCHEMA}, ip string, content_type string, body binary"


def first_copies(entries: DataFrame) -> DataFrame:
    """(digest, first: page, url, date) of the payloads that several records have."""
    page = F.col("page").cast("long")
    first = F.min(F.when(page.isNotNull(), F.struct(page.alias("page"), "url", "date"))).alias("first")
    return entries.where(F.col("size") >= LEAST).groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begun = False
    for batch in batches:
        out = [] if begun else [warcinfo().decode()]
        begun = True
        for page, url, date, ip, kind, body, first in zip(*(batch.column(n).to_pylist() for n in ("page", "url", "date", "ip", "content_type", "body", "first")), strict=True):
            again = first is not None and str(first["page"]) != page
            out.append(to_warc(ArcRecord(url, ip, date, kind, body), (str(first["page"]), first["url"], first["date"]) if again else None).decode())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def write_warc(arcs: DataFrame, path: str) -> None:
    """arcs (arc: bytes of an ARC file) as gzipped WARC files under path.

    The first copies are written before they are joined, so that Spark sees how many there are and AQE splits a payload that
    many records share; short payloads have keys of their own.
    """
    entries = arcs.select("arc").mapInArrow(_parsed(False), ENTRY_SCHEMA)
    size_class = F.lit(len(CLASSES) - 1)
    for k, (high, _) in reversed(list(enumerate(CLASSES[:-1]))):
        size_class = F.when(F.col("length") < high, k).otherwise(size_class)
    entries = written(entries.select("page", "url", "date", "digest", "size", size_class.alias("class")), "arc-entries")
    first = written(first_copies(entries), "first-copies")
    for k in sorted(r[0] for r in entries.select("class").distinct().collect()):
        low, (high, records) = CLASSES[k - 1][0] if k else 0, CLASSES[k]
        rows = arcs.select("arc").mapInArrow(_parsed(True, low, high), BODY_SCHEMA)
        key = F.when(F.col("size") >= LEAST, F.col("digest")).otherwise(F.concat_ws(" ", F.lit("short"), "page"))
        met = rows.withColumn("key", key).join(first.withColumnRenamed("digest", "key"), "key", "left")
        texts = met.select("page", "url", "date", "ip", "content_type", "body", "first").mapInArrow(_records, "value string")
        texts.write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            out = []
            for fields, block in read_warc(zlib.decompress(content.as_py(), 31)):
                if fields["warc-type"] not in (RESPONSE, REVISIT):
                    continue
                inner, at = headers(block)
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                if fields["warc-type"] == RESPONSE and (int(inner["content-length"]) != len(block) - at or hashlib.sha256(memoryview(block)[at:]).hexdigest() != digest):
                    raise ValueError(f"{fields['warc-record-id']}: the payload isn't what the header says")
                page = fields.get("x-page-id")
                out.append((page and int(page), int(inner["content-length"]), digest, fields["warc-type"], fields.get("warc-refers-to"), fields["warc-record-id"], fields["warc-date"], fields["warc-target-uri"]))
            cols = list(zip(*out, strict=True)) or [()] * len(SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, SCHEMA, strict=True)], [n for n, _ in SCHEMA])


SCHEMA = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string()), ("record_id", pa.string()), ("record_date", pa.string()), ("target_uri", pa.string())]
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to_id string, record_id string, record_date string, target_uri string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per response or revisit record of the gzipped WARC files under path."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, READ)


def resolved(records: DataFrame) -> DataFrame:
    """records, as read_archives has them, with refers_to: the page of the record that a revisit names."""
    records = written(records, "warc-records")
    again = records.where(f"record_type = '{REVISIT}'")
    known = written(records.where(f"record_type = '{RESPONSE}'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.min("page_id").alias("refers_to")), "responses")
    return again.join(known, "refers_to_id", "left").unionByName(records.where(f"record_type = '{RESPONSE}'").withColumn("refers_to", F.lit(None).cast("long")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: a row per row of pages."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), "url", F.col("html").cast("binary"))
    arcs = written(pages.mapInArrow(_segments, "arc binary"), "arc-segments", compression="zstd")
    path = new_path(spark, "warc")
    write_warc(arcs, path)
    if arcs.isEmpty():
        records = spark.createDataFrame([], READ)
    else:
        records = read_archives(spark, path)
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS data FROM pages),
d AS (SELECT page_id, octet_length(data) AS n, sha256(data) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""
