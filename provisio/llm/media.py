"""Media columns: interleaved document sequences.

HTML is parsed into an ordered sequence of parts, texts and media references, each with its position; a
media part carries the digest it refers to and its caption. Payloads live in a media table keyed by digest,
stored losslessly as 8-bit grey samples in PNG files, 64 samples wide. A digest join resolves each reference
with what was computed from the stored bytes read back, so positions and captions stay with their media.

The query renders each text as such a page: its text, then a figure that refers to the text's own payload
(UTF-8 bytes, zeros up to a positive multiple of 64). Pages are parsed again, and the parsed text is compared with the
document's (aligned). Media tables are written to the shared folder and read back. Equal texts have one digest and so equal
values.

Defined results: null text counts as empty, whose payload is 64 zero bytes. References that no media row
answers keep null media columns. Repeated rows repeat. Very long texts are stored whole. An empty table gives an empty
result. Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.llm.common import new_path, table, written
from provisio.llm.dom import INLINE, events

WIDTH = 64
MAGIC = b"\x89PNG\r\n\x1a\n"
PARTS = "parts array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"


def padded(data: bytes) -> bytes:
    return data + b"\0" * (WIDTH if not data else -len(data) % WIDTH)


def to_png(payload: bytes) -> bytes:
    """8-bit grey samples, WIDTH to a row; payload's length is a positive multiple of WIDTH."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # each row starts with filter type 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of a PNG as to_png writes it."""
    if data[:8] != MAGIC:
        raise ValueError("not a PNG")
    at, body, size = 8, [], (0, 0)
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        chunk = data[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(kind + chunk)) != data[at + 8 + n : at + 12 + n]:
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack(">II", chunk[:8])
        elif kind == b"IDAT":
            body.append(chunk)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def sequence(source: str, spaces: bool = False) -> list[tuple[int, str, str | None, str | None, str | None]]:
    """(position, kind, text, digest, caption) in page order; kind is text or media. A figure's caption goes with its media.
    Texts keep their outer white space where spaces are asked for; those of nothing else are no parts."""
    out: list[list] = []
    text: list[str] = []
    figure: int | None = None
    caption: list[str] | None = None

    def flush() -> None:
        whole = "".join(text)
        text.clear()
        if bare := whole.strip():
            out.append([len(out), "text", whole if spaces else bare, None, None])

    for kind, what, more in events(source):
        if kind == "text":
            (text if caption is None else caption).append(html.unescape(what) if "&" in what else what)
            continue
        if kind == "open" and what in ("img", "video", "audio", "source"):
            digest = more.get("data-digest") or more.get("src", "").removeprefix("sha256:") or None
            flush()
            if figure is not None:
                figure = len(out)
            out.append([len(out), "media", None, digest, more.get("alt") or None])
        elif what == "figure":
            flush()
            figure = -1 if kind == "open" else None
        elif what == "figcaption":
            if kind == "open":
                flush()
                caption = []
            else:
                if caption is not None and figure is not None and figure >= 0:
                    out[figure][4] = " ".join("".join(caption).split()) or out[figure][4]
                caption = None
        elif what not in INLINE:
            flush()
    flush()
    return [tuple(x) for x in out]


def sequences(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key and parts of pages (key, html): the ordered parts of each page."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("position", "kind", "text", "digest", "caption")
        kind = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in names[1:])]))
        for b in batches:
            found = [[dict(zip(names, p, strict=True)) for p in sequence(t or "")] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], [key, "parts"])

    return pages.select(F.col(key).cast("long"), "html").mapInArrow(rows, f"{key} long, {PARTS}")


def features(payload: bytes) -> str:
    """Mean, spread and entropy of the samples, and how many rows there are."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = counts[counts > 0] / len(payload)
    mean = float((np.arange(256) * counts).sum() / len(payload))
    var = float((((np.arange(256) - mean) ** 2) * counts).sum() / len(payload))
    return f"mean={mean:.4f};std={var**0.5:.4f};entropy={abs(float(-(p * np.log2(p)).sum())):.4f};rows={len(payload) // WIDTH}"


def resolved(media: DataFrame) -> DataFrame:
    """media (digest, media): what each digest's stored bytes give when read back, a row per digest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for stored in b.column(1):
                data = stored.as_py()
                payload = from_png(data)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(payload)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["digest", *NAMES])

    read = media.select("digest", "media").mapInArrow(rows, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return read.groupBy("digest").agg(*(F.min(n).alias(n) for n in NAMES))


NAMES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def joined(parts: DataFrame, media: DataFrame) -> DataFrame:
    """parts (one row per part, with digest) with the resolved media of each reference.

    What was resolved is written first: both sides of the join are then plain shuffles, in which AQE splits a digest that many copies share.
    """
    return parts.join(written(resolved(media), "resolved"), "digest", "left")


def page(text: str, digest: str) -> str:
    return f'<article><p>{html.escape(text, quote=False)}</p><figure><img src="sha256:{digest}"><figcaption>payload of {len(text)} characters</figcaption></figure></article>'


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's page, parsed again: its reference's digest, position and caption, and the media row (null where this task has written the digest just before)."""
    for b in batches:
        seen: set[str] = set()
        out = []
        for t in b.column(1).to_pylist():
            t = t or ""
            data = t.encode()
            payload = padded(data)
            digest = hashlib.sha256(payload).hexdigest()
            found = sequence(page(t, digest), spaces=True)
            aligned = "".join(p[2] for p in found if p[1] == "text") == (t if t.strip() else "")
            position, _, _, ref, caption = next(p for p in found if p[1] == "media")
            out.append((len(data), len(found), position, ref, caption, aligned, None if digest in seen else to_png(payload)))
            seen.add(digest)
        cols = list(zip(*out, strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_parts", "position", "digest", "caption", "aligned", "media"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, the reference's position and caption, and whether the parsed text is the document's."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    rows = docs.mapInArrow(_rendered, "doc_id long, n_bytes long, n_parts long, position long, digest string, caption string, aligned boolean, media binary")
    path = new_path(spark, "media")
    rows.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    met = joined(stored.drop("media"), stored.where("media is not null"))
    return met.select("doc_id", "n_bytes", *NAMES, "n_parts", "position", "caption", "aligned")
