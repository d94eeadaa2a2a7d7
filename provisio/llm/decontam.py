"""Benchmark decontamination by a prefix-filtered set join.

A window of an item is a set of word shingles (SHINGLE words each, fewer where the item has fewer), and must be
contained whole, so one prefix token is enough: its rarest shingle, by document frequency over all documents. A first
pass over the documents counts the frequencies of benchmark shingles. A second emits, where a document has a prefix
token, the position and the words around it. These rows meet the windows in a join on the token; a meeting is
bounded by position and length, then verified by comparing the window with the words there.

Windows of equal text are one window, so an item or text that repeats a word costs no more than its length. Equal texts
have equal results, so matches are kept by digest of the text and meet the documents by it. The executors are
sent only a filter of token hashes of at most FILTER_BITS bits; when the benchmark outgrows it, it lets more
through to the join, and results stay exact.

Defined results: a null or wordless text has no words and is never contaminated. Null or wordless items
have no window. Repeated item_ids count once in n_items; a null item_id counts as the empty string. Equal texts have
equal rows. Empty tables give zero counts. Very long texts are hashed in segments and count whole. Only doc_id
and text, item_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.llm.common import Sent, bounded_batches, table, written

WINDOW = 13
SHINGLE = 5
FILTER_BITS = 1 << 28  # 32 MB
BITS_PER_TOKEN = 64
BATCH_BYTES = 1 << 17
SEGMENT_BYTES = 1 << 20
SENT_DIGESTS = 200_000  # contaminated digests that the stage broadcasts, 16 bytes each; beyond, the join is shuffled
# Letters and digits in lower case and all bytes from 0x80 on stay; the rest parts words.
WORD_BYTES = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b >= 128 else 32 for b in range(256))
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


class Grid:
    """The words of several texts laid end to end: bytes with one space after each word, and where words start and end."""

    def __init__(self, texts: list[bytes]):
        whole = np.frombuffer(b" ".join([*(t.translate(WORD_BYTES) for t in texts), b""]), np.uint8)
        keep = whole != 32
        keep[1:] |= keep[:-1]  # a word and the byte after it, which is a space
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.data = whole[keep]
        self.ends = np.flatnonzero(self.data == 32)
        self.starts = np.append(0, self.ends[:-1] + 1)[: len(self.ends)]
        upto = np.add.reduceat(keep, np.append(0, ends[:-1]), dtype=np.int64).cumsum() if len(whole) else np.zeros(len(texts), np.int64)
        self.bounds = np.append(0, np.searchsorted(self.starts, upto))  # of each text, its first word
        self.n_words = np.diff(self.bounds)
        self.of = np.repeat(np.arange(len(texts)), self.n_words)

    def hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and 64-bit hashes of all shingles of size words that stand within one text."""
        n = len(self.starts) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.of[:n] == self.of[size - 1 :])
        out = np.empty(len(first), np.uint64)
        at = 0
        while at < len(first):
            low = self.starts[first[at]]
            stop = max(at + 1, int(np.searchsorted(self.ends[first + size - 1], low + SEGMENT_BYTES))) if len(self.data) > SEGMENT_BYTES else len(first)
            a, b = self.starts[first[at:stop]] - low, self.ends[first[at:stop] + size - 1] - low
            up, down = powers(int(b[-1]) + 1)
            total = np.zeros(int(b[-1]) + 1, np.uint64)
            np.cumsum((self.data[low : low + b[-1]].astype(np.uint64) + np.uint64(1)) * up[: b[-1]], out=total[1:])
            out[at:stop] = (total[b] - total[a]) * down[a]
            at = stop
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        return first, out

    def text(self, first: int, last: int) -> bytes:
        """Words first to last - 1, single-spaced."""
        return self.data[self.starts[first] : self.ends[last - 1]].tobytes() if last > first else b""


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 to n - 1, modulo 2**64; they are kept while they are short."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    found = []
    for base in (BASE, BASE_INVERSE):
        p = np.full(max(n, 4096), base, np.uint64)
        p[0] = 1
        found.append(np.multiply.accumulate(p))
    if n <= 2 * SEGMENT_BYTES:
        _POWERS[:] = found
    return found[0][:n], found[1][:n]


class Filter:
    """A set of 64-bit hashes as two probes into a bitmap: holds all of the set, and few others."""

    def __init__(self, hashes: DataFrame, most_bits: int = FILTER_BITS):
        """hashes: hash (long), distinct."""
        n = hashes.count()
        self.bits = min(most_bits, 1 << max(12, (n * BITS_PER_TOKEN - 1).bit_length())) if n else 0
        self.map = np.zeros(self.bits // 64, np.uint64)
        if not n:
            return
        slots = hashes.select(F.explode(F.array(*(F.shiftrightunsigned("hash", s).bitwiseAND(self.bits - 1) for s in self.shifts()))).alias("slot"))
        cells = slots.groupBy(F.shiftright("slot", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("own"))
        for r in cells.toArrow().to_batches():  # at most FILTER_BITS / 64 rows
            self.map[r.column(0).to_numpy()] = r.column(1).to_numpy().view(np.uint64)

    def shifts(self) -> tuple[int, int]:
        return 64 - (self.bits.bit_length() - 1), 3

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes (unsigned) pass, as positions."""
        if not self.bits:
            return np.zeros(0, np.int64)
        left = None
        for s in self.shifts():
            slot = ((hashes if left is None else hashes[left]) >> np.uint64(s)) & np.uint64(self.bits - 1)
            ok = (self.map[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
            left = np.flatnonzero(ok) if left is None else left[ok]
        return left


def batched(column: pa.Array, size: int = BATCH_BYTES) -> Iterator[list[bytes]]:
    own, held = [], 0
    for t in column:
        own.append(t.as_py() or b"")
        held += len(own[-1])
        if held >= size:
            yield own
            own, held = [], 0
    if own:
        yield own


def windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, window, size, hashes): each item's windows with the hashes of their shingles in order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                g = Grid([text or b""])
                n = len(g.starts)
                size = min(window, n)
                if not size:
                    continue
                k = min(SHINGLE, size)
                own, seen = g.hashes(k)[1].view(np.int64), set()
                for q in range(n - size + 1):
                    text_here = g.text(q, q + size)
                    if text_here not in seen:
                        seen.add(text_here)
                        out.append((item, text_here, size, own[q : q + size - k + 1]))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.int64()))], ["item", "window", "size", "hashes"])

    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text")).where("text is not null")
    return items.mapInArrow(rows, "item string, window binary, size int, hashes array<long>")


def frequencies(texts: DataFrame, known: Filter, sizes: list[int]) -> DataFrame:
    """(hash, n): in how many texts each shingle stands that passes the filter."""
    sent = Sent(texts.sparkSession, (known, sizes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sizes = sent.get()
        for b in batches:
            for part in batched(b.column(0)):
                g, found = Grid(part), [np.zeros(0, np.uint64)]
                for k in sizes:
                    first, h = g.hashes(k)
                    ok = own(h)
                    found.append(np.unique(np.stack([h[ok], g.of[first[ok]].astype(np.uint64)]), axis=1)[0] if len(ok) else h[:0])
                values, n = np.unique(np.concatenate(found), return_counts=True)
                if len(values):
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])

    return texts.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


CANDIDATES = "array<struct<at:int,hash:long,lead:int,around:binary>>"


def scanned(docs: DataFrame, prefix: Filter, sizes: list[int], window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, digest, found): found holds the places of prefix tokens; null where this task has met the text before."""
    sent = Sent(docs.sparkSession, (prefix, sizes))
    reach = window - 1

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own, sizes), met = sent.get(), set()
        kind = pa.list_(pa.struct([("at", pa.int32()), ("hash", pa.int64()), ("lead", pa.int32()), ("around", pa.binary())]))
        for b in batches:
            n_words, digests, out = [], [], []
            for part in batched(b.column(1)):
                g = Grid(part)
                places: list[list | None] = [None] * len(part)
                own_digests = [hashlib.md5(t).digest() for t in part]
                fresh = np.array([d not in met and not met.add(d) for d in own_digests])
                if len(met) > 200_000:
                    met.clear()
                for k in sizes:
                    first, h = g.hashes(k)
                    for j in own(h).tolist():
                        p = int(first[j])
                        text = int(g.of[p])
                        if fresh[text]:
                            low, high = int(g.bounds[text]), int(g.bounds[text + 1])
                            a, z = max(low, p - reach), min(high, p + k + reach)
                            if places[text] is None:
                                places[text] = []
                            places[text].append({"at": p - low, "hash": int(h[j].view(np.int64)), "lead": p - a, "around": g.text(a, z)})
                n_words += g.n_words.tolist()
                digests += own_digests
                out += places
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(digests, pa.binary()), pa.array(out, kind)], ["doc_id", "n_words", "digest", "found"])

    return docs.select(F.col("doc_id"), F.col("text").cast("binary")).mapInArrow(look, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, digest binary, found {CANDIDATES}")


COVERED = """aggregate(spans, struct(0L as total, -1 as reach), (s, x) -> struct(
  s.total + greatest(0, x.start + x.size - greatest(x.start, s.reach)) as total, greatest(s.reach, x.start + x.size) as reach), s -> s.total)"""


def matches(docs: DataFrame, bench: DataFrame, most_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_words, digest) of every row of docs, and (digest, n_hit, items) of the texts in which windows occur; both are written."""
    bounded_batches(docs.sparkSession)
    by_item = written(windows(bench), "windows")
    sizes = sorted(r[0] for r in by_item.select(F.least("size", F.lit(SHINGLE))).distinct().collect())
    distinct = by_item.dropDuplicates(["window"]).select("window", "size", "hashes")
    known = Filter(by_item.select(F.explode("hashes").alias("hash")).distinct(), most_bits)
    n = written(frequencies(docs.select(F.col("text").cast("binary")), known, sizes), "shingle-frequencies")
    # each window's prefix token: the shingle in fewest documents
    tokens = distinct.select("window", "size", F.posexplode("hashes").alias("o", "hash")).join(n, "hash", "left")
    prefix = tokens.groupBy("window", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "o")).alias("token"))
    prefix = written(prefix.select("window", "size", "token.hash", "token.o"), "prefix-tokens")
    rows = written(scanned(docs, Filter(prefix.select("hash").distinct(), most_bits), sizes), "scanned")
    places = rows.where("found is not null").select("digest", F.explode("found").alias("f")).select("digest", "f.*")
    met = places.join(prefix, "hash").where("at >= o and lead >= o")
    here = F.expr("array_join(slice(split(cast(around as string), ' '), lead - o + 1, size), ' ')")
    met = met.where(here == F.col("window").cast("string")).select("digest", (F.col("at") - F.col("o")).alias("start"), "size", "window").distinct()
    items = met.select("digest", "window").distinct().join(by_item.select("window", "item"), "window").groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    spans = met.groupBy("digest").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spans"))
    found = written(spans.join(items, "digest").select("digest", F.expr(COVERED).alias("n_hit"), "items"), "matches")
    return rows.select("doc_id", "n_words", "digest"), found


CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: a row per row of documents."""
    rows, found = matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    out = rows.join(found, "digest", "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), F.expr(CONTAMINATED).alias("contaminated"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    rows, found = matches(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    bad = written(rows.join(found, "digest").where(CONTAMINATED).select(F.col("digest").alias("__px_digest")).distinct(), "contaminated")
    few = bad.limit(SENT_DIGESTS + 1).count() <= SENT_DIGESTS
    own = F.unhex(F.md5(F.coalesce(F.col("text").cast("binary"), F.lit(b""))))
    return docs.join(F.broadcast(bad) if few else bad, own == F.col("__px_digest"), "left_anti")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[q:q + least(13, len(w)) - 1], ' ') AS g
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(q) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(p)),
m AS (SELECT dw.r, dw.p, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT DISTINCT r, p, n FROM m), unnest(range(p, p + n)) AS t(x) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
