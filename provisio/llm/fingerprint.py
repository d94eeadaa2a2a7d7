"""Document fingerprints: a sketch that scales with the document.

All word shingles (SHINGLE words; of fewer words, all of them) are hashed to 64 bits, and every hash below a fixed FRACTION of
their range is kept. What a document keeps doesn't depend on its size or on other documents, so the sketch of a
union is the union of the sketches, and the share of a small sketch that lies in a very large one estimates
containment without bias, however unequal the two are. A text that has shingles, but none below the bound, keeps its least
hash in place of none: texts of a few words don't look alike then. A union drops such a hash as soon as it holds one
below the bound.

Words are runs of letters A-Z in either case, digits and all characters beyond ASCII, as in the decontamination.

Each document is compared with its edited text and with the next one, by descending doc_id. For that the table is dealt out by
ranges of doc_id, whose bounds come from the ids alone; the first row of a range is sent to the range before it too.
Rows are sorted within ranges and streamed, so a task holds two texts and a batch, and texts are shuffled once.

Defined results: a null text is the empty text, whose fingerprint is the empty string, as it is of any text without words;
two fingerprints without hashes are alike (1), one without and one with are not (0). A null doc_id stands after all others. Rows that share a doc_id are ordered
by text. The next of a table's only row is that row. Repeated rows repeat. Very long texts are hashed in segments
and count whole. An empty table gives an empty result. Only doc_id and text are read, whatever other columns there
are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provisio.llm.common import Sent, bounded_batches, table, written
from provisio.llm.decontam import Grid, batched

SHINGLE = 5
FRACTION = 1 / 8
RANGE_ROWS = 4096  # of documents to a range


def bound(fraction: float = FRACTION) -> np.uint64:
    return np.uint64(int(fraction * 2**64))


def sketches(texts: list[bytes], fraction: float = FRACTION, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of each text: sorted distinct unsigned hashes."""
    out: list[np.ndarray] = []
    below = bound(fraction)
    for part in batched(pa.array(texts, pa.binary())):
        g = Grid(part)
        first, own = g.hashes(shingle)
        of, hashes = [g.of[first]], [own]
        for k in np.unique(g.n_words[(g.n_words > 0) & (g.n_words < shingle)]).tolist():
            short = np.flatnonzero(g.n_words == k)
            of.append(short)
            hashes.append(Grid([part[j] for j in short]).hashes(k)[1])
        of, hashes = np.concatenate(of), np.concatenate(hashes)
        few = np.flatnonzero(hashes < below)
        kept_of, kept = of[few], hashes[few]
        bare = np.flatnonzero((g.n_words > 0) & (np.bincount(kept_of, minlength=len(part)) == 0))
        if len(bare):  # their least hash
            least = np.full(len(part), np.iinfo(np.uint64).max)
            np.minimum.at(least, of, hashes)
            kept_of, kept = np.append(kept_of, bare), np.append(kept, least[bare])
        order = np.lexsort((kept, kept_of))
        kept_of, kept = kept_of[order], kept[order]
        fresh = np.ones(len(kept), bool)
        fresh[1:] = (kept_of[1:] != kept_of[:-1]) | (kept[1:] != kept[:-1])
        kept_of, kept = kept_of[fresh], kept[fresh]
        out += np.split(kept, np.searchsorted(kept_of, np.arange(1, len(part))))
    return out


def merged(*parts: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of the union of what the parts sketch."""
    union = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))
    below = union[union < bound(fraction)]
    return below if len(below) else union[:1]


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Which share of a's shingles b has, as their sketches tell."""
    return _shared(a, b) / len(a) if len(a) else 1.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared shingles among all of both, as their sketches tell: 0 to 1."""
    if not len(a) and not len(b):
        return 1.0
    both = _shared(a, b)
    return both / (len(a) + len(b) - both)


def written_as(sketch: np.ndarray) -> str:
    """16 hex digits for each hash, ascending."""
    return sketch.astype(">u8").tobytes().hex()


def read_back(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _sketched(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in parts:
        found = sketches([t.as_py() or b"" for t in texts])
        sizes = np.append(0, np.cumsum([len(s) for s in found]))
        yield pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)))


def group_sketches(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, hash): the sketch of each group's documents together, a row per hash, so that a group may be of any size."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*keys, F.explode(_sketched(F.col("text").cast("binary"))).alias("hash")).distinct()
    below = F.col("hash").between(0, int(bound()) - 1)
    ranked = F.shiftrightunsigned("hash", 1)  # in the order of unsigned hashes, but for the last bit
    bare = rows.groupBy(*keys).agg(F.max(below).alias("__any"), F.min_by("hash", F.struct(ranked, F.col("hash").bitwiseAND(1))).alias("hash")).where("not __any")
    return rows.where(below).select(*keys, "hash").unionByName(bare.select(*keys, "hash"))


def group_containments(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a, b: sketches as rows (key, hash). (key, other, shared, contained): which share of each group of a lies in each group of b that shares a hash with it."""
    other = b.withColumnRenamed(key, "other")
    sizes = a.groupBy(key).agg(F.count("*").alias("size"))
    shared = a.join(other, "hash").groupBy(key, "other").agg(F.count("*").alias("shared"))
    return shared.join(sizes, key).select(key, "other", "shared", (F.col("shared") / F.col("size")).alias("contained"))


def ranges(ids: DataFrame, rows: int = RANGE_ROWS) -> np.ndarray:
    """The greatest doc_id of each range, descending: as many numbers as there are ranges. A range of nulls alone has none."""
    n = -(-ids.count() // rows)
    if n < 2:
        return np.zeros(0, np.int64)
    dealt = ids.repartitionByRange(n, F.col("doc_id").desc_nulls_last()).withColumn("range", F.spark_partition_id())
    heads = dealt.groupBy("range").agg(F.max("doc_id").alias("head")).where("head is not null").select("head")
    return np.sort(heads.toArrow()["head"].to_numpy())[::-1]


def placed(docs: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """(range, guest, doc_id, text): every row in its range, and the first doc_id of each range once more, as guest of the range before it."""
    heads = ranges(docs.select("doc_id"), rows)
    sent = Sent(docs.sparkSession, heads)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def place(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """The range, and for its first doc_id the range before it."""
        own = sent.get()
        rising = own[::-1]
        for ids in parts:
            v, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            at = np.where(null, len(own) - 1, len(own) - 1 - np.searchsorted(rising, v, "left"))
            first = ~null & (own[at] == v)
            sizes = np.append(0, np.cumsum(1 + first))
            both = np.empty(sizes[-1], np.int64)
            both[sizes[:-1]] = at
            both[sizes[1:][first] - 1] = (at[first] - 1) % len(own)
            yield pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(both))

    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if len(heads) < 2:  # one range: its first row is its own guest
        head = docs.agg(F.max("doc_id").alias("head")).first()["head"]
        is_head = F.col("doc_id").eqNullSafe(F.lit(head).cast("long"))
        targets = F.when(is_head, F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    else:
        targets = place("doc_id")
    dealt = text.select(F.posexplode(targets).alias("nth", "range"), "doc_id", "text").select("range", (F.col("nth") > 0).alias("guest"), "doc_id", "text")
    return dealt.repartitionById(max(1, len(heads)), F.col("range").cast("int")).sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "text")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, guest, doc_id, text), in order: each that is no guest with what follows it."""
    held = None  # the row before: range, doc_id, text, sketch
    for b in batches:
        at, guests, ids, texts = (c.to_pylist() for c in b.columns)
        own = sketches([t.encode() for t in texts])
        pairs = []
        for k in range(len(ids)):
            if held is not None and held[0] == at[k]:
                pairs.append((held, texts[k], own[k]))
            held = None if guests[k] else (at[k], ids[k], texts[k], own[k])
        edited = [edit(p[0][2], p[1]).encode() for p in pairs]
        changed = sketches(edited)
        cols = [
            pa.array([p[0][1] for p in pairs], pa.int64()), pa.array([len(p[0][2]) for p in pairs], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
            pa.array([written_as(p[0][3]) for p in pairs], pa.string()), pa.array([written_as(c) for c in changed], pa.string()),
            pa.array([likeness(p[0][3], c) for p, c in zip(pairs, changed, strict=True)], pa.float64()), pa.array([likeness(p[0][3], p[2]) for p in pairs], pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(cols, NAMES)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def edit(text: str, following: str) -> str:
    """text with its last third replaced by as much of the beginning of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row per document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return placed(docs).mapInArrow(_compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
