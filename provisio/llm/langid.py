"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 2- and 3-grams are summed over all training documents by Spark; tables of log probabilities
(LANGUAGES x BUCKETS at most, 32 MB, one for each so many languages) go to every task, which scores slices of texts
as gathers and segment sums in numpy. With several tables a task holds one at a time and merges their results. Letters are taken in lower case, all else as a space. Training uses only rows that are
not held out: crc32 of doc_id as text, mod 5, is not 0.

Defined results: lang_pred is und with score 0 for null texts and texts without a letter, or when nothing was
learned. A null doc_id is neither held out nor learned from. Ties go to the smallest language name. Very long
texts count in full. Repeated rows count each time. An empty table gives an empty result. Only doc_id, text and lang
are read, whatever other columns there are, lang only for training.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.llm.common import Sent, table, written

BITS = 16
BUCKETS = 1 << BITS
LANGUAGES = 64  # of one table
HELD_CHARS = 4_000_000  # that a task with several tables reads before it takes the next table
SMOOTH = 0.5
SLICE_CHARS = 2_000_000
SPACE = 32


def letters() -> np.ndarray:
    """For each code point of the basic plane, its lower-case letter or a space."""
    chars = [chr(c) for c in range(1 << 16)]
    return np.array([ord(c.lower()[0]) if c.isalpha() else SPACE for c in chars], np.uint32)


def folded(chars: np.ndarray, known: np.ndarray) -> np.ndarray:
    out = known[np.minimum(chars, len(known) - 1)]
    high = np.flatnonzero(chars >= len(known))
    if len(high):
        values, back = np.unique(chars[high], return_inverse=True)
        out[high] = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else SPACE for c in values.tolist()], np.uint32)[back]
    return out


def grams(texts: list[str], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all 3-grams and of all 2-grams that start in each text's block (two spaces and the text), the blocks' starts, and whether each has a letter."""
    sizes = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    chars = np.frombuffer(("".join("  " + t for t in texts) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = folded(chars, known)
    starts = np.cumsum(sizes) - sizes
    lettered = np.maximum.reduceat(c[:-2], starts) > SPACE
    a, b, d = c[:-2] * np.uint32(0x9E3779B1), c[1:-1] * np.uint32(0x85EBCA77), c[2:] * np.uint32(0xC2B2AE3D)
    two = a + b
    three = two + d
    two ^= two >> np.uint32(15)
    three ^= three >> np.uint32(15)
    two, three = two * np.uint32(0x2C1B3C6D), three * np.uint32(0x297A2D39)
    return np.stack([two >> np.uint32(32 - BITS), three >> np.uint32(32 - BITS)]), starts, lettered


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = held = 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= SLICE_CHARS:
            yield at, k + 1
            at, held = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


class Model:
    """Log probabilities of some languages, and their share of all documents learned from."""

    def __init__(self, langs: list[str], n_docs: np.ndarray, counts: np.ndarray, all_docs: float | None = None):
        self.langs = langs
        total = counts.sum(axis=1, keepdims=True)
        self.logp = np.log(counts + SMOOTH) - np.log(total + SMOOTH * BUCKETS) if langs else counts
        self.prior = np.log(n_docs) - np.log(all_docs or n_docs.sum()) if langs else n_docs

    def best(self, texts: list[str], known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each slice: the best language's number, its log score, the sum of exp(score - best) over these languages, and whether there is a letter."""
        for a, b in slices(texts):
            buckets, starts, lettered = grams(texts[a:b], known)
            score = np.stack([p + sum(np.add.reduceat(w[g], starts) for g in buckets) for p, w in zip(self.prior, self.logp, strict=True)])
            top = score.max(axis=0)
            yield score.argmax(axis=0), top, np.exp(score - top).sum(axis=0), lettered

    def predict(self, texts: list[str], known: np.ndarray) -> Iterator[tuple[str, float]]:
        yield from merged([self], texts, known)


def merged(models: Iterable[Model], texts: list[str], known: np.ndarray) -> Iterator[tuple[str, float]]:
    """The best language over all models, which come in order of their languages' names, and its share of the probability."""
    lang, top, total, lettered = np.full(len(texts), "und", object), np.full(len(texts), -np.inf), np.zeros(len(texts)), np.zeros(len(texts), bool)
    for m in models:
        if not m.langs or not texts:
            continue
        best, own, share, lettered = (np.concatenate(x) for x in zip(*m.best(texts, known), strict=True))
        new = np.maximum(top, own)
        total = total * np.exp(top - new) + share * np.exp(own - new)
        better = own > top  # ties stay with the smaller name
        lang[better] = np.array(m.langs, object)[best[better]]
        top = new
    for k, n, ok in zip(lang.tolist(), total.tolist(), lettered.tolist(), strict=True):
        yield (k, 1 / n) if ok else ("und", 0.0)


def remainder(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def learned(docs: DataFrame, most: int = LANGUAGES) -> list[Model]:
    """Models of at most so many languages each, in order of name, from all rows that are not held out and have text and lang."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id")) != 0)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums, n = letters(), {}, {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, got in sums.items():
                at = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(got[at], n[lang]), pa.int64())], ["lang", "bucket", "n"])
            sums.clear()
            n.clear()

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for k, t in zip(langs, texts, strict=True) if k == lang]
                n[lang] = n.get(lang, 0) + len(own)
                for a, b in slices(own):
                    got = np.bincount(grams(own[a:b], known)[0].ravel(), minlength=BUCKETS)
                    sums[lang] = sums[lang] + got if lang in sums else got
                if len(sums) > LANGUAGES:
                    yield from told()
        yield from told()

    # bucket -1 holds the documents
    summed = written(rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "gram-counts")
    n_docs = {r.lang: r.n for r in summed.where("bucket = -1").collect()}
    langs, out = sorted(n_docs), []
    for at in range(0, len(langs), most):
        own = langs[at : at + most]
        place = {lang: k for k, lang in enumerate(own)}
        counts = np.zeros((len(own), BUCKETS))
        got = summed.where((F.col("bucket") >= 0) & F.col("lang").between(own[0], own[-1])).toArrow()  # most x BUCKETS cells
        for b in got.to_batches():
            counts[[place[x] for x in b.column(0).to_pylist()], b.column(1).to_numpy()] = b.column(2).to_numpy()
        out.append(Model(own, np.array([n_docs[x] for x in own], float), counts, float(sum(n_docs.values()))))
    return out


def identified(docs: DataFrame, models: list[Model]) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row per row of docs."""
    sent = [Sent(docs.sparkSession, m) for m in models]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kept = letters(), [s.get() for s in sent] if len(sent) == 1 else None

        def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            texts = [t or "" for b in held for t in b.column(2).to_pylist()]
            found = list(merged(kept or (s.get() for s in sent), texts, known))
            own = [pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([*own, pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if kept or size > HELD_CHARS:
                yield told(held)
                held, size = [], 0
        if held:
            yield told(held)

    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), held, "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identified(docs, learned(docs))
