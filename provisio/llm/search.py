"""Ranked lexical search by pipelined term partitioning.

Terms have owners by weight: the rarest terms the first, the most frequent the last. Documents are laid out in blocks, and an
owner holds its terms' postings block by block. Items travel in bundles of BUNDLE: a bundle visits the owners in turn, once for
each block, and carries sparse accumulators, the scores so far of its items' documents. At each stage a cogroup brings
a bundle and its owner's postings together, which add integer contributions. What cannot reach an item's TOP
documents of the block any more, even if all terms of the later owners were in it as often as can be, isn't carried on; this
is exact, as the bound holds for any document. Behind the last owner each block has at most TOP documents an item left, from which the
final selection is made.

The corpus is read once. A task lays its documents out in blocks and keeps the postings of terms that pass a filter of the
items' terms, of at most FILTER_BITS bits; what it lets through besides falls out in the join with the exact terms.
A block has at most BLOCK_DOCS documents and about BLOCK_POSTINGS postings, so a bundle's visit has bounded size, whatever
a term's frequency.

Defined results: a null or termless text has no terms, is not counted and never ranked. A null or termless item has no rows.
Each row of benchmark is an item of its own, so rows that share an item_id are ranked apart; so are rows of documents
that share a doc_id. A null doc_id comes last among equal scores. A text is counted in segments, and whole. Empty tables give
an empty result. Only doc_id and text, item_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provisio.llm.common import Sent, bounded_batches, new_path, table, written
from provisio.llm.decontam import FILTER_BITS, WORD_BYTES, Filter

TOP = 50
OWNERS = 4
BUNDLE = 256
BLOCK_DOCS = 4096
BLOCK_POSTINGS = 1 << 20
SEGMENT = 1 << 20
MOST = 1_000_000  # no occurrences, however many, give a term more than its weight times this


def terms(text: bytes) -> Counter:
    """Terms of a text with their occurrences."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + SEGMENT
        part = text[at:end].translate(WORD_BYTES)
        if end < len(text) and (cut := part.rfind(b" ")) > 0:
            end, part = at + cut, part[:cut]
        while end < len(text) and b" " not in part[-1:] and text[end : end + 1].translate(WORD_BYTES) != b" ":  # a term longer than a segment
            more = text[end : end + SEGMENT].translate(WORD_BYTES)
            cut = more.find(b" ")
            cut = len(more) if cut < 0 else cut
            part, end = part + more[:cut], end + cut
        found.update(part.split())
        at = end
    return found


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def item_terms(bench: DataFrame) -> DataFrame:
    """(item, item_id, term, hash), distinct by item and term; item numbers the rows of bench, BUNDLE rows in a row to a bundle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            out = []
            for t in b.column(1):
                out.append(sorted(terms(t.as_py() or b"")))
            sizes = np.array([len(o) for o in out], np.int64)
            items = np.repeat(np.arange(number, number + len(out)), sizes)
            number += len(out)
            flat = [t for o in out for t in o]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), b.column(0).take(pa.array(np.repeat(np.arange(len(out)), sizes))), pa.array(flat, pa.binary()), pa.array(hashed(flat).view(np.int64))], ["item", "item_id", "term", "hash"])

    kind = bench.schema["item_id"].dataType.simpleString()
    return bench.select("item_id", F.col("text").cast("binary").alias("text")).mapInArrow(rows, f"item long, item_id {kind}, term binary, hash long")


POSTINGS = "block long, term binary, docs array<long>, ords array<int>, tfs array<int>, sizes array<int>"


def laid_out(docs: DataFrame, wanted: Filter, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Blocks of documents. A row without term has a block's doc_ids in order and their sizes in terms; a row with one, where the term stands: place in the block, occurrences, size."""
    sent = Sent(docs.sparkSession, wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = sent.get(), TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, int, list[bytes], list[int]]] = []
        weight = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = terms(text.as_py() or b"")
                if not found:
                    continue
                words = list(found)
                kept = [words[k] for k in own(hashed(words)).tolist()]
                held.append((doc_id, found.total(), kept, [found[w] for w in kept]))
                weight += len(kept)
                if len(held) >= block_docs or weight >= BLOCK_POSTINGS:
                    yield _block(block, held)
                    held, weight, block = [], 0, block + 1
        if held:
            yield _block(block, held)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(rows, POSTINGS)


def _block(block: int, held: list) -> pa.RecordBatch:
    held.sort(key=lambda h: (h[0] is None, h[0] or 0))  # places follow doc_id, so that equal scores are parted by place
    counts = np.array([len(h[2]) for h in held])
    words = [w for h in held for w in h[2]]
    number: dict[bytes, int] = {}
    of = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    order = np.argsort(of, kind="stable")
    ords = np.repeat(np.arange(len(held), dtype=np.int32), counts)[order]
    tfs = np.fromiter((n for h in held for n in h[3]), np.int32, len(words))[order]
    sizes = np.array([h[1] for h in held], np.int32)
    offsets = np.append([0, 0], np.cumsum(np.bincount(of, minlength=len(number)))) if len(number) else np.zeros(2, np.int64)
    lists = lambda values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
    ids = pa.array([h[0] for h in held], pa.int64())
    own = pa.ListArray.from_arrays(pa.array(np.append([0], np.full(len(number) + 1, len(held))), pa.int32()), ids)
    every = lists(sizes[ords])
    first = pa.array([sizes], pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(number) + 1, block), pa.int64()), pa.array([None, *number], pa.binary()), own, lists(ords), lists(tfs), pa.concat_arrays([first, every.slice(1)])],
        ["block", "term", "docs", "ords", "tfs", "sizes"],
    )


def weighed(by_item: DataFrame, blocks: DataFrame, n: int, owners: int = OWNERS) -> DataFrame:
    """(term, bundle, owner, weight, slots, ahead): the items' terms that occur, by bundle; slots are the places in the bundle of the items that have a term, ahead what the terms of the owners after this one weigh in each of them."""
    df = blocks.where("term is not null").groupBy("term").agg(F.sum(F.size("ords").cast("long")).alias("df"))
    weight = F.floor(F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1)) * 1000).cast("long")
    heaviest = max(1.0, 1000 * math.log((2.0 * n + 2) / 3))
    owner = F.floor((1 - F.col("weight") / heaviest) * owners)
    pairs = by_item.join(df, "term").select("item", "term", weight.alias("weight")).where("weight > 0").withColumn("owner", F.greatest(F.lit(0), F.least(owner, F.lit(owners - 1))).cast("int"))
    ahead = pairs.groupBy("item").agg(F.array(*(F.coalesce(F.sum(F.when(F.col("owner") > k, F.col("weight"))), F.lit(0)) for k in range(owners))).alias("ahead"))
    slot = F.struct((F.col("item") % BUNDLE).cast("int").alias("slot"), F.get("ahead", F.col("owner")).alias("ahead"))
    by_bundle = pairs.join(ahead, "item").groupBy("term", "owner", "weight", F.floor(F.col("item") / BUNDLE).cast("long").alias("bundle")).agg(F.collect_list(slot).alias("s"))
    return by_bundle.select("term", "bundle", "owner", "weight", F.col("s.slot").alias("slots"), F.col("s.ahead").alias("ahead"))


CARRIED = "block long, bundle long, slot int, ords array<int>, scores array<long>"
UNKNOWN = 1 << 40  # no bound: for items of which no posting of this stage tells what is ahead


def _visit(last: bool, n: int, length: int, top: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """An owner's part: what a bundle carries of a block, with the owner's postings there, gives what it carries on."""

    def visit(carried: pa.Table, postings: pa.Table) -> pa.Table:
        some = postings if postings.num_rows else carried
        block, bundle = some["block"][0].as_py(), some["bundle"][0].as_py()
        lists = lambda t, c: [x.values.to_numpy() for x in t[c]]
        slots, held, scores = carried["slot"].to_numpy(), lists(carried, "ords"), lists(carried, "scores")
        at, places, tfs, sizes, weights = (*(lists(postings, c) for c in ("slots", "ords", "tfs", "sizes")), postings["weight"].to_pylist())
        used, docs = np.unique(np.concatenate([slots, *at])), 1 + max(int(p.max()) for p in [*held, *places])
        total, ahead = np.zeros((len(used), docs), np.int64), np.full(len(used), UNKNOWN)
        for k, o, x in zip(np.searchsorted(used, slots), held, scores, strict=True):
            total[k, o] = x
        for here, a in zip(at, lists(postings, "ahead"), strict=True):
            ahead[np.searchsorted(used, here)] = a
        for here, p, tf, size, weight in zip(at, places, tfs, sizes, weights, strict=True):
            tf, m = tf.astype(np.int64), 50 + (50 * size.astype(np.int64) * n) // length
            total[np.searchsorted(used, here)[:, None], p] += weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        out = []
        for s, own_ahead, row in zip(used.tolist(), ahead.tolist(), total, strict=True):
            own = np.flatnonzero(row)
            values = row[own]
            if len(own) > top:
                least = np.partition(values, len(values) - top)[len(values) - top]
                if last:  # of equal scores the smaller places stay, which are the smaller doc_ids
                    ok = values > least
                    ok[np.flatnonzero(values == least)[: top - int(ok.sum())]] = True
                else:
                    ok = values + MOST * own_ahead >= least
                own, values = own[ok], values[ok]
            if len(own):
                out.append((block, bundle, s, own.astype(np.int32), values))
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        return pa.table([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=["block", "bundle", "slot", "ords", "scores"])

    return visit


def ranked(docs: DataFrame, bench: DataFrame, top: int = TOP, block_docs: int = BLOCK_DOCS, owners: int = OWNERS) -> DataFrame:
    """item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    by_item = written(item_terms(bench), "item-terms")
    blocks = written(laid_out(docs, Filter(by_item.select("hash").distinct()), block_docs), "blocks")
    of_docs = blocks.where("term is null")
    n, length = of_docs.agg(F.coalesce(F.sum(F.size("docs").cast("long")), F.lit(0)), F.coalesce(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)), F.lit(0))).first()
    postings = blocks.where("term is not null").drop("docs").join(weighed(by_item, blocks, n, owners), "term").drop("term")
    path = new_path(spark, "owned-postings")
    postings.write.partitionBy("owner").parquet(path)
    owned = spark.read.schema(postings.schema).parquet(path)
    carried = spark.createDataFrame([], CARRIED)
    for k in range(owners):
        mine = owned.where(F.col("owner") == k).drop("owner")
        carried = carried.groupBy("block", "bundle").cogroup(mine.groupBy("block", "bundle")).applyInArrow(_visit(k == owners - 1, n, length, top), CARRIED)
    best = carried.select("block", (F.col("bundle") * BUNDLE + F.col("slot")).alias("item"), F.explode(F.arrays_zip("ords", "scores")).alias("x")).select("block", "item", F.col("x.ords").alias("ord"), F.col("x.scores").alias("score"))
    named = best.join(of_docs.select("block", F.posexplode("docs").alias("ord", "doc_id")), ["block", "ord"]).join(by_item.select("item", "item_id").distinct(), "item")
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the TOP documents of each benchmark item."""
    return ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT DISTINCT i, unnest(w) AS t FROM b),
whole AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
p AS (SELECT r, len(w) AS size, unnest(w) AS t FROM d),
tf AS (SELECT r, any_value(size) AS size, t, count(*) AS tf FROM p WHERE t IN (SELECT t FROM q) GROUP BY r, t),
weights AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, whole GROUP BY t),
scores AS (
  SELECT i, r, CAST(sum(weights.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * size * n) // l)))) AS BIGINT) AS score
  FROM q JOIN tf USING (t) JOIN weights USING (t), whole GROUP BY i, r),
ranked AS (SELECT i, r, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scores JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN b USING (i) WHERE rank <= 50
"""
