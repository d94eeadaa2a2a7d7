"""SimHash near-duplicate detection with pigeonring candidate filtering.

A fingerprint of 64 bits is cut into a ring of SEGMENTS. If two fingerprints differ in at most
DISTANCE bits, the pigeonring principle gives a segment from which every chain of consecutive segments
keeps its cumulative difference within its share DISTANCE * length / SEGMENTS of the budget.
With 5 segments and 4 bits: the first segment is equal, the first two differ in at most 1 bit, the
first three in at most 2, the first four in at most 3. The first two conditions make the join key (the
first segment and one half of the second, as one bit can spoil only one half); in every bucket the longer
chains prune what meets there, and the whole Hamming distance is checked last.

Distinct fingerprints meet in buckets; a bucket returns a spanning forest of its links, never its
pairs. In buckets over BLOCK rows the chain of three segments joins the key (two bits spoil at most two of the
third segment's three parts); what is still over BLOCK then is dealt out as pairs of blocks. Components are
found by alternating large-star and small-star steps on the forests' edges. The smallest neighbours of a step are
written before they are joined, so that AQE splits the node that a large component hangs on.

Defined results: a null or blank text has fingerprint 0, linked like any other. A null doc_id has its
fingerprint; it names no component but still belongs to one. Repeated rows repeat in the result. Very long texts
are hashed in chunks and count whole. An empty table gives an empty result. Only doc_id and text are read, whatever
other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provisio.llm.common import bounded_batches, dropped, written

DISTANCE = 4
WIDTHS = (13, 13, 13, 13, 12)
SEGMENTS = len(WIDTHS)
STARTS = (0, *accumulate(WIDTHS))[:SEGMENTS]
BLOCK = 4096
SMALL = 8
CHUNK = 1 << 16


def fingerprint(data: bytes | None, width: int = 4) -> int:
    """64 bits, as an unsigned number; bytes.lower and bytes.split know ASCII only, as the contract asks."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    text, sizes = b" ".join(words), [len(w) + 1 for w in words]
    ends = list(accumulate(sizes))
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    hashed = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        h = np.array([hashed(text[a : b - 1], 42) for a, b in zip(starts[at : min(at + CHUNK, n)], last[at : at + CHUNK], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(fps, pa.int64())], ["doc_id", *b.schema.names[2:], "fp"])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, the columns to keep, fp): a row per row of docs."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), *keep)
    return rows.mapInArrow(_fingerprints, rows.select("doc_id", *keep).schema.add("fp", "long"))


def _keys(fp) -> F.Column:
    """Two join keys for each start on the ring."""
    part = lambda at, n: F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1))
    out = []
    for i in range(SEGMENTS):
        j = (i + 1) % SEGMENTS
        low = WIDTHS[j] // 2
        for half, (at, n) in enumerate(((STARTS[j], low), (STARTS[j] + low, WIDTHS[j] - low))):
            out.append(F.lit((2 * i + half) << 26).cast("long") + F.shiftleft(part(STARTS[i], WIDTHS[i]), 13) + part(at, n))
    return F.array(*out)


def _sub_keys(key: F.Column, fp: F.Column) -> F.Column:
    """Three longer keys for a key: with each third of the segment after its two."""
    third = _third(fp, key)
    parts = ((0, 4), (4, 4), (8, 5))
    return F.array(*(F.shiftleft(key, 8).bitwiseOR(F.lit(k << 5)).bitwiseOR(F.shiftright(third, at).bitwiseAND((1 << n) - 1)) for k, (at, n) in enumerate(parts)))


def _third(fp: F.Column, key: F.Column) -> F.Column:
    """The third segment of the chain that a key starts."""
    start, out = F.shiftright(key, 27), F.lit(0).cast("long")
    for i in range(SEGMENTS):
        j = (i + 2) % SEGMENTS
        out = F.when(start == i, F.shiftrightunsigned(fp, STARTS[j]).bitwiseAND(F.lit((1 << WIDTHS[j]) - 1))).otherwise(out)
    return out


WHOLE = 0x7F  # the low byte of a key that has no third part
MASKS = np.array([((1 << w) - 1) << s for w, s in zip(WIDTHS, STARTS, strict=True)], np.uint64)


def _within(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which differences x keep every budget of the chain that key names, and the whole distance."""
    ok = np.ones(len(x), bool)
    start = (key >> 35).astype(np.int64)
    total = np.zeros(len(x), np.int64)
    for k in range(SEGMENTS):
        total += np.bitwise_count(x & MASKS[(start + k) % SEGMENTS])
        ok &= total * SEGMENTS <= DISTANCE * (k + 1)
    return ok


def _forest(fps: np.ndarray, start: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest over the links within fps whose chains from start keep their budgets.

    A link that breaks a budget here keeps them from another start, whose bucket has it.
    """
    left, out = fps, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            a = queue.pop()
            x, near, total = left ^ a, None, 0
            for k in range(1, SEGMENTS):  # chains of 2 segments and more; the first segment is equal
                total = total + np.bitwise_count(x & MASKS[(start + k) % SEGMENTS]).astype(np.int64)
                ok = np.flatnonzero(total * SEGMENTS <= DISTANCE * (k + 1))
                near = ok if near is None else near[ok]
                x, total = x[ok], total[ok]
                if not len(ok):
                    break
            if len(near):
                found = left[near]
                out.append((np.full(len(found), a), found))
                queue.extend(found)
                left = np.delete(left, near)
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, b1, b2, fp) sorted by the first three: links between fingerprints of equal key."""

    def solve(key: np.ndarray, same: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        # same: whether a row has the key of the one before it
        first = np.flatnonzero(~same)
        size = np.diff(np.append(first, len(fp)))
        pairs = [p for f, n in zip(first[size > SMALL], size[size > SMALL], strict=True) for p in _forest(np.unique(fp[f : f + n]), int(key[f]) >> 35)]
        group = np.repeat(np.arange(len(first)), size)
        few = np.repeat(size <= SMALL, size)
        for d in range(1, min(SMALL, int(size.max(initial=1)))):
            i = np.flatnonzero((group[:-d] == group[d:]) & few[d:])
            x = fp[i] ^ fp[i + d]
            i = i[(x != 0) & _within(x, key[i])]
            pairs.append((fp[i], fp[i + d]))
        if pairs:
            a, b = (np.concatenate(p).astype(np.uint64).view(np.int64) for p in zip(*pairs, strict=True))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])

    held: list[np.ndarray] = []
    for batch in batches:
        new = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        held.append(new)
        if len(new[0]) == 0 or (len(held) > 1 and (held[0][:3, :1] == new[:3, -1:]).all()):
            continue
        rows = np.concatenate(held, axis=1)
        same = np.append(False, (rows[:3, 1:] == rows[:3, :-1]).all(axis=0))
        cut = int(np.flatnonzero(~same)[-1])
        held = [rows[:, cut:]]
        yield from solve(rows[0, :cut], same[:cut], rows[3, :cut].view(np.uint64))
    if held:
        rows = np.concatenate(held, axis=1)
        same = np.append(False, (rows[:3, 1:] == rows[:3, :-1]).all(axis=0))[: rows.shape[1]]
        yield from solve(rows[0], same, np.ascontiguousarray(rows[3]).view(np.uint64))


def links(fps: DataFrame) -> DataFrame:
    """fps: distinct fingerprints (fp). Edges (u, v), u < v, that connect exactly what pairs within DISTANCE connect."""
    rows = fps.select(F.explode(_keys(F.col("fp"))).alias("key"), "fp")
    # hot and large are written, so that Spark sees their size: as a rule few keys or none, and then no shuffle
    hot = written(rows.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.lit(True).alias("hot")), "hot-keys")
    parts = rows.join(hot, "key").select(F.explode(_sub_keys(F.col("key"), F.col("fp"))).alias("key"))
    large = written(parts.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("long").alias("n")), "large-keys")
    keys = F.when(F.col("hot"), _sub_keys(F.col("key"), F.col("fp"))).otherwise(F.array(F.shiftleft("key", 8).bitwiseOR(F.lit(WHOLE))))
    rows = rows.join(hot, "key", "left").select(F.explode(keys).alias("key"), "fp")
    rows = rows.join(large, "key", "left").withColumn("b", F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), F.col("n"))))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("n") - 1, F.lit(0)))))
    rows = rows.select("key", F.least("b", "o").cast("long").alias("b1"), F.greatest("b", "o").cast("long").alias("b2"), "fp")
    dealt = rows.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")
    return dealt.mapInArrow(_links, "u long, v long").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, root): the smallest node reachable, for every node of edges (u, v).

    Large-star and small-star steps alternate until nothing changes; each round is written to the shared folder.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def large(e: DataFrame) -> DataFrame:
        down = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        m = written(e.unionByName(down).groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), f"{name}-least")
        out = written(down.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        dropped(m)
        return out

    def small(e: DataFrame) -> DataFrame:
        m = written(e.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least")
        moved = e.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = written(moved.unionByName(m.select("u", F.col("m").alias("v"))).distinct(), name)
        dropped(m)
        return out

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    now = written(edges, name)
    before = state(now)
    while before[0]:
        between = large(now)
        after_step = small(between)
        dropped(now)
        dropped(between)
        now, after = after_step, state(after_step)
        if after == before:
            break
        before = after
    return now.select("u", F.col("v").alias("root"))


def grouped(by_row: DataFrame) -> DataFrame:
    """by_row (doc_id, fp): (fp, least, root), a row per distinct fingerprint."""
    distinct = written(by_row.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct)).withColumnRenamed("u", "fp")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return written(named, "named-fingerprints")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): a row per row of docs."""
    by_doc = written(fingerprints(docs), "fingerprints")
    named = grouped(by_doc)
    ids = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")  # written, so that AQE splits a large component in the join
    return by_doc.join(named.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    from provisio.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that with the smallest doc_id and of these the smallest text digest; of the group's rows without doc_id, one too."""
    bounded_batches(spark)
    key = ["__px_text", "__px_row"]
    rows = docs.withColumns({"__px_text": F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")), "__px_row": F.xxhash64(F.col("doc_id").isNull(), *docs.columns)})
    by_row = written(fingerprints(rows, *key), "fingerprints")
    least = F.min(F.struct("doc_id", *key)).alias("least")
    firsts = by_row.groupBy("fp", F.col("doc_id").isNull().alias("nameless")).agg(least)
    firsts = firsts.join(grouped(by_row).select("fp", "root"), "fp").groupBy("root", "nameless").agg(F.min("least").alias("least"))
    return rows.join(firsts.select("least.__px_text", "least.__px_row"), key, "left_semi").dropDuplicates(key).drop(*key)
