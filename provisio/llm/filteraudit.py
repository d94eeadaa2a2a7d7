"""Filter interaction audit by min-plus removal ranks.

Five filters fail a document or don't: five bits. A document that meets the filters in some order is removed by the first
that it fails. Over all masks of bits and all 120 orders that is one min-plus product: the mask matrix (0 where a filter
fails, infinity where not) with the matrix of inverse permutations (the position of each filter in each order). Its
entries are removal steps. Counted documents are scattered to the steps by mask; a filter that stands behind the step is
redundant for the mask.

Spark counts documents by part, mask and labels, so the matrices meet at most 128 cells a part. Whether a text is a copy is
decided without gathering copies: the least doc_id of each text comes from a combined minimum, and the rows that bear it
are met by text digest and doc_id together, so a text of which there are many copies is dealt out by doc_id.

Defined results: a null text is the empty text, a null source the part of the empty string. A null doc_id is neither
smaller nor larger than another: its row never fails E, and others don't fail by it. Rows that share the smallest
doc_id of a text all pass E. Rows of labels that share a doc_id count as one that has each label which one of them
has; null labels are none. Repeated rows count each. Very long texts count whole. An empty table gives no rows. Only doc_id, text
and source, and of labels doc_id, quality and toxic are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.llm.common import table

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 50, 65, 5, "[#$%&*|]"
COPY = 1 << FILTERS.index("E")
NEVER = np.iinfo(np.int64).max // 2


def failures(text: F.Column) -> F.Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    upper, points = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long"), F.length(text).cast("long")
    checks = (n < MIN_WORDS, distinct * 100 < n * DISTINCT_PERCENT, upper * 100 > points * UPPER_PERCENT, text.rlike(SYMBOLS))
    out = F.lit(0)
    for bit, failed in enumerate(checks):
        out = out + F.when(failed, 1 << bit).otherwise(0)
    return out.cast("int")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part and mask of failures, and how many of them are labelled so."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), failures(text).alias("mask"))
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).cast("int").alias(c)
    named = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic"))
    counted = (F.count("*").alias("n"), F.sum(F.coalesce("quality", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
    passing = rows.join(first, (rows["digest"] == first["digest"]) & (rows["doc_id"] == first["first"]), "left_semi").unionByName(rows.where("doc_id is null"))
    every = rows.join(named, "doc_id", "left").groupBy("part", "mask").agg(*counted)
    originals = passing.join(named, "doc_id", "left").groupBy("part", "mask").agg(*counted)
    # the documents of a cell that aren't originals are copies
    copies = originals.select("part", "mask", *((-F.col(c)).alias(c) for c in ("n", "good", "toxic"))).unionByName(every).withColumn("mask", F.col("mask") + COPY)
    return originals.unionByName(copies).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic"))).where("n > 0")


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix product in which sums are minima and products are sums."""
    return (a[:, :, None] + b[None]).min(axis=1)


def audit(masks: np.ndarray, weights: np.ndarray, n_filters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Orders as rows of filters; removed (orders, steps, weights) and redundant (orders, steps) of documents with these masks. weights: (masks, 1 or more); the first counts."""
    orders = np.array(list(permutations(range(n_filters))))
    positions = np.argsort(orders, axis=1).T  # of each filter in each order: inverse permutations
    fails = masks[:, None] >> np.arange(n_filters) & 1
    step = min_plus(np.where(fails, 0, NEVER), positions)  # (masks, orders)
    removed = np.zeros((len(orders), n_filters, weights.shape[1]), np.int64)
    redundant = np.zeros((len(orders), n_filters), np.int64)
    order = np.broadcast_to(np.arange(len(orders)), step.shape)
    gone = step < n_filters
    np.add.at(removed, (order[gone], step[gone]), np.repeat(weights[:, None], len(orders), axis=1)[gone])
    for f in range(n_filters):
        late = fails[:, f, None].astype(bool) & (positions[f] > step)
        np.add.at(redundant, (order[late], np.broadcast_to(positions[f], step.shape)[late]), np.broadcast_to(weights[:, :1], step.shape)[late])
    return orders, removed, redundant


def _rows(names: str) -> Callable[[pa.Table], pa.Table]:
    def part(cells: pa.Table) -> pa.Table:
        masks, weights = cells["mask"].to_numpy(), np.stack([cells[c].to_numpy() for c in ("n", "good", "toxic")], axis=1)
        k = len(names)
        orders, removed, redundant = audit(masks, weights, k)
        alone = np.array([weights[masks == 1 << f, 0].sum() for f in range(k)])
        shares = np.zeros(k, np.int64)
        np.add.at(shares, orders, removed[:, :, 0])
        kept = weights[:, 0].sum() - removed[:, :, 0].cumsum(axis=1)
        size = orders.size
        cols = {
            "part": pa.array([cells["part"][0].as_py()] * size, pa.string()), "filter_order": pa.array(np.repeat(["".join(names[f] for f in o) for o in orders], k)), "step": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))),
            "kept": kept, "removed": removed[:, :, 0], "redundant": redundant, "unique_fails": alone[orders], "good_lost": removed[:, :, 1], "toxic_lost": removed[:, :, 2], "shapley": shares[orders],
        }
        return pa.table({n: c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c).reshape(-1)) for n, c in cols.items()}).cast(SCHEMA)

    return part


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in COUNTS)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows per part."""
    found = cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.groupBy("part").applyInArrow(_rows(FILTERS), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, coalesce(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM w GROUP BY t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, row_number() OVER () AS r, [
    len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS f
  FROM w JOIN firsts USING (t) LEFT JOIN l USING (doc_id)),
orders AS (
  SELECT '' AS o UNION ALL SELECT o || x FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS letters(x) WHERE NOT contains(o, x)),
full_orders AS (SELECT o FROM orders WHERE length(o) = 5),
cells AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, f),
gone AS (
  SELECT part, o, f, n, good, toxic, list_min(list_filter([1, 2, 3, 4, 5], lambda s: f[ascii(o[s]) - 64])) AS removal FROM cells, full_orders),
steps AS (
  SELECT part, o, step, sum(CASE WHEN removal IS NULL OR removal > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN removal = step THEN n ELSE 0 END) AS removed, sum(CASE WHEN removal < step AND f[ascii(o[step]) - 64] THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN f[ascii(o[step]) - 64] AND len(list_filter(f, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN removal = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN removal = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM gone, (VALUES (1), (2), (3), (4), (5)) AS s(step) GROUP BY part, o, step)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley
FROM steps
"""
