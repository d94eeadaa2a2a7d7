"""URL filter: rules first, then a character language-model ratio.

Two smoothed variable-order Markov models, of accepted and of rejected urls, are counted over all urls that a
rule decides and that are not in the calibration fold. A character's probability blends orders 0 to ORDER:
each order's estimate is smoothed towards the next lower one in proportion to how rarely its context was
seen, so rare contexts fall back. Counts are exact: a table of character strings of ORDER + 1 bytes, whose ends
give the counts of the lower orders. Neither counts nor values are collected or broadcast beyond the two lowest
orders: urls stand in blocks, the distinct strings of a block meet their values in a join, and a block meets
its strings again. A url's score is the difference of log likelihoods per character; the threshold comes from
the calibration fold, as the cut with the best balanced accuracy there.

Defined results: null urls and urls without :// have empty host and path; the model reads the whole url, and
one without characters scores 0. With one class only, or none, every score is 0. Scores at the threshold are
allowed. Repeated rows count each time. Very long urls are read whole, an empty table gives an empty result. Only page_id and url are read,
whatever other columns there are. The threshold lies between two scores of a grid of hundredths, of several equally good ones at the middle
one; scores beyond ten, either way, count as ten there, and only there.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.llm.common import bounded_batches, table, written

# The rules, as (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
ORDER = 4
STRENGTH = 4.0
BINS = 1000  # on each side of 0, of width 0.01
BLOCK_BITS = 10  # a block has 1,024 rows at most


def split(url: Column) -> tuple[Column, Column]:
    """Host and path; without :// both are empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages (page_id, url) with host, path, rule and rule_verdict (null where no rule fits)."""
    host, path = split(F.col("url"))
    rows = pages.withColumns({"host": host, "path": path})
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is asked first
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rows.withColumns({"rule": rule, "rule_verdict": verdict})


def grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each character its string, the character as the lowest byte and the ORDER before it above; and its url's number.

    A url is read behind ORDER zero bytes, so that contexts at its start are its own.
    """
    sizes = np.fromiter((len(u) for u in urls), np.int64, len(urls))
    data = np.frombuffer(b"".join(b"\0" * ORDER + u for u in urls), np.uint8).astype(np.int64)
    own = np.ones(len(data), bool)
    starts = np.cumsum(sizes + ORDER) - (sizes + ORDER)
    for k in range(ORDER):
        own[starts + k] = False
    at = np.flatnonzero(own)
    found = data[at]
    for k in range(1, ORDER + 1):
        found |= data[at - k] << 8 * k
    return found, np.repeat(np.arange(len(urls)), sizes)


class Model:
    """counts: a row per string of a gram, with n0 accepted and n1 rejected."""

    def __init__(self, counts: DataFrame):
        self.counts = counts
        r = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
        self.totals = (r.n0 or 0, r.n1 or 0)
        self.whole = all(self.totals)

    def valued(self, wanted: DataFrame) -> DataFrame:
        """wanted (gram) with each one's value, the difference of its log probabilities."""
        out, p = wanted, [F.lit(1 / 256), F.lit(1 / 256)]
        for k in range(ORDER + 1):
            pair, context = f"pair{k}", f"context{k}"
            pairs = self.counts.groupBy(F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias(pair)).agg(*(F.sum(f"n{y}").alias(f"{pair}_{y}") for y in (0, 1)))
            own = F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1)
            out = out.withColumn(pair, own).join(F.broadcast(pairs) if k < 2 else pairs, pair, "left")  # 65,536 pairs of order 1 at most
            if k:
                contexts = pairs.groupBy(F.shiftright(pair, 8).alias(context)).agg(*(F.sum(f"{pair}_{y}").alias(f"{context}_{y}") for y in (0, 1)))
                out = out.withColumn(context, F.shiftright(pair, 8)).join(F.broadcast(contexts) if k < 3 else contexts, context, "left")
            seen = [F.coalesce(F.col(f"{context}_{y}"), F.lit(0)) if k else F.lit(self.totals[y]) for y in (0, 1)]
            blended = [((F.coalesce(F.col(f"{pair}_{y}"), F.lit(0)) + STRENGTH * p[y]) / (seen[y] + STRENGTH)).alias(f"p{y}") for y in (0, 1)]
            out = out.select("gram", *blended)
            p = [F.col("p0"), F.col("p1")]
        return out.select("gram", (F.log("p0") - F.log("p1")).alias("value"))

    def scores(self, urls: list[bytes]) -> np.ndarray:
        """Scores of a few urls, gathered."""
        spark = self.counts.sparkSession
        rows = _scored(spark.createDataFrame(list(enumerate(urls)), "k long, url binary"), self, ["k"])
        return np.array([r.llr for r in sorted(rows.collect(), key=lambda r: r.k)])


def fold(page_id: Column) -> Column:
    return F.coalesce(F.crc32(page_id.cast("string").cast("binary")) % 5, F.lit(1))


def learned(rows: DataFrame) -> Model:
    """rows: url (binary), label (0 accepted, 1 rejected)."""
    bounded_batches(rows.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, at = grams([u or b"" for u in b.column(0).to_pylist()])
            own, place = np.unique(found, return_inverse=True)
            label = b.column(1).to_numpy()[at]
            n = [np.bincount(place[label == y], minlength=len(own)) for y in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (own, *n)], ["gram", "n0", "n1"])

    found = rows.select("url", "label").mapInArrow(count, "gram long, n0 long, n1 long")
    return Model(written(found.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "url-counts"))


def _scored(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns to keep of each row, and llr."""
    bounded_batches(rows.sparkSession)
    if not model.whole:
        return rows.select(*keep, F.lit(0.0).alias("llr"))
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)
    blocks = written(rows.select(F.col("url").cast("binary").alias("__px_url"), *keep).withColumn("__px_block", block), "url-blocks")
    schema = rows.select(*keep).schema

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, at = grams([u or b"" for u in b.column(0).to_pylist()])
            of = b.column(1).to_numpy()[at]
            for k in np.unique(of):
                own = np.unique(found[of == k])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k)), pa.array(own)], ["block", "gram"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        urls = [u or b"" for u in left.column("__px_url").to_pylist()]
        found, at = grams(urls)
        own, value = right.column("gram").to_numpy(), right.column("value").to_numpy()
        order = np.argsort(own)
        values = value[order][np.searchsorted(own, found, sorter=order)] if len(found) else np.zeros(0)
        size = np.bincount(at, minlength=len(urls))
        return left.select(keep).append_column("llr", pa.array(np.bincount(at, values, len(urls)) / np.maximum(size, 1)))

    asked = blocks.select("__px_url", "__px_block").mapInArrow(strings, "block long, gram long")
    told = asked.join(model.valued(asked.select("gram").distinct()), "gram").select("block", "gram", "value")
    return blocks.groupBy("__px_block").cogroup(told.groupBy("block")).applyInArrow(score, schema.add("llr", "double"))


def calibrated(rows: DataFrame, model: Model) -> float:
    """The threshold with the best balanced accuracy on rows (url, label); accepted at or above it."""
    return cut(_scored(rows, model, ["label"]))


def cut(scored: DataFrame) -> float:
    """The same of rows (label, llr)."""
    bins = scored.select("label", F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.round(F.col("llr") * 100))).cast("int").alias("bin"))
    found = np.zeros((2, 2 * BINS + 1))
    for r in bins.groupBy("label", "bin").count().collect():
        found[int(r.label), r.bin + BINS] += r["count"]
    if not found.sum(axis=1).all():
        return 0.0
    share = found / found.sum(axis=1, keepdims=True)
    right = share[0][::-1].cumsum()[::-1] + np.append(0.0, share[1].cumsum()[:-1])
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float((best[len(best) // 2] - BINS) / 100 - 0.005)


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, llr: a row per row of pages."""
    rows = ruled(pages.select(F.col("page_id").cast("long"), "url"), rules)
    rows = rows.withColumns({"label": (F.col("rule_verdict") == "block").cast("int"), "fold": fold(F.col("page_id"))})
    model = learned(rows.where("rule_verdict is not null and fold <> 0").select(F.col("url").cast("binary").alias("url"), "label"))
    scored = written(_scored(rows, model, ["page_id", "host", "path", "rule", "rule_verdict", "label", "fold"]), "url-scores")
    threshold = cut(scored.where("label is not null and fold = 0"))
    by_model = F.when(F.col("llr") >= threshold, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_model).alias("verdict"), "llr")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
