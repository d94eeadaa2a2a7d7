"""Procurement requests landed as JSON lines, and the distribution of their lead times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.functions import clip

FORMATS = ("yyyy-MM-dd", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd")


def day(c: Column, formats: Sequence[str] = FORMATS) -> Column:
    """The date that a text says in one of the formats, else null."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats)).cast("date")


def read(spark: SparkSession, path: str, number: str, receipt: str, due: str, also: Sequence[str] = (), low: int = 0, high: int = 365) -> DataFrame:
    """number, receipt, due, lead_days and the other columns of the requests whose lead time is within the bounds.

    Lines that aren't JSON objects are left out; -- and blank read as null, columns that no line has are null. Of lines with one number, the earliest
    counts: the least receipt, then due, then the other columns, null last; lines without a number are one request. A request without both dates has no lead time.
    Each number keeps one row while it is grouped, however often it repeats."""
    names = [number, receipt, due, *also]
    raw = spark.read.schema(", ".join(f"`{n}` string" for n in names)).json(path, mode="DROPMALFORMED")
    told = [F.when(~F.trim(n).isin("", "--"), F.trim(n)).alias(n) for n in names]
    rows = raw.select(*told).select(F.col(number), day(F.col(receipt)).alias("receipt"), day(F.col(due)).alias("due"), *also)
    first = F.min(F.struct(*(x for c in ("receipt", "due", *also) for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c)))))
    one = rows.groupBy(number).agg(first.alias("x")).select(number, "x.receipt", "x.due", *(f"x.{c}" for c in also))
    lead = F.datediff("due", "receipt")
    return one.withColumn("lead_days", lead).where(lead.between(low, high))


def distribution(rows: DataFrame, keys: Sequence[str] = (), lead: str = "lead_days") -> DataFrame:
    """n, p10 to p90, mean_days and sd_days (of a sample; one request has none) by the keys.

    Days are counted first. The exact quantiles come from those counts, so a group of any size is at most as many rows as there are days within the bounds."""
    days = rows.where(F.col(lead).isNotNull()).groupBy(*keys, lead).agg(F.count("*").alias("c"))
    d, c = F.col(lead), F.col("c")
    q = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    out = days.groupBy(*keys).agg(F.sum("c").alias("n"), F.percentile(d, F.array(*map(F.lit, q.values())), c).alias("q"), F.sum(d * c).alias("s1"), F.sum(d * d * c).alias("s2"))
    n = F.col("n").cast("double")
    variance = F.try_divide(F.col("s2") - F.col("s1") * F.col("s1") / n, n - 1)
    return out.select(*keys, "n", *(F.col("q")[i].alias(k) for i, k in enumerate(q)), F.try_divide(F.col("s1").cast("double"), n).alias("mean_days"), F.sqrt(clip(variance, 0, None)).alias("sd_days"))
