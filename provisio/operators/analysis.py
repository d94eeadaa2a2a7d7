"""Lead times, review periods, ABC classes, and deterministic samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provisio.functions import ladder
from provisio.operators.ordered import running
from provisio.sources import stored


def lead_days(receipt: Column, due: Column, low: int = 0, high: int = 365) -> Column:
    d = F.datediff(due, receipt)
    return F.when(d.between(low, high), d)


def lead_summary(df: DataFrame, group: Sequence[str], lead: str = "lead") -> DataFrame:
    q = F.percentile(lead, F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75, 0.9))))
    out = df.where(F.col(lead).isNotNull()).groupBy(*group).agg(F.count(lead).alias("n"), F.avg(lead).alias("mean"), q.alias("q"))
    return out.select(*group, "n", "mean", *(F.col("q")[k].alias(n) for k, n in enumerate(("p25", "p50", "p75", "p90"))))


def gaps(df: DataFrame, key: Sequence[str], date: str, low: int = 1, high: int = 365) -> DataFrame:
    """Days since the previous event of the key, within bounds."""
    days = df.select(*key, date).distinct()
    out = days.withColumn("gap", F.datediff(F.col(date), F.lag(date).over(W.partitionBy(*key).orderBy(date))))
    return out.where(F.col("gap").between(low, high))


def shrunk_quantile(df: DataFrame, group: str, value: str, q: float = 0.75, least: int = 5) -> DataFrame:
    """Group quantiles shrunk to their mean by n / (n + k), k the ratio of inner to outer variance."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.percentile(value, F.lit(q)).alias("own"), F.var_samp(value).alias("s2")).where(F.col("n") >= least)
    t = g.agg(F.avg("s2").alias("inner"), F.var_samp("own").alias("outer"), F.avg("own").alias("grand")).withColumn("k", F.coalesce(F.try_divide("inner", "outer"), F.lit(0.0)))
    j = g.join(F.broadcast(t), F.lit(True)).withColumn("z", F.col("n") / (F.col("n") + F.col("k")))
    return j.select(group, "n", "own", (F.col("z") * F.col("own") + (1 - F.col("z")) * F.col("grand")).alias("shrunk"))


def target_encode(train: DataFrame, apply_to: DataFrame, key: str, target: str, prior: float = 20.0) -> DataFrame:
    """Smoothed means from the training rows; unseen keys get the overall mean. The keys' means are written first, so that the planner knows their size and rows are dealt out by key only where keys are many."""
    grand = train.agg(F.avg(target).alias("grand"))
    g = stored(train.groupBy(key).agg(F.avg(target).alias("m"), F.count(target).alias("n")), "means")
    out = apply_to.join(g, key, "left").join(F.broadcast(grand), F.lit(True))
    return out.withColumn("encoded", F.coalesce((F.col("m") * F.col("n") + F.col("grand") * prior) / (F.col("n") + prior), F.col("grand"))).drop("m", "n", "grand")


def abc(df: DataFrame, key: str, value: str, units: int = 100) -> DataFrame:
    """Pareto classes of keys by their summed value, the smaller key first where sums are equal.

    Values are summed as whole numbers of 1 / units (cents), so that sums, ties and shares don't hang on the order of addition."""
    whole = F.round(F.col(value) * units).cast("long")
    g = running(df.groupBy(key).agg(F.sum(whole).alias("__v")), "__v", [F.desc("__v"), F.col(key)])
    share = F.col("__cum") / F.col("__all")
    return g.select(key, (F.col("__v") / units).alias("v"), share.alias("share"), F.col("__pos").cast("int").alias("rank"), ladder([(share <= 0.8, "A"), (share <= 0.95, "B")], "C").alias("abc"))


def average_rank(df: DataFrame, value: str, into: str = "rank_share") -> DataFrame:
    """Average-rank percentile: values are counted first, so the running sum is over distinct values."""
    r = running(df.groupBy(value).agg(F.count("*").alias("__n")), "__n", [F.col(value)])
    share = (F.col("__cum") - F.col("__n") + (F.col("__n") + 1) / 2) / F.col("__all")
    return df.join(r.select(value, share.alias(into)), value)


def stratified(df: DataFrame, stratum: str, order: Sequence[Column], k: int, total: int) -> DataFrame:
    """k of each stratum in order, then the best of the rest up to total."""
    out = df.withColumn("__k", F.row_number().over(W.partitionBy(stratum).orderBy(*order))).where(F.col("__k") <= k + total)  # no more of a stratum can be chosen
    return out.orderBy((F.col("__k") > k).cast("int"), *order).limit(total).drop("__k")


def round_robin(df: DataFrame, stratum: str, order: Sequence[Column], total: int) -> DataFrame:
    out = df.withColumn("__k", F.row_number().over(W.partitionBy(stratum).orderBy(*order))).where(F.col("__k") <= total)
    return out.orderBy("__k", stratum).limit(total).drop("__k")


def hash_rank(c: Column) -> Column:
    """The first 64 bits of SHA-256, as a number."""
    return F.conv(F.substring(F.sha2(c.cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def half_usage_half_hash(df: DataFrame, stratum: str, usage: str, key: str, quota: int) -> DataFrame:
    w = W.partitionBy(stratum)
    out = df.withColumn("__u", F.row_number().over(w.orderBy(F.desc(F.abs(usage)), key)))
    top = (F.col("__u") <= quota // 2).cast("int")
    out = out.withColumn("__h", F.row_number().over(w.orderBy(F.desc(top), hash_rank(F.col(key)), key)))
    return out.where(F.col("__h") <= quota).drop("__u", "__h")


def prioritised(df: DataFrame, masks: Sequence[tuple[Column, str]], order: Sequence[Column], per: int) -> DataFrame:
    """Each row falls into its first category; the first `per` of each stay."""
    out = df.withColumn("category", ladder(masks)).where(F.col("category").isNotNull())
    return out.withColumn("k", F.row_number().over(W.partitionBy("category").orderBy(*order))).where(F.col("k") <= per)
