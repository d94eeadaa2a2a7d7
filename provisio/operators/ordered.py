"""Running sums and exact quantiles over any number of rows, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provisio.sources import new_path


def running(df: DataFrame, value: str, order: Sequence[Column], group: Sequence[str] = ()) -> DataFrame:
    """df with __cum (running sum of value in order within the group), __all (the group's total) and __pos (position).

    Rows are range-partitioned by group and order and written once, so no task holds a large group: each partition
    runs on its own, from where the sums of the group's parts before it (one row each) leave off.
    """
    path = new_path(df.sparkSession, "ranged")
    df.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    parts = rows.groupBy("__part", *group).agg(F.sum(value).alias("__s"), F.count("*").alias("__c"))
    whole = W.partitionBy(*group)
    before = whole.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("__part", *group, F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s0"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__c0"), F.sum("__s").over(whole).alias("__all"))
    w = W.partitionBy("__part", *group).orderBy(*order)
    on = rows["__part"] == parts["__part"]
    for g in group:
        on = on & rows[g].eqNullSafe(parts[g])
    out = rows.join(parts.hint("broadcast") if not group else parts, on)  # without groups, a row per partition
    out = out.drop(parts["__part"], *(parts[g] for g in group))
    return out.withColumns({"__cum": F.col("__s0") + F.sum(value).over(w), "__pos": F.col("__c0") + F.row_number().over(w)}).drop("__part", "__s0", "__c0")


def quantiles(df: DataFrame, group: Sequence[str], value: str, qs: dict[str, float]) -> DataFrame:
    """group and, under each name, the exact quantile of value with linear interpolation, as percentile() has it. Null values don't count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("__n"))
    run = running(counts, "__n", [F.col(value)], group)
    at = {name: F.lit(q) * (F.col("__all") - 1) for name, q in qs.items()}
    picks = [F.min(F.when(F.col("__cum") > f(p), F.col(value))).alias(f"__{name}_{side}") for name, p in at.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    got = run.groupBy(*group).agg(*picks, F.max("__all").alias("__all"))
    return got.select(*group, *((F.col(f"__{n}_low") + (F.col(f"__{n}_high") - F.col(f"__{n}_low")) * (p - F.floor(p))).alias(n) for n, p in at.items()))


def higher_quantiles(df: DataFrame, group: Sequence[str], value: str, q: float) -> DataFrame:
    """group, buffer (the empirical quantile that takes the higher neighbour) and n, the rows counted."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("__n"))
    run = running(counts, "__n", [F.col(value)], group)
    return run.where(F.col("__cum") >= F.ceil(F.lit(q) * (F.col("__all") - 1)) + 1).groupBy(*group).agg(F.min(value).alias("buffer"), F.max("__all").alias("n"))
