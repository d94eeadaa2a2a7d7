"""Relational contracts: checks that fail loudly, then hand the frame on. Each check is one action on keys alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def unique(df: DataFrame, keys: Sequence[str], label: str = "key") -> DataFrame:
    bad = duplicates(df, keys).limit(5).collect()
    if bad:
        raise ValueError(f"{label} is not unique, such as {[tuple(r)[:-1] for r in bad]}")
    return df


def required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    required(df, columns)
    r = df.agg(*(F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "").alias(c) for c in columns)).first()
    bad = {c: r[c] for c in columns if r[c]}
    if bad:
        raise ValueError(f"blank values: {bad}")
    return df


def joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    if validate in ("one_to_one", "many_to_one"):
        unique(right, on, "right side")
    if validate in ("one_to_one", "one_to_many"):
        unique(left, on, "left side")
    return left.join(right, list(on), how)


def with_match(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join with _merge: both, left_only, right_only."""
    j = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), list(on), "full_outer")
    return j.withColumn("_merge", F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")).drop("__l", "__r")


def mapped(df: DataFrame, mapping: DataFrame, key: str, to: str) -> DataFrame:
    """Both sides of the mapping are unique and filled, and every key of df is in it."""
    unique(filled(mapping, [key, to]), [key], key)
    unique(mapping, [to], to)
    missing = df.select(key).distinct().join(mapping.select(key), key, "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"no mapping for {[r[0] for r in missing]}")
    return df.join(mapping, key)
