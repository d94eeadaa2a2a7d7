"""The report of a run: counts of its parts, signals that say nothing, versions, and whether it may be released."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions import flags, ladder


def section(name: str, df: DataFrame, key: str, counts: dict[str, Column]) -> DataFrame:
    """One row: {name}_rows, {name}_items (distinct keys but null) and {name}_{count} of the rows that fulfil each condition.

    Rows are summed by key first, so no distinct count expands them and a key of any number of rows is summed before it is shuffled."""
    by = df.groupBy(key).agg(F.count("*").alias("rows"), *(F.count_if(c).alias(n) for n, c in counts.items()))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"{name}_{c}")
    return by.agg(total("rows"), F.count(key).alias(f"{name}_items"), *(total(n) for n in counts))


def spoken(name: str, df: DataFrame, signals: Sequence[str]) -> DataFrame:
    """One row: {name}_silent, the signals that are 0 or null in all rows, in the order told, joined by ;. An empty table is silent throughout."""
    some = df.agg(*(F.coalesce(F.bool_or(F.coalesce(F.col(s) != 0, F.lit(False))), F.lit(False)).alias(s) for s in signals))
    return some.select(F.array_join(flags([(~F.col(s), s) for s in signals]), ";").alias(f"{name}_silent"))


def versions(name: str, df: DataFrame, version: str) -> DataFrame:
    """One row: {name}_versions, the distinct versions but null, sorted and joined by ;."""
    return df.select(version).distinct().agg(F.array_join(F.array_sort(F.collect_set(version)), ";").alias(f"{name}_versions"))


def report(parts: Sequence[DataFrame], steps: Sequence[tuple[str, str]], else_: str = "released") -> DataFrame:
    """The parts, of one row each, as one row, with the state of the first step (condition, state) that holds on it. Columns that parts share are an error."""
    names = [c for p in parts for c in p.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"columns of several parts: {sorted({n for n in names if names.count(n) > 1})}")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    one = rows.agg(*(F.max(n).alias(n) for n in names))
    return one.withColumn("run_state", ladder([(F.expr(c), s) for c, s in steps], else_))
