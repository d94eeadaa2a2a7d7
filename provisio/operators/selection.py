"""Choices among candidates: weights, quotas, sources, mappings; and a token parser for names."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provisio.functions import first_filled, ladder


def history_weight(rows: DataFrame, key: Sequence[str], value: str, split: str, weights: Sequence[float]) -> DataFrame:
    """For each weight of historical months, the WAPE on validation months of the weighted mean of historical and training months."""
    h = F.col(split) == "historical"
    t = F.col(split) == "train"
    s = rows.groupBy(*key).agg(F.sum(F.when(h, F.col(value))).alias("hs"), F.count(F.when(h, F.col(value))).alias("hn"), F.sum(F.when(t, F.col(value))).alias("ts"), F.count(F.when(t, F.col(value))).alias("tn"))
    v = rows.where(F.col(split) == "validation").join(s, list(key)).withColumn("weight", F.explode(F.array(*(F.lit(float(w)) for w in weights))))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    p = F.coalesce(F.try_divide(F.col("weight") * z("hs") + z("ts"), F.col("weight") * F.col("hn") + F.col("tn")), F.lit(0.0))
    return v.groupBy("weight").agg((100 * F.sum(F.abs(p - F.col(value))) / F.sum(F.abs(value))).alias("wape"))


def dense_panel(fact: DataFrame, key: Sequence[str], value: str, first: str, months: int) -> DataFrame:
    """Every month from a series' first observation to the panel's end, absent months as 0."""
    start = F.lit(first).cast("date")
    end = F.add_months(start, months - 1)
    inside = fact.where(F.col("year_month").between(start, end)).select(*key, "year_month", value)
    own = inside.groupBy(*key).agg(F.min("year_month").alias("__from")).withColumn("year_month", F.explode(F.sequence(F.col("__from"), end, F.expr("interval 1 month")))).drop("__from")
    return own.join(inside, [*key, "year_month"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def quotas(counts: DataFrame, total: int, least: int) -> DataFrame:
    """counts (stratum, n), a small table: at least `least` each, the rest in proportion, never more than there are."""
    w = W.partitionBy()
    base = F.least(F.col("n"), F.lit(least))
    rest = F.lit(total) - F.sum(base).over(w)
    share = F.floor(rest * (F.col("n") - base) / F.greatest(F.sum(F.col("n") - base).over(w), F.lit(1)))
    return counts.withColumn("quota", F.least(F.col("n"), base + F.greatest(share, F.lit(0))).cast("long"))


def match_share(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Share of keys whose values agree, and the same with the mapping shifted by one key as a control."""
    j = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    c = a.select((F.col(key) + 1).alias(key), F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    one = lambda d, n: d.agg(F.avg((F.abs(F.col("x") - F.col("y")) <= tolerance).cast("double")).alias(n))
    return one(j, "matched").join(one(c, "control"), F.lit(True))


def composed(parts: Sequence[DataFrame], key: str, columns: Sequence[str]) -> DataFrame:
    """One-to-one join of several sources with equal keys; blanks are filled in the order of sources."""
    out = parts[0].select(key, *(F.col(c).alias(f"{c}__0") for c in columns))
    for k, p in enumerate(parts[1:], 1):
        out = out.join(p.select(key, *(F.col(c).alias(f"{c}__{k}") for c in columns)), key)
    return out.select(key, *(first_filled(*(F.col(f"{c}__{k}") for k in range(len(parts)))).alias(c) for c in columns))


def resolved_family(df: DataFrame, sources: Sequence[tuple[Column, str]]) -> DataFrame:
    """The first source that has a family; a conflict where later sources name another."""
    pick = ladder([(F.coalesce(c, F.lit("")) != "", c) for c, _ in sources], F.lit("UNRESOLVED"))
    by = ladder([(F.coalesce(c, F.lit("")) != "", n) for c, n in sources], "none")
    kinds = F.array_distinct(F.filter(F.array(*(c for c, _ in sources)), lambda x: x.isNotNull() & (x != "")))
    return df.withColumns({"family": pick, "family_source": by, "family_conflict": F.size(kinds) > 1})


def longest_prefix(c: Column, prefixes: Sequence[str]) -> Column:
    """The longest prefix that a digit follows."""
    return ladder([(c.rlike(f"^{p}[0-9]"), p) for p in sorted(prefixes, key=lambda p: (-len(p), p))], None)


TOKENS = (("concentration", r"\d+(?:\.\d+)?\s*%"), ("gauge", r"\d+\s*[gG]\b"), ("size", r"\d+\s*[x×]\s*\d+(?:\s*mm)?"), ("capacity", r"\d+(?:\.\d+)?\s*(?:ml|mL|L)\b"), ("strength", r"\d+(?:\.\d+)?\s*(?:mg|mcg|g|iu)\b"), ("pack", r"\d+\s*(?:ea|pcs|box)\b"))


def parsed(names: DataFrame, column: str) -> DataFrame:
    """Non-overlapping typed tokens of distinct names, earlier kinds first; what is left over; whether anything was found.
    It needs match offsets, so it runs as an Arrow batch function, on distinct names only."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns = [(k, re.compile(p)) for k, p in TOKENS]
        for batch in batches:
            out = []
            for name in batch[column]:
                taken: list[tuple[int, int, str, str]] = []
                for kind, p in patterns:
                    for m in p.finditer((name or "").replace(",", "")):
                        if all(m.end() <= a or m.start() >= b for a, b, _, _ in taken):
                            taken.append((m.start(), m.end(), kind, m.group()))
                left, at = [], 0
                for a, b, _, _ in sorted(taken):
                    left.append((name or "").replace(",", "")[at:a])
                    at = b
                left.append((name or "").replace(",", "")[at:])
                out.append((name, ";".join(f"{k}={re.sub(r'\\s+', '', t)}" for _, _, k, t in sorted(taken)), " ".join("".join(left).split()), "parsed" if taken else "plain"))
            yield pd.DataFrame(out, columns=[column, "tokens", "leftover", "readiness"])

    return names.select(column).distinct().mapInPandas(rows, f"{column} string, tokens string, leftover string, readiness string")
