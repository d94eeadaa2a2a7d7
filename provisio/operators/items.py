"""Item names, identities, approvals, materials and news."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provisio.functions import first_filled, flags, join_unique, ladder, single_or_blank, split_codes, stable_id


def _nfkc(form: str):
    @F.pandas_udf(T.StringType())
    def normal(texts: pd.Series) -> pd.Series:
        return texts.str.normalize(form)

    return normal


def clean_name(c: Column, form: str | None = "NFKC") -> Column:
    """Unicode-normal, single-spaced text. Spark has no NFKC, so give this distinct names; form None skips it."""
    c = _nfkc(form)(c) if form else c
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def match_key(c: Column, brackets: bool = False) -> Column:
    """Lower case, x for ×, p for a decimal point, no other signs; bracketed parts dropped on request."""
    c = F.lower(F.replace(c, F.lit("×"), F.lit("x")))
    c = F.regexp_replace(c, r"\([^()]*\)", " ") if brackets else c
    return F.regexp_replace(F.regexp_replace(c, r"(\d)\.(\d)", "$1p$2"), r"(?U)[^\w]+", "")


WRAPPERS = (r"^\s*\[[^\]]*\]\s*", r"\s*\(discontinued\)\s*$", r"^\s*new[-: ]+", r"\s*#\d+\s*$")


def strip_wrappers(c: Column, rounds: int = 3) -> Column:
    """Removals repeated a fixed number of rounds; an empty result falls back to the input."""
    out = c
    for _ in range(rounds):
        for w in WRAPPERS:
            out = F.regexp_replace(out, f"(?i){w}", "")
    return F.when(F.trim(out) != "", F.trim(out)).otherwise(c)


def first_rule(c: Column, rules: Sequence[tuple[str, object]], default: object = None) -> Column:
    """The first pattern that matches, in order."""
    return ladder([(c.rlike(f"(?i){p}"), v) for p, v in rules], default)


def specification(c: Column) -> Column:
    """Width x height, else a volume, else a gauge; thousands commas go first."""
    t = F.regexp_replace(c, r"(\d),(\d{3})", "$1$2")
    size, volume, gauge = F.regexp_extract(t, r"(?i)(\d+)\s*[x×*]\s*(\d+)", 0), F.regexp_extract(t, r"(?i)(\d+(?:\.\d+)?)\s*ml", 1), F.regexp_extract(t, r"(?i)(\d+)\s*g\b", 1)
    return ladder([(size != "", F.regexp_replace(F.lower(size), r"\s*[x×*]\s*", "x")), (volume != "", F.concat(volume, F.lit("mL"))), (gauge != "", F.concat(gauge, F.lit("G")))], "")


def strengths(c: Column) -> Column:
    """All strengths; gauges are masked first so that no match overlaps one."""
    masked = F.regexp_replace(c, r"(?i)\b\d+\s*G\b", " ")
    return F.array_join(F.regexp_extract_all(masked, F.lit(r"(?i)(\d+(?:\.\d+)?\s*(?:mg|mcg|iu|%))"), F.lit(1)), ";")


def alias_stats(rows: DataFrame, keys: Sequence[str], qty: str, date: str, department: str, order: Sequence[str]) -> DataFrame:
    """One row per alias: occurrences, usage, first and last date, the department first seen."""
    return rows.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.sum(F.coalesce(qty, F.lit(0.0))).alias("usage"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.min_by(department, F.struct(*order)).alias("department"))


def worklist(aliases: DataFrame, attributes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Products by hashed strict name, and the links from aliases. Of names, that with most occurrences, then the shortest, then the last."""
    links = aliases.withColumn("representative_id", stable_id("REP-", F.col("strict_name")))
    names = links.groupBy("representative_id", "name").agg(F.sum("occurrences").alias("n"))
    best = names.groupBy("representative_id").agg(F.max_by("name", F.struct("n", -F.length("name"), "name")).alias("representative_name"))
    agg = links.groupBy("representative_id").agg(F.sum("occurrences").alias("occurrences"), F.count("*").alias("aliases"), *(single_or_blank(F.col(a)).alias(a) for a in attributes), *((F.min(a) < F.max(a)).alias(f"{a}_differs") for a in attributes))
    conflict = F.lit(False)
    for a in attributes:
        conflict = conflict | F.coalesce(F.col(f"{a}_differs"), F.lit(False))
    return agg.join(best, "representative_id").withColumn("status", F.when(conflict, "conflict").otherwise("consistent")), links


def validated(rows: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """A row per broken rule and how often."""
    return rows.select(F.explode(flags(rules)).alias("rule")).groupBy("rule").agg(F.count("*").alias("rows"))


def tiered_match(items: DataFrame, master: DataFrame, tiers: Sequence[tuple[str, float]], code: str) -> DataFrame:
    """The first key (unique in the master) that meets, with its confidence; keys that are doubled in the master don't count."""
    out = items
    for k, _ in tiers:
        one = master.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"__{k}")).agg(F.count_distinct(code).alias("__n"), F.min(code).alias(f"__hit_{k}")).where("__n = 1").drop("__n")
        out = out.join(one, F.col(k) == F.col(f"__{k}"), "left").drop(f"__{k}")
    hits = [(F.col(f"__hit_{k}").isNotNull(), k, s) for k, s in tiers]
    out = out.withColumns({"matched_code": F.coalesce(*(F.col(f"__hit_{k}") for k, _ in tiers)), "match_method": ladder([(h, k) for h, k, _ in hits], "none"), "confidence": ladder([(h, s) for h, _, s in hits], 0.0)})
    return out.drop(*(f"__hit_{k}" for k, _ in tiers))


def rollup_approval(links: DataFrame, item: str, rep: str, approved: str, axes: Sequence[str]) -> DataFrame:
    """An item is approved when all its representatives are and they agree on one tuple of axes."""
    one = links.groupBy(item, rep, *axes).agg(F.max(F.col(approved).cast("int")).alias("__ok"))
    pairs = one.groupBy(item, rep).agg(F.max("__ok").alias("__ok"))
    g = pairs.groupBy(item).agg(F.count(rep).alias("representatives"), F.coalesce(F.sum(F.when(F.col(rep).isNotNull(), F.col("__ok"))), F.lit(0)).alias("approved_representatives"))
    g = g.join(one.select(item, *axes).distinct().groupBy(item).agg(F.count("*").alias("tuples")), item)
    return g.withColumn("is_approved", (F.col("representatives") == F.col("approved_representatives")) & (F.col("tuples") == 1))


def code_overlap(items: DataFrame, item: str, owners: DataFrame, owner: str) -> DataFrame:
    """items (item, codes: an array), owners (owner, code). owner and n, the items with one of its codes at least; owners that meet none are left out.

    Items with the same set of codes are counted together before they meet owners: the pairs are of owners and sets, not of owners and items.
    """
    whole = items.groupBy(item).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("__set"))  # an item may have several rows
    sets = whole.groupBy("__set").agg(F.count("*").alias("__n"))
    met = sets.select("__set", "__n", F.explode("__set").alias("code")).join(owners.select(owner, "code").distinct(), "code")
    return met.select(owner, "__set", "__n").distinct().groupBy(owner).agg(F.sum("__n").alias("n"))


def cluster_agreement(rows: DataFrame, current: str, reference: str) -> DataFrame:
    """Pairwise and B-cubed precision, recall and F1 from the contingency table, whose cells are summed before any pairing."""
    cell = rows.groupBy(current, reference).agg(F.count("*").cast("double").alias("n"))
    a = cell.groupBy(current).agg(F.sum("n").alias("a"))
    b = cell.groupBy(reference).agg(F.sum("n").alias("b"))
    j = cell.join(a, current).join(b, reference)
    pairs = lambda df, c: df.agg(F.sum(F.col(c) * (F.col(c) - 1) / 2).alias(f"p_{c}"))
    cubed = j.agg((F.sum(F.col("n") * F.col("n") / F.col("a")) / F.sum("n")).alias("b3_precision"), (F.sum(F.col("n") * F.col("n") / F.col("b")) / F.sum("n")).alias("b3_recall"))
    out = pairs(cell, "n").join(pairs(a, "a"), F.lit(True)).join(pairs(b, "b"), F.lit(True)).join(cubed, F.lit(True))
    f1 = lambda p, r: F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    out = out.withColumns({"precision": F.try_divide("p_n", "p_a"), "recall": F.try_divide("p_n", "p_b")})
    return out.withColumns({"f1": f1(F.col("precision"), F.col("recall")), "b3_f1": f1(F.col("b3_precision"), F.col("b3_recall"))}).drop("p_n", "p_a", "p_b")


def consensus(votes: DataFrame, key: str, value: str, voter: str) -> DataFrame:
    """The value that most voters give (ties: the smaller), its share, and whether there were several."""
    n = votes.groupBy(key, value).agg(F.count_distinct(voter).alias("n"))
    g = n.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), value)).alias("winner"), F.max("n").alias("votes"), F.sum("n").alias("all_votes"), F.count("*").alias("values"))
    return g.select(key, "winner", "votes", (F.col("votes") / F.col("all_votes")).alias("consensus"), (F.col("values") > 1).alias("multiple"))


def fill_blanks(df: DataFrame, other: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Left join that fills only what is blank."""
    o = other.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    return df.join(o, key, "left").withColumns({c: first_filled(F.col(c), F.col(f"__{c}")) for c in columns}).drop(*(f"__{c}" for c in columns))


def inverted_index(items: DataFrame, key: str, codes: str) -> DataFrame:
    return items.select(F.explode(split_codes(F.col(codes))).alias("code"), key).groupBy("code").agg(F.count_distinct(key).alias("items"))


def country_weights(flows: DataFrame, group: str, country: str, value: str, reach: float = 0.98, least: float = 0.01) -> DataFrame:
    """Countries of a group by value until the share before them reaches `reach`; shares under `least` go."""
    c = flows.groupBy(group, country).agg(F.sum(value).alias("v"))
    w = W.partitionBy(group)
    c = c.withColumn("share", F.col("v") / F.sum("v").over(w))
    before = F.sum("share").over(w.orderBy(F.desc("share"), country)) - F.col("share")
    return c.withColumn("before", before).where((F.col("before") < reach) & (F.col("share") >= least)).drop("before")


# ---- news

def news(docs: DataFrame) -> DataFrame:
    """Documents as articles: the first 120 characters are the title, each has a url of its own."""
    return docs.select(F.col("doc_id").alias("article_id"), F.expr("date_add(date'2024-01-01', cast(doc_id % 366 as int))").alias("date"), F.substring("text", 1, 120).alias("title"), "text", "source", F.concat(F.lit("http://"), "source", F.lit(".example/"), F.col("doc_id")).alias("url"))


def normalized_news(rows: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Blank titles and missing dates go; of one identity (url, else date, source and title) the first stays. Only the columns to keep are shuffled."""
    rows = rows.where(F.col("date").isNotNull() & (F.trim("title") != ""))
    ident = F.when(F.coalesce(F.col("url"), F.lit("")) != "", F.col("url")).otherwise(F.concat_ws("|", F.col("date").cast("string"), "source", "title"))
    first = F.min_by(F.struct(*(keep or rows.columns)), F.struct("date", "article_id"))
    return rows.groupBy(ident.alias("ident")).agg(first.alias("first")).select("first.*")


__all__ = ["join_unique"]
