"""Approvals, supply-risk gates, standard items across periods, empirical-Bayes forecasts, policy effects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provisio.functions import flags, ladder, split_codes, stable_id

RANKS = {"NORMAL": 0, "WATCH": 1, "WARNING": 2, "CRITICAL": 3}


def supply_level(df: DataFrame, key: str, codes: str, rules: DataFrame) -> DataFrame:
    """The highest level of a row's supply codes; codes of the event or demand axis don't count; unknown codes call for review.
    rules: code, axis, level. CRITICAL stands only with override."""
    long = df.select(key, "override", F.explode_outer(split_codes(F.col(codes))).alias("code")).join(F.broadcast(rules), "code", "left")
    rank = ladder([(F.col("level") == k, v) for k, v in RANKS.items()], 0)
    g = long.groupBy(key).agg(F.max(F.when(F.col("axis") == "supply", rank)).alias("r"), F.bool_or(F.col("code").isNotNull() & F.col("axis").isNull()).alias("unknown"), F.bool_or("override").alias("override"))
    capped = F.when((F.col("r") == 3) & ~F.coalesce("override", F.lit(False)), 2).otherwise(F.coalesce("r", F.lit(0)))
    return g.select(key, ladder([(capped == v, k) for k, v in RANKS.items()]).alias("level"), F.coalesce("unknown", F.lit(False)).alias("needs_review"))


def anomalies(df: DataFrame, rules: Sequence[tuple[Column, str, str]], group: str, level: str) -> DataFrame:
    """An array of (rule, action) for each row: row rules, and one rule on groups whose rows disagree on the level."""
    split = df.groupBy(group).agg((F.count_distinct(level) > 1).alias("__split"))
    j = df.join(split, group)
    hits = F.array(*(F.when(c, F.struct(F.lit(r).alias("rule"), F.lit(a).alias("action"))) for c, r, a in [*rules, (F.col("__split"), "GROUP_LEVELS", "REVIEW")]))
    out = j.withColumn("issues", F.filter(hits, lambda x: x.isNotNull())).drop("__split")
    acts = F.transform("issues", lambda x: x["action"])
    return out.withColumn("quality_status", F.when(F.array_contains(acts, "BLOCK"), "BLOCK").when(F.array_contains(acts, "REVIEW"), "REVIEW").otherwise("PASS"))


def routed(df: DataFrame) -> DataFrame:
    return df.groupBy("quality_status").agg(F.count("*").alias("rows"), F.sum(F.size("issues")).alias("issues"))


def bulk_classified(df: DataFrame, key: str) -> DataFrame:
    """Strict rows win and may order by themselves; complete candidates are active if forecastable; the rest get pending ids."""
    c = F.col
    status = ladder([(c("strict"), "approved"), (c("complete") & c("forecastable"), "active"), (c("complete"), "inactive")], "pending")
    ident = F.when(c("complete") | c("strict"), F.concat_ws("::", "family", "subtype")).otherwise(stable_id("PENDING-", c(key).cast("string")))
    return df.withColumns({"class_status": status, "class_id": ident, "automatic_order": c("strict")})


def taxonomy(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Generated rows are replaced by the new ones; of one key the last stays."""
    both = old.where("not generated").withColumn("__o", F.lit(0)).unionByName(new.withColumn("__o", F.lit(1)))
    rest = F.struct(*(c for c in old.columns if c not in keys))  # of one key and load, the greatest row
    return both.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("__o"), F.desc(rest)))).where("__k = 1").drop("__k", "__o")


def latest_keys(df: DataFrame, key: Sequence[str], month: str) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(month)))).where("__k = 1").drop("__k")


def rule_approval(candidates: DataFrame, rules: DataFrame, keys: Sequence[str], gates: Sequence[tuple[Column, str]]) -> DataFrame:
    """Candidates meet rules on their keys; the first failed gate is the reason, none is approval."""
    j = candidates.join(rules.withColumn("__rule", F.lit(True)), list(keys), "left")
    bad = flags([(F.col("__rule").isNull(), "NO_RULE"), *gates])
    return j.withColumn("reason", F.coalesce(F.try_element_at(bad, F.lit(1)), F.lit("APPROVED"))).drop("__rule")


def unique_identity(df: DataFrame, tiers: Sequence[tuple[Sequence[str], float]], value: str) -> DataFrame:
    """Keys that have one identity only, tried from the most specific; unmatched rows have none."""
    out = df
    for k, (keys, _) in enumerate(tiers):
        one = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count_distinct(value).alias("__n"), F.min(value).alias(f"__i{k}")).where("__n = 1").drop("__n")
        out = out.join(one, list(keys), "left")
    return out.withColumns({"identity": F.coalesce(*(F.col(f"__i{k}") for k in range(len(tiers)))), "score": ladder([(F.col(f"__i{k}").isNotNull(), s) for k, (_, s) in enumerate(tiers)], 0.0)}).drop(*(f"__i{k}" for k in range(len(tiers))))


def standard_items(history: DataFrame, current: DataFrame) -> DataFrame:
    """history (key, strict, core), current (standard, strict, core): by strict name, else by a core name that has one standard item, else a fallback on the name."""
    strict = current.groupBy("strict").agg(F.min("standard").alias("s1"))
    core = current.groupBy("core").agg(F.count_distinct("standard").alias("n"), F.min("standard").alias("s2")).where("n = 1").drop("n")
    j = history.join(strict, "strict", "left").join(core, "core", "left")
    return j.select("key", F.coalesce("s1", "s2", F.concat(F.lit("NAME::"), "core")).alias("standard"), ladder([(F.col("s1").isNotNull(), "strict"), (F.col("s2").isNotNull(), "core")], "fallback").alias("method"), (F.col("s1").isNotNull() | F.col("s2").isNotNull()).alias("training_eligible"))


def occurrence_size(history: DataFrame, key: Sequence[str], pool: str, value: str) -> DataFrame:
    """Empirical-Bayes forecast: posterior share of months with demand times posterior log-normal size, pooled by `pool`."""
    v = F.col(value)
    some = F.when(v > 0, F.ln(v))
    s = history.groupBy(pool, *key).agg(F.count(v).alias("n"), F.count(some).alias("m"), F.avg(some).alias("mu"), F.var_samp(some).alias("s2"))
    rate = F.col("m") / F.col("n")
    p = s.groupBy(pool).agg((F.sum("m") / F.sum("n")).alias("p0"), F.var_samp(rate).alias("pv"), (F.sum(F.col("mu") * F.col("m")) / F.sum("m")).alias("m0"), F.avg("s2").alias("inner"), F.var_samp("mu").alias("outer"))
    spread = F.greatest(F.col("p0") * (1 - F.col("p0")) / F.greatest("pv", F.lit(1e-6)) - 1, F.lit(1.0))
    p = p.withColumn("strength", F.least(spread, F.lit(1000.0)))
    j = s.join(p, pool)
    occurs = (F.col("m") + F.col("p0") * F.col("strength")) / (F.col("n") + F.col("strength"))
    k = F.coalesce(F.try_divide("inner", "outer"), F.lit(1.0))
    size = (F.coalesce("mu", F.lit(0.0)) * F.col("m") + F.col("m0") * k) / (F.col("m") + k)
    return j.withColumns({"occurrence": occurs, "log_size": size, "forecast": occurs * F.exp(size + F.coalesce("inner", F.lit(0.0)) / 2)})


def quantile_mapped(df: DataFrame, share: Column, sample: DataFrame, value: str, steps: int = 1000) -> DataFrame:
    """The sample's quantile at 0.5 + 0.45 * share; quantiles come as one array of fixed length."""
    q = sample.agg(F.percentile(value, F.array(*(F.lit(k / steps) for k in range(steps // 2, steps)))).alias("__q"))
    at = F.least(F.floor((0.5 + 0.45 * share) * steps) - steps // 2, F.lit(steps // 2 - 1)).cast("int")
    return df.join(F.broadcast(q), F.lit(True)).withColumn("lead_quantile", F.element_at("__q", at + 1)).drop("__q")
