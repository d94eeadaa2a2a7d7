"""How well two views of the same things agree: reference clusters, frozen fields, halves of a history, signals and what follows them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provisio.functions import correlation, ladder
from provisio.operators.ordered import quantiles


def spearman(df: DataFrame, x: str, y: str) -> float | None:
    """Rank correlation with mean ranks for ties, by Spark's sort; null below two rows or without spread."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    if len(rows.head(2)) < 2:
        return None
    r = float(Correlation.corr(VectorAssembler(inputCols=["x", "y"], outputCol="v").transform(rows), "v", "spearman").first()[0].toArray()[0, 1])
    return r if r == r else None


def review_periods(gaps: DataFrame, key: str, gap: str, least: int = 5) -> DataFrame:
    """key, n, median_gap, credibility, review_period: medians of keys with `least` gaps, drawn towards the median of all gaps
    by the ratio of the spread within keys and between them.
    """
    stats = gaps.groupBy(key).agg(F.count(gap).alias("n"), F.var_samp(gap).alias("__v")).where(F.col("n") >= least)
    stats = stats.join(quantiles(gaps, [key], gap, {"median_gap": 0.5}), key)
    spread = stats.agg(F.avg("__v").alias("__within"), F.var_samp("median_gap").alias("__between"))
    grand = quantiles(gaps, [], gap, {"__grand": 0.5})
    ready = stats.join(F.broadcast(spread), F.lit(True)).join(F.broadcast(grand), F.lit(True))  # one row each
    k = F.coalesce(F.col("__within") / F.greatest(F.col("__between"), F.lit(1e-9)), F.lit(0.0))
    ready = ready.withColumn("credibility", F.col("n") / (F.col("n") + k))
    return ready.withColumn("review_period", F.col("credibility") * F.col("median_gap") + (1 - F.col("credibility")) * F.col("__grand")).select(key, "n", "median_gap", "credibility", "review_period")


def halves(gaps: DataFrame, key: str, gap: str, day: str, least: int = 2) -> DataFrame:
    """key, early, late: medians of the gaps up to the median day and after it, of keys with `least` gaps on both sides."""
    middle = quantiles(gaps, [], day, {"__middle": 0.5})
    rows = gaps.join(F.broadcast(middle), F.lit(True)).withColumn("__late", F.col(day) > F.col("__middle"))
    counts = rows.groupBy(key).agg(F.count_if("__late").alias("__l"), F.count_if(~F.col("__late")).alias("__e")).where((F.col("__l") >= least) & (F.col("__e") >= least)).select(key)
    medians = quantiles(rows, [key, "__late"], gap, {"m": 0.5}).groupBy(key).agg(F.max(F.when(~F.col("__late"), F.col("m"))).alias("early"), F.max(F.when(F.col("__late"), F.col("m"))).alias("late"))
    return medians.join(counts, key)


def reference_clusters(aliases: DataFrame, reference: DataFrame, key: str, cluster: str, ref: str) -> DataFrame:
    """aliases (key, cluster; a row per key), reference (key, ref). A row per key of either: status (matched, missing_reference,
    ambiguous_reference or reference_only), its ref where there is one, how many refs its cluster meets and how many
    clusters its ref meets, and the reason for attention. Keys with several refs take no part in the counts.
    """
    refs = reference.where(F.coalesce(F.col(ref), F.lit("")) != "").groupBy(key).agg(F.min(ref).alias("__ref"), (F.min(ref) < F.max(ref)).alias("__ambiguous"))
    j = aliases.select(key, cluster).join(refs, key, "full_outer")
    status = ladder([(F.col(cluster).isNull(), "reference_only"), (F.col("__ref").isNull(), "missing_reference"), (F.col("__ambiguous"), "ambiguous_reference")], "matched")
    j = j.select(key, cluster, status.alias("status"), F.when(~F.col("__ambiguous"), F.col("__ref")).alias(ref))
    pairs = j.where("status = 'matched'").select(cluster, ref).distinct()
    merged = pairs.groupBy(cluster).agg(F.count("*").alias("__refs")).withColumn("status", F.lit("matched"))
    split = pairs.groupBy(ref).agg(F.count("*").alias("__clusters")).withColumn("status", F.lit("matched"))
    out = j.join(merged, [cluster, "status"], "left").join(split, [ref, "status"], "left")
    n, m = F.coalesce("__refs", F.lit(0)), F.coalesce("__clusters", F.lit(0))
    reason = ladder([((n > 1) & (m > 1), "over_merge_and_split"), (n > 1, "over_merge"), (m > 1, "over_split")], "")
    return out.select(key, cluster, "status", ref, n.alias("refs_of_cluster"), m.alias("clusters_of_ref"), reason.alias("reason"))


def field_regression(baseline: DataFrame, integrated: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """field, matched, evaluated, rate, found: for each field and for all together, how many rows of the baseline (a row per key) have equal values in the integrated run; nulls are blanks, a missing key agrees in nothing."""
    text = lambda d, suffix: d.select(key, *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"{c}{suffix}") for c in fields))
    j = text(baseline, "__old").join(text(integrated, "__new").withColumn("__found", F.lit(True)), key, "left")
    found = F.coalesce("__found", F.lit(False))
    same = {c: found & (F.col(f"{c}__old") == F.col(f"{c}__new")) for c in fields}
    every = F.lit(True)
    for c in same.values():
        every = every & c
    checks = {**same, "all": every}
    g = j.agg(F.count("*").alias("evaluated"), F.count_if(found).alias("found"), *(F.count_if(c).alias(f"m_{n}") for n, c in checks.items()))
    long = g.select("evaluated", "found", F.inline(F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"m_{n}").alias("matched")) for n in checks))))
    return long.select("field", "matched", "evaluated", F.try_divide(F.col("matched"), F.col("evaluated")).alias("rate"), "found")


def two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal, by a rational approximation good to 1.5e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def partial_by_factor(rows: DataFrame, factor: str, month: str, x: str, v: str, least: int = 8) -> DataFrame:
    """rows (factor, month, x, v). For each factor with `least` months: n, raw and partial correlation of x with next month's v given this
    month's v, its p by Fisher's z and that p times the number of factors tested, at most 1. Without spread the partial one is null.
    """
    w = W.partitionBy(factor).orderBy(month)
    j = rows.withColumn("__y", F.lead(v).over(w)).where(F.col("__y").isNotNull() & F.col(v).isNotNull() & F.col(x).isNotNull())
    g = j.groupBy(factor).agg(F.count("*").alias("n"), correlation(x, "__y").alias("raw_r"), correlation(x, v).alias("__xv"), correlation("__y", v).alias("__yv")).where(F.col("n") >= least)
    a, c = F.col("__xv"), F.col("__yv")
    g = g.withColumn("partial_r", F.try_divide(F.col("raw_r") - a * c, F.sqrt((1 - a * a) * (1 - c * c))))
    z = F.atanh("partial_r") * F.sqrt(F.col("n") - 4)
    g = g.withColumn("p", two_sided(z))
    tested = g.agg(F.count("*").alias("__tested"))
    return g.join(F.broadcast(tested), F.lit(True)).select(factor, "n", "raw_r", "partial_r", "p", F.least(F.col("p") * F.col("__tested"), F.lit(1.0)).alias("bonferroni_p"))


def consolidated(masters: DataFrame, source: str, key: str, spare_key: str, products: str, attributes: str, filled: Sequence[str], blanks: Sequence[str] = ("", "[]", "not_provided")) -> DataFrame:
    """Attribute rows give their values, joined in order without repeats, to the product rows of the same key where those are
    blank; other rows stay, attribute rows go. The key is `key`, or `spare_key` where that is blank.
    """
    own = F.coalesce(F.when(F.trim(F.col(key)) != "", F.col(key)), F.col(spare_key), F.lit(""))
    rows = masters.withColumn("__key", own)
    given = rows.where((F.col(source) == attributes) & (F.trim("__key") != ""))
    parts = None  # distinct values first, so that a key with many repeats is small
    for c in filled:
        one = given.where(~F.coalesce(F.trim(F.col(c)), F.lit("")).isin(*blanks)).select("__key", F.lit(c).alias("__c"), F.trim(F.col(c)).alias("__v"))
        parts = one if parts is None else parts.unionByName(one)
    joined = parts.distinct().groupBy("__key").agg(*(F.array_join(F.array_sort(F.collect_list(F.when(F.col("__c") == c, F.col("__v")))), ";").alias(f"__{c}") for c in filled)).withColumn(source, F.lit(products))
    met = rows.where(F.coalesce(F.col(source), F.lit("")) != attributes).join(joined, ["__key", source], "left")
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")).isin(*blanks)
    return met.select(*(F.when((F.col(source) == products) & blank(c), F.coalesce(F.col(f"__{c}"), F.col(c))).otherwise(F.col(c)).alias(c) if c in filled else F.col(c) for c in masters.columns))


def folded_axis(rows: DataFrame, axis: Column, material: str, weight: str) -> DataFrame:
    """axis, material, weight, n, status: axes with one material get it and the median weight, others are conflicts with their materials listed; axes without a material are unmapped. Rows without an axis take no part."""
    keyed = rows.select(axis.alias("axis"), material, weight)
    known = keyed.where("axis is not null")
    counts = known.groupBy("axis").agg(F.count("*").alias("n"))
    kinds = known.select("axis", material).where(F.col(material).isNotNull()).distinct().groupBy("axis").agg(F.array_join(F.array_sort(F.collect_list(material)), ";").alias(material), F.count("*").alias("kinds"))
    out = counts.join(kinds, "axis", "left").join(quantiles(known, ["axis"], weight, {"weight": 0.5}), "axis", "left")
    one = F.col("kinds") == 1
    return out.select("axis", material, F.when(one, F.col("weight")).alias("weight"), "n", ladder([(one, "mapped"), (F.col("kinds") > 1, "conflict")], "unmapped").alias("status"))
