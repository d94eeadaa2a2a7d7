"""Loads and hand-offs with their contracts: document joins, title rules, official CSV files, registries, update frames, bulk mappings, what-if orders, review and presentation samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provisio.functions import first_filled, ladder
from provisio.operators import contracts
from provisio.operators.analysis import hash_rank

NOT_LETTERS = "[^a-zà-ÿ]+"


def topic_documents(grams: DataFrame, key: str, text: str, topics: Sequence[str], risks: Sequence[str], snippets: int = 12, chars: int = 24) -> DataFrame:
    """Documents that have a topic beside a risk word in one of their rows: topics, risky_topics, and the first few distinct snippets in order."""
    lit = lambda ws: F.array(*(F.lit(w) for w in ws))
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), NOT_LETTERS)
    rows = grams.select(key, F.array_intersect(words, lit(topics)).alias("t"), F.arrays_overlap(words, lit(risks)).alias("r"), F.substring(text, 1, chars).alias("snippet"))
    found = rows.select(key, F.explode("t").alias("topic"), "r").groupBy(key, "topic").agg(F.bool_or("r").alias("r"))  # no more rows a document than topics
    found = found.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("topic")), ";").alias("topics"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("r"), F.col("topic")))), ";").alias("risky_topics")).where("risky_topics <> ''")
    some = rows.where(F.size("t") > 0).select(key, "snippet").distinct()
    some = some.withColumn("__k", F.row_number().over(W.partitionBy(key).orderBy("snippet"))).where(F.col("__k") <= snippets).groupBy(key).agg(F.count("*").alias("snippets"), F.min("snippet").alias("first_snippet"))
    return found.join(some, key)


def fresh(url: Column, observed: Column) -> Column:
    """Whether the greatest year in the url's path, if there is one, isn't older than the year before. Years are whole runs of four digits from 2000 on."""
    path = F.regexp_extract(url, "^[^/?#]*//[^/?#]*([^?#]*)", 1)
    year = F.array_max(F.transform(F.regexp_extract_all(path, F.lit(r"(?<![0-9])(20[0-9]{2})(?![0-9])"), 1), lambda y: y.cast("int")))
    return F.coalesce(year >= F.year(observed) - 1, F.lit(True))


def title_of(html: Column, url: Column, least: int = 3) -> Column:
    """The page's title, else the words of the url's last part if there are enough."""
    slug = F.trim(F.regexp_replace(F.regexp_extract(url, "([^/?#]+)/?(?:[?#].*)?$", 1), r"[-_.]+", " "))
    return first_filled(F.regexp_extract(html, "<title>([^<]*)</title>", 1), F.when(F.size(F.split(slug, " ")) >= least, slug))


def title_class(title: Column, negative: str, clear: str, vague: str, context: str, subjects: Sequence[tuple[str, str]]) -> Column:
    """drop in a negative context; the first subject where a clear word stands, or a vague one within its context; else none."""
    t = F.lower(title)
    event = t.rlike(clear) | (t.rlike(vague) & t.rlike(context))
    return ladder([(t.rlike(negative), "drop"), (~event, "none"), *((t.rlike(p), s) for p, s in subjects)], "other")


ENCODINGS = ("UTF-8", "x-windows-949", "EUC-KR")
SIGNATURES = {b"PK\x03\x04": "zip", b"\xd0\xcf\x11\xe0": "ole", b"%PDF": "pdf", b"PAR1": "parquet"}


def official_csv(spark: SparkSession, path: str, required: Sequence[str], least: int) -> DataFrame:
    """A headed CSV file in the first encoding that reads it without replacements; binary files, missing columns and too few rows are errors.
    Spark reads the legacy encodings only under spark.sql.legacy.javaCharsets, which is set for the session."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [there] if fs.getFileStatus(there).isFile() else [s.getPath() for s in fs.listStatus(there) if s.getPath().getName().startswith("part-")]
    for one in files:  # four bytes of each part
        stream = fs.open(one)
        head = bytes(b for b in (stream.read() for _ in range(4)) if 0 <= b < 256)
        stream.close()
        if head in SIGNATURES:
            raise ValueError(f"{one.getName()} of {path} is a {SIGNATURES[head]} file")
    for encoding in ENCODINGS:
        df = spark.read.csv(path, header=True, encoding=encoding)
        df = df.toDF(*(c.removeprefix("﻿") for c in df.columns))
        broken = df.agg(F.max(F.concat_ws("", *df.columns).contains("�").cast("int")), F.count("*")).first()
        if not broken[0] and not any("�" in c for c in df.columns):
            contracts.required(df, required)
            if broken[1] < least:
                raise ValueError(f"{path} has {broken[1]} rows, {least} are wanted")
            return df
    raise ValueError(f"{path} is in none of {ENCODINGS}")


def registry(df: DataFrame, code: str, status: str, provider: str | None = None, of: str = "provider") -> DataFrame:
    """Approved rows with upper-case two-letter codes, of one provider if asked for; a code that isn't so or repeats is an error."""
    rows = df.where(F.lower(F.trim(status)) == "approved").withColumn(code, F.upper(F.trim(code)))
    rows = rows.where(F.col(of) == provider) if provider else rows
    if bad := rows.where(~F.col(code).rlike("^[A-Z]{2}$")).head(1):
        raise ValueError(f"code {bad[0][code]!r}")
    return contracts.unique(rows, [code], "code")


def update_frame(handoff: DataFrame, mapping: DataFrame, key: str, target: str, value: str, classes: Sequence[str], strict: bool = True) -> DataFrame:
    """Rows to upsert: eligible, not under review, of a loadable class, finite and not negative, under the target's key. Strict: every row must map, and target keys be unique."""
    v = F.col(value).cast("double")
    rows = handoff.where(F.col("load_eligible") & ~F.col("needs_review") & F.col("demand_class").isin(*classes) & (v >= 0) & ~F.isnan(v) & (v < float("inf")))
    out = rows.join(mapping.select(key, target), key, "left")
    if strict:
        if bad := out.where(F.col(target).isNull()).select(key).head(1):
            raise ValueError(f"no target for {bad[0][0]}")
        contracts.unique(out, [target], "target")
    return out.where(F.col(target).isNotNull()).select(target, value, "demand_class")


TIER_WEIGHTS = {"A": 1.0, "B": 0.7, "C": 0.4}


def bulk_mapping(stock: DataFrame, claims: DataFrame, month: str) -> tuple[DataFrame, DataFrame]:
    """stock (institution_code, department, item_code, stock_item_key, month) and claims (institution_code, item_code, material, tier, flags eligible_*).

    Each series' latest key meets all claims of its institution and item; per key and material the best tier's weight stays. Also one row of counts.
    """
    latest = stock.groupBy("institution_code", "department", "item_code").agg(F.max_by("stock_item_key", F.struct(month, "stock_item_key")).alias("stock_item_key"))
    flags = [c for c in claims.columns if c.startswith("eligible_")]
    weight = ladder([(F.col("tier") == t, w) for t, w in TIER_WEIGHTS.items()], 0.0)
    j = latest.join(claims, ["institution_code", "item_code"], "left")
    met = j.where("material is not null").withColumn("weight", weight)
    out = met.groupBy("stock_item_key", "material").agg(F.max("weight").alias("weight"), *(F.bool_or(c).alias(c) for c in flags)).where("weight > 0")
    counts = j.agg(F.count_if(F.col("material").isNull()).alias("unmatched"), F.count_if(F.col("material").isNotNull()).alias("matched"))
    return out, counts


def adaptive_orders(snapshot: DataFrame, moments: DataFrame, key: Sequence[str], lead_mean: float, lead_sd: float, review: float = 30.0, z: float = 1.645, current: tuple[float, float] = (15.0, 0.2)) -> DataFrame:
    """Lead times that grow with supply risk, the target over review and lead, and the order beside that of the current fixed policy."""
    j = snapshot.join(moments.where("months >= 6 and demand_mean > 0 and demand_sd is not null"), list(key))
    risk = F.least(F.greatest(F.coalesce(F.col("supply_risk"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    lead, sd = lead_mean * (1 + 0.5 * risk) + 14.0 * risk, lead_sd * (1 + 0.5 * risk)
    daily, daily_sd = F.col("demand_mean") / 30, F.col("demand_sd") / F.sqrt(F.lit(30.0))
    safety = z * F.sqrt(lead * daily_sd * daily_sd + daily * daily * sd * sd)
    on_hand = F.greatest(F.coalesce(F.col("month_end_stock"), F.lit(0.0)), F.lit(0.0))
    fixed = daily * (review + current[0]) * (1 + current[1])
    return j.withColumns({"lead_days": lead, "safety_stock": safety, "target_stock": daily * (review + lead) + safety, "recommended_order": F.greatest(daily * (review + lead) + safety - on_hand, F.lit(0.0)), "current_policy_order": F.greatest(fixed - on_hand, F.lit(0.0))})


def approval_sample(df: DataFrame, approved: str, usage: str, reason: str, key: str, total: int) -> DataFrame:
    """Half approved rows by usage; of the others the first of each reason by hash, then more by hash up to total."""
    half = total // 2
    best = df.where(F.col(approved)).orderBy(F.desc(usage), key).limit(half).withColumn("picked_by", F.lit("usage"))
    rest = df.where(~F.col(approved)).withColumn("__k", F.row_number().over(W.partitionBy(reason).orderBy(hash_rank(F.col(key)), key))).where(F.col("__k") <= total - half)
    rest = rest.orderBy("__k", reason).limit(total - half).drop("__k").withColumn("picked_by", F.lit("reason"))
    return best.unionByName(rest)


def presentation(df: DataFrame, group: str, order: str, base: str, formula: Column, key: Sequence[str], per: int = 5) -> DataFrame:
    """Rows with a recomputed base that agrees within 1e-6, ORDER or HOLD, and the largest orders of each group and decision."""
    rows = df.where(F.abs(F.col(base) - formula) <= 1e-6).withColumn("decision", F.when(F.col(order) > 0, "ORDER").otherwise("HOLD"))
    w = W.partitionBy(group, "decision").orderBy(F.desc(order), *key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per)


def what_if(predictions: DataFrame, given: DataFrame, on: Sequence[str]) -> DataFrame:
    """predictions with the stock, lead and review values that are given; stale rows take none."""
    values = [c for c in given.columns if c not in on]
    return predictions.where("status <> 'STALE'").drop(*values).join(given, list(on))
