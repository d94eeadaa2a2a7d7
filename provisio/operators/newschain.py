"""News risk of items by month, without a row for an article and an item.

A score is the geometric mean of ten weights. Seven belong to the article, two to the item, and one, how near the item is to the article,
depends on the way they meet and on whether the item's term is in the text. So an item's monthly sum is its own factor times sums
over articles: those are made by cluster, then by month and code (and term), and only they meet the items. The sum over all
articles of a code, less those with the item's term, counts at the way's relevance, the latter as a direct hit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provisio.functions import clip, ladder, split_codes
from provisio.operators.ordered import quantiles
from provisio.operators.signals import CUES, NOT_LETTERS, SOURCES, cascaded
from provisio.sources import stored

# Fixed values of the weighting.
COUNTRIES = (("thanea", "us"), ("eriner", "gb"), ("ersch", "de"), ("ément", "fr"), ("onouor", "jp"), ("ingor", "kr"))
EVENT_WEIGHT = {"demand_increase": 1.0, "supply_decrease": 0.9, "logistics": 0.7, "conflict": 0.8, "policy": 0.5, "price": 0.6}
HALF_LIFE = {"demand_increase": 14.0, "supply_decrease": 45.0, "conflict": 60.0}
SOURCE_WEIGHT = {"official": 1.0, "agency": 0.9, "journal": 0.85, "trade_press": 0.75, "blog": 0.4}
BUCKET = {"demand_increase": "demand", "supply_decrease": "supply", "logistics": "supply", "conflict": "supply", "policy": "supply", "price": "price"}
RELEVANCE = {"direct": 1.0, "material": 0.8, "name": 0.8, "demand": 0.7, "wide": 0.3}
SUPPLY_WIDE = ("supply_decrease", "logistics", "conflict", "policy")
DEFAULTS = {"event": 0.3, "half_life": 30.0, "source": 0.5, "country": 0.5, "exposure": 0.6}
BUCKETS = ("demand", "supply", "price")
ALL_ITEMS = "__ALL_ITEMS__"
PARTS = 10


def by_value(c: Column, values: Mapping[str, object], default: object) -> Column:
    return ladder([(c == k, v) for k, v in values.items()], default)


def articles(news: DataFrame, text: str, countries: Sequence[tuple[str, str]] = COUNTRIES) -> DataFrame:
    """news (date, source, text, ...) with the event cascade, country (that of the first alias in the text), source type and risk bucket; the text is looked through once and dropped."""
    wanted = F.array(*(F.lit(w) for w in dict.fromkeys([*CUES, *(a for a, _ in countries)])))
    out = news.withColumn("__hits", F.array_intersect(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), NOT_LETTERS), wanted)).drop(text)
    out = out.withColumn("country", ladder([(F.array_contains("__hits", a), c) for a, c in countries], "Unknown")).withColumn("__found", F.array_join("__hits", " "))
    out = cascaded(out, "__found").drop("__hits", "__found")
    return out.withColumns({"source_type": ladder([(F.col("source").rlike(p), v) for p, v in SOURCES], "unknown"), "bucket": by_value(F.col("event_type"), BUCKET, None)})


def mapping_paths(mapping: DataFrame) -> DataFrame:
    """mapping (item, material_codes, demand_codes, related_material, weight, exposure, term, approved), codes ;-joined: (path, code, item, weight, exposure, term, approved), of one path, code and item the heaviest row."""
    keep = ["item", "weight", "exposure", "term", "approved"]
    one = lambda path, codes: mapping.select(F.lit(path).alias("path"), F.explode(codes).alias("code"), *keep)
    rows = one("demand", split_codes(F.col("demand_codes"))).unionByName(one("material", split_codes(F.col("material_codes")))).unionByName(one("name", split_codes(F.col("related_material"))))
    best = F.max_by(F.struct("weight", "exposure", "term", "approved"), F.struct("weight", "exposure", "term", "approved"))
    return rows.groupBy("path", "code", "item").agg(best.alias("x")).select("path", "code", "item", "x.*")


def exposure_weight(c: Column) -> Column:
    return F.coalesce(0.3 + 0.7 * clip(c, 0, 1), F.lit(DEFAULTS["exposure"]))


def root(*weights: Column) -> Column:
    """The weights' part of a geometric mean of PARTS weights: 0 if one isn't positive."""
    ok = F.lit(True)
    for w in weights:
        ok = ok & F.coalesce(w > 0, F.lit(False))
    return F.when(ok, F.exp(sum((F.ln(F.when(w > 0, w)) for w in weights), F.lit(0.0)) / PARTS)).otherwise(0.0)


EVENT = ["date", "event_type", "bucket", "branch", "country", "demand_code", "material_code"]


def events(rows: DataFrame, country_weights: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows of articles(). Sums by event (what an article's cluster, code and bucket are told by) and by event and cue: (EVENT, path, code, scale, own, conf, n). country_weights (country, country_weight).

    A way counts if the mapping has its code: demand for outbreaks, then material, then the branch's name; what no code reaches is for all supplies.
    """
    told = rows.where(F.col("bucket").isNotNull() & (F.col("direction") != "down"))
    told = told.withColumn("own", root(F.col("severity"), F.col("confidence"), by_value(F.col("source_type"), SOURCE_WEIGHT, DEFAULTS["source"])))
    sums = [F.sum("own").alias("own"), F.sum("confidence").alias("conf"), F.count("*").alias("n")]
    by_event, by_term = told.groupBy(*EVENT).agg(*sums), told.withColumn("term", F.explode("cues")).groupBy(*EVENT, "term").agg(*sums)
    cluster = W.partitionBy("date", "event_type", "country", "material_code")
    age = F.datediff(F.last_day("date"), "date")
    recency = F.exp(-F.ln(F.lit(2.0)) * age / by_value(F.col("event_type"), HALF_LIFE, DEFAULTS["half_life"]))
    has = paths.select("path", "code").distinct()
    known = lambda path, column: has.where(F.col("path") == path).select(F.col("code").alias(column), F.lit(True).alias(f"__{path}"))
    out = by_event.withColumn("novelty", 1 / F.sqrt(F.sum("n").over(cluster))).join(country_weights.select("country", "country_weight"), "country", "left")
    out = out.join(known("demand", "demand_code"), "demand_code", "left").join(known("material", "material_code"), "material_code", "left").join(known("name", "branch"), "branch", "left")
    wide = F.col("event_type").isin(*SUPPLY_WIDE) & F.col("material_code").isNull()
    path = ladder([(F.col("__demand") & (F.col("event_type") == "demand_increase"), "demand"), (F.col("__material"), "material"), (F.col("__name"), "name"), (wide, "wide")], None)
    out = out.withColumn("path", path).where("path is not null").withColumn("code", by_value(F.col("path"), {"demand": F.col("demand_code"), "material": F.col("material_code"), "name": F.col("branch")}, ALL_ITEMS))
    out = out.withColumn("scale", root(by_value(F.col("event_type"), EVENT_WEIGHT, DEFAULTS["event"]), F.coalesce("country_weight", F.lit(DEFAULTS["country"])), recency, F.col("novelty")))
    out = stored(out.select(*EVENT, "path", "code", "scale", "own", "conf", "n"), "news-events")
    on = [out[c].eqNullSafe(by_term[c]) for c in EVENT]
    terms = by_term.join(out.select(*EVENT, "path", "code", "scale"), on).select(out["date"], out["bucket"], "path", "code", "scale", "term", by_term["own"])
    return out, terms


def item_months(by_event: DataFrame, by_term: DataFrame, paths: DataFrame) -> DataFrame:
    """(month, item, bucket, score, conf, n, events, approved): sums over articles, each met by an item through its article's one code."""
    month = F.trunc("date", "MM").alias("month")
    key = ["month", "bucket", "path", "code"]
    s = by_event.groupBy(month, "bucket", "path", "code").agg(F.sum(F.col("scale") * F.col("own")).alias("all"), F.sum("conf").alias("conf"), F.sum("n").alias("n"), F.collect_set("event_type").alias("events"))
    t = by_term.groupBy(month, "bucket", "path", "code", "term").agg(F.sum(F.col("scale") * F.col("own")).alias("direct"))
    everyone = by_event.sparkSession.createDataFrame([("wide", ALL_ITEMS, ALL_ITEMS, 1.0, None, None, True)], "path string, code string, item string, weight double, exposure double, term string, approved boolean")
    items = paths.unionByName(everyone).select("path", "code", "item", "term", "approved", root(F.col("weight"), exposure_weight(F.col("exposure"))).alias("factor"))
    near = root(by_value(F.col("path"), {k: F.lit(v) for k, v in RELEVANCE.items()}, F.lit(0.0)))
    direct = F.coalesce("direct", F.lit(0.0))
    score = F.col("factor") * (F.greatest(F.col("all") - direct, F.lit(0.0)) * near + direct * root(F.lit(RELEVANCE["direct"])))
    met = s.join(items, ["path", "code"]).join(t, [*key, "term"], "left")
    return met.groupBy("month", "item", "bucket").agg(F.sum(score).alias("score"), F.sum("conf").alias("conf"), F.sum("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("events")))).alias("events"), F.max("approved").alias("approved"))


def saturated(sums: DataFrame, q: float = 0.9) -> DataFrame:
    """A row per month and item: 1 - exp(-score / scale) of each bucket, the scale being the bucket's q-quantile of positive sums; their clipped sum, the articles' mean confidence, event types and whether a mapping was approved.

    What is for all supplies is a floor of every item's supply risk in its month, and no item.
    """
    sums = stored(sums, "news-item-months")
    scale = quantiles(sums.where("score > 0"), ["bucket"], "score", {"scale": q})  # a row per bucket
    r = sums.join(F.broadcast(scale), "bucket", "left").withColumn("risk", F.coalesce(1 - F.exp(-F.try_divide("score", "scale")), F.lit(0.0)))
    wide = F.max(F.when(F.col("bucket") == "supply", F.col("risk")))
    risk = [F.coalesce(F.max(F.when(F.col("bucket") == k, F.col("risk"))), F.lit(0.0)).alias(f"{k}_news_risk") for k in BUCKETS]
    told = [F.sum("conf").alias("conf"), F.sum("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("events")))).alias("events"), F.max("approved").alias("approved")]
    own = r.where(F.col("item") != ALL_ITEMS).groupBy("month", "item").agg(*risk, *told)
    floor = r.where(F.col("item") == ALL_ITEMS).groupBy("month").agg(wide.alias("floor"))
    out = own.join(floor, "month", "left").withColumn("supply_news_risk", F.greatest("supply_news_risk", F.coalesce("floor", F.lit(0.0)))).drop("floor")
    total = sum((F.col(f"{k}_news_risk") for k in BUCKETS), F.lit(0.0))
    return out.select("month", "item", *(f"{k}_news_risk" for k in BUCKETS), clip(total, 0, 1).alias("total_news_risk"), (F.col("conf") / F.col("n")).alias("confidence"), F.col("n").alias("articles"), F.array_join("events", ";").alias("events"), "approved")


def item_news_risk(news: DataFrame, text: str, mapping: DataFrame, country_weights: DataFrame) -> DataFrame:
    """The whole chain from articles to the items' months."""
    paths = stored(mapping_paths(mapping), "news-paths")
    rows = stored(articles(news, text), "news-articles")  # without texts
    return saturated(item_months(*events(rows, country_weights, paths), paths))


def article_reach(rows: DataFrame, country_weights: DataFrame, paths: DataFrame) -> DataFrame:
    """rows of articles() (article_id): (article_id, path, code, article_part, items, best_score): each scored article's own part of its scores, how many items it meets, and the best score among those that it doesn't name."""
    out, _ = events(rows, country_weights, paths)
    own = root(F.col("severity"), F.col("confidence"), by_value(F.col("source_type"), SOURCE_WEIGHT, DEFAULTS["source"]))
    told = rows.where(F.col("bucket").isNotNull() & (F.col("direction") != "down")).withColumn("own", own)
    met = told.join(out.select(*(F.col(c).alias(f"__{c}") for c in EVENT), "path", "code", "scale"), [told[c].eqNullSafe(F.col(f"__{c}")) for c in EVENT])
    near = root(by_value(F.col("path"), {k: F.lit(v) for k, v in RELEVANCE.items()}, F.lit(0.0)))
    reach = paths.groupBy("path", "code").agg(F.count("*").alias("items"), F.max(root(F.col("weight"), exposure_weight(F.col("exposure")))).alias("best"))
    part = F.col("scale") * F.col("own")
    j = met.join(reach, ["path", "code"], "left")
    return j.select("article_id", "path", "code", part.alias("article_part"), F.coalesce("items", F.lit(0)).alias("items"), (part * near * F.coalesce("best", root(F.lit(1.0), F.lit(DEFAULTS["exposure"])))).alias("best_score"))
