"""News queries: articles from documents, their events, and the risk that they mean for items by month."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio.operators import items as it
from provisio.operators import newschain as op
from provisio.operators import signals as sg
from provisio.plans import bindings as b
from provisio.plans import signals as ps
from provisio.registry import query
from provisio.sources import stored


def _case(c, values, default):
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v!r}" if not isinstance(v, str) or v.startswith("'") else f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {default} END"


def _root(*ws):
    return "CASE WHEN " + " AND ".join(f"{w} > 0" for w in ws) + f" THEN exp(({' + '.join(f'ln({w})' for w in ws)}) / {op.PARTS}) ELSE 0 END"


NEWS = """nw AS (SELECT doc_id AS article_id, DATE '2024-01-01' + CAST(doc_id % 366 AS INTEGER) AS date, text[:120] AS title, source, 'http://' || source || '.example/' || doc_id AS url FROM documents),
nn AS (SELECT * FROM nw WHERE trim(title) <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY date, article_id) = 1)"""
WORDS = f"""cw AS (SELECT doc_id AS article_id, list_distinct(string_split_regex(lower(coalesce(text, '')), '{sg.NOT_LETTERS}')) AS words FROM documents),
cc AS (SELECT article_id, CASE {' '.join(f"WHEN list_contains(words, '{a}') THEN '{c}'" for a, c in op.COUNTRIES)} ELSE 'Unknown' END AS country FROM cw)"""
ARTICLES = f"""{ps.CASCADE}, {WORDS},
ar AS MATERIALIZED (SELECT ca.article_id, DATE '2024-01-01' + CAST(ca.article_id % 366 AS INTEGER) AS date, source, branch, event_type, direction, demand_code, material_code, cues, country, CAST(severity AS DOUBLE) AS severity, 0.7 * (0.6 + 0.1 * least(len(cues), 3)) + 0.3 * completeness AS confidence,
  CASE {' '.join(f"WHEN regexp_matches(source, '{p}') THEN '{v}'" for p, v in sg.SOURCES)} ELSE 'unknown' END AS source_type, {_case('event_type', op.BUCKET, 'NULL')} AS bucket FROM ca JOIN cc USING (article_id)),
av AS (SELECT *, 1 / sqrt(count(*) OVER (PARTITION BY date, event_type, country, material_code)) AS novelty, exp(-ln(2.0::DOUBLE) * (last_day(date) - date) / {_case('event_type', op.HALF_LIFE, op.DEFAULTS['half_life'])}) AS recency FROM ar WHERE bucket IS NOT NULL AND direction <> 'down')"""
MAPPING = f"""mk AS (SELECT DISTINCT p_brand AS item, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS k FROM part),
mp AS (SELECT item, ({ps.Q(sg.CUES)})[k % {len(sg.CUES)} + 1] AS term, 'M' || (k % 7 + 1) || '; M' || ((k + 3) % 7 + 1) AS material_codes, CASE WHEN k % 3 = 1 THEN 'D1' ELSE 'D2;' END AS demand_codes, ({ps.Q([x[0] for x in sg.BRANCHES])})[k % {len(sg.BRANCHES)} + 1] AS related_material,
  (k % 10 + 1) / 10.0 AS weight, CASE WHEN k % 6 <> 0 THEN (k % 5) / 4.0 END AS exposure, k % 2 = 0 AS approved FROM mk),
mc AS (SELECT 'demand' AS path, trim(unnest(string_split(demand_codes, ';'))) AS code, * FROM mp UNION ALL SELECT 'material', trim(unnest(string_split(material_codes, ';'))), * FROM mp UNION ALL SELECT 'name', related_material, * FROM mp),
mm AS (SELECT DISTINCT path, code, item, term, weight, exposure, approved FROM mc WHERE code <> ''),
cwt AS (SELECT lower(n_name) AS n, n_nationkey AS k FROM nation), cn AS (SELECT unnest([{', '.join(f"'{c}'" for _, c in op.COUNTRIES[:-1])}]) AS country, unnest(range(1, {len(op.COUNTRIES)})) AS k), cx AS (SELECT country, 0.4 + 0.1 * (SELECT count(*) FROM cwt WHERE cwt.k % 6 = cn.k) AS country_weight FROM cn)"""
CHAIN = f"""{ARTICLES}, {MAPPING},
pa AS (SELECT av.*, CASE WHEN event_type = 'demand_increase' AND demand_code IN (SELECT code FROM mm WHERE path = 'demand') THEN 'demand' WHEN material_code IN (SELECT code FROM mm WHERE path = 'material') THEN 'material' WHEN branch IN (SELECT code FROM mm WHERE path = 'name') THEN 'name' WHEN event_type IN ({', '.join(f"'{e}'" for e in op.SUPPLY_WIDE)}) AND material_code IS NULL THEN 'wide' END AS path FROM av),
pc AS (SELECT *, CASE path WHEN 'demand' THEN demand_code WHEN 'material' THEN material_code WHEN 'name' THEN branch ELSE '{op.ALL_ITEMS}' END AS code, {_case('event_type', op.EVENT_WEIGHT, op.DEFAULTS['event'])} AS event_weight, {_case('source_type', op.SOURCE_WEIGHT, op.DEFAULTS['source'])} AS source_weight FROM pa WHERE path IS NOT NULL),
pw AS (SELECT pc.*, coalesce(country_weight, {op.DEFAULTS['country']}) AS country_weight FROM pc LEFT JOIN cx USING (country)),
xm AS (SELECT * FROM mm UNION ALL SELECT 'wide', '{op.ALL_ITEMS}', '{op.ALL_ITEMS}', NULL, 1.0, NULL, TRUE),
pairs AS (SELECT pw.*, item, weight, CASE WHEN exposure IS NULL THEN {op.DEFAULTS['exposure']} ELSE 0.3 + 0.7 * least(greatest(exposure, 0), 1) END AS exposure_weight, approved, CASE WHEN list_contains(cues, term) THEN {op.RELEVANCE['direct']} ELSE {_case('path', {k: v for k, v in op.RELEVANCE.items() if k != 'direct'}, 0)} END AS relevance FROM pw JOIN xm USING (path, code)),
sc AS (SELECT *, {_root('event_weight', 'severity', 'confidence', 'source_weight', 'relevance', 'weight', 'exposure_weight', 'country_weight', 'recency', 'novelty')} AS score FROM pairs),
sm AS (SELECT date_trunc('month', date)::DATE AS month, item, bucket, sum(score) AS s FROM sc GROUP BY 1, 2, 3), sk AS (SELECT bucket, quantile_cont(s, 0.9) AS scale FROM sm WHERE s > 0 GROUP BY 1),
sr AS (SELECT month, item, bucket, coalesce(1 - exp(-s / scale), 0) AS risk FROM sm LEFT JOIN sk USING (bucket)),
st AS (SELECT date_trunc('month', date)::DATE AS month, item, avg(confidence) AS confidence, count(*) AS articles, array_to_string(list_sort(list_distinct(list(event_type))), ';') AS events, bool_or(approved) AS approved FROM sc GROUP BY 1, 2),
sv AS (SELECT month, item, {', '.join(f"coalesce(max(risk) FILTER (WHERE bucket = '{k}'), 0) AS {k}_own" for k in op.BUCKETS)} FROM sr WHERE item <> '{op.ALL_ITEMS}' GROUP BY 1, 2),
sf AS (SELECT month, risk AS floor FROM sr WHERE item = '{op.ALL_ITEMS}' AND bucket = 'supply'),
sz AS (SELECT sv.month, sv.item, demand_own AS demand_news_risk, greatest(supply_own, coalesce(floor, 0)) AS supply_news_risk, supply_own, price_own AS price_news_risk, confidence, articles, events, approved FROM sv JOIN st USING (month, item) LEFT JOIN sf ON sf.month = sv.month)"""


def article_rows(spark, sf):
    d = b.table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"), "source", "text", F.expr("date_add(date'2024-01-01', cast(doc_id % 366 as int))").alias("date"))
    return d


def mapping(spark, sf):
    k = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    t = b.table(spark, sf, "part").select(F.col("p_brand").alias("item"), k.alias("k")).distinct()
    pick = lambda ws: F.element_at(F.array(*(F.lit(w) for w in ws)), F.col("k") % len(ws) + 1)
    code = lambda c: F.concat(F.lit("M"), c % 7 + 1)
    return t.select(
        "item", pick(sg.CUES).alias("term"), F.concat_ws("; ", code(F.col("k")), code(F.col("k") + 3)).alias("material_codes"), F.when(F.col("k") % 3 == 1, "D1").otherwise("D2;").alias("demand_codes"), pick([x[0] for x in sg.BRANCHES]).alias("related_material"),
        ((F.col("k") % 10 + 1) / 10.0).alias("weight"), F.when(F.col("k") % 6 != 0, (F.col("k") % 5) / 4.0).alias("exposure"), (F.col("k") % 2 == 0).alias("approved"),
    )


def country_weights(spark, sf):
    """All countries but the last, with a weight by how many nations stand for them."""
    n = b.table(spark, sf, "nation").groupBy((F.col("n_nationkey") % 6).alias("k")).agg(F.count("*").alias("n"))
    return n.where(F.col("k").between(1, len(op.COUNTRIES) - 1)).select(F.element_at(F.array(*(F.lit(c) for _, c in op.COUNTRIES)), F.col("k").cast("int")).alias("country"), (0.4 + 0.1 * F.col("n")).alias("country_weight"))


def risk(spark, sf):
    return op.item_news_risk(article_rows(spark, sf), "text", mapping(spark, sf), country_weights(spark, sf))


@query("src_news_normalise", f"WITH {NEWS} SELECT article_id, date, url, length(title) AS title_chars FROM nn")
def src_news(spark, sf):
    rows = it.news(b.table(spark, sf, "documents")).withColumn("title_chars", F.length("title").cast("long"))
    return it.normalized_news(rows, ["article_id", "date", "url", "title_chars"])


@query("news_event_classifier", f"WITH {ARTICLES} SELECT article_id, event_type, country, source_type, bucket, severity FROM ar")
def news_events(spark, sf):
    return op.articles(article_rows(spark, sf), "text").select("article_id", "event_type", "country", "source_type", "bucket", "severity")


@query("news_novelty_recency", f"WITH {CHAIN} SELECT date, event_type, country, path, code, count(*) AS n, round(any_value(novelty), 5) AS novelty, round(any_value(recency * 0 + {_root('event_weight', 'country_weight', 'recency', 'novelty')}), 5) AS scale FROM pw GROUP BY date, event_type, country, path, code, material_code, demand_code, branch")
def news_novelty(spark, sf):
    """Each event's cluster: how new it is, and the part of the score that its articles share."""
    out, _ = op.events(op.articles(article_rows(spark, sf), "text"), country_weights(spark, sf), op.mapping_paths(mapping(spark, sf)))
    w = F.sum("n").over(op.W.partitionBy("date", "event_type", "country", "material_code"))
    return out.withColumn("novelty", F.round(1 / F.sqrt(w), 5)).select("date", "event_type", "country", "path", "code", "n", "novelty", F.round("scale", 5).alias("scale"))


@query("news_article_scores", f"""WITH {CHAIN}, rw AS (SELECT *, {_root('event_weight', 'severity', 'confidence', 'source_weight', 'country_weight', 'recency', 'novelty')} AS part FROM pw),
rc AS (SELECT path, code, count(*) AS items, max({_root('weight', '(CASE WHEN exposure IS NULL THEN 0.6 ELSE 0.3 + 0.7 * least(greatest(exposure, 0), 1) END)')}) AS best FROM mm GROUP BY 1, 2)
SELECT article_id, rw.path, rw.code, round(part, 5) AS article_part, coalesce(items, 0) AS items, round(part * {_root(_case('rw.path', {k: v for k, v in op.RELEVANCE.items() if k != 'direct'}, 0))} * coalesce(best, exp(ln(0.6) / 10)), 5) AS best_score FROM rw LEFT JOIN rc ON rc.path = rw.path AND rc.code = rw.code""")
def news_scores(spark, sf):
    """A row per scored article with the items that it reaches as a count: pairs are never made."""
    out = op.article_reach(op.articles(article_rows(spark, sf), "text"), country_weights(spark, sf), op.mapping_paths(mapping(spark, sf)))
    return out.select("article_id", "path", "code", F.round("article_part", 5).alias("article_part"), "items", F.round("best_score", 5).alias("best_score"))


RISKS = ", ".join(f"round({k}_news_risk, 5) AS {k}_news_risk" for k in op.BUCKETS)


@query("news_saturating_monthly", f"WITH {CHAIN} SELECT month, item, {RISKS}, round(least(demand_news_risk + supply_news_risk + price_news_risk, 1), 5) AS total_news_risk, round(confidence + 1e-9, 5) AS confidence, articles, events, approved FROM sz")
def news_monthly(spark, sf):
    """From texts to the items' months: no article meets an item."""
    rounded = [*(f"{k}_news_risk" for k in op.BUCKETS), "total_news_risk"]
    near = F.round(F.col("confidence") + 1e-9, 5).alias("confidence")  # means of few articles often end in a 5
    return risk(spark, sf).select("month", "item", *(F.round(c, 5).alias(c) for c in rounded), near, "articles", "events", "approved")


@query("news_supply_wide", f"WITH {CHAIN} SELECT month, count(*) AS items, round(max(floor), 5) AS floor, count(*) FILTER (WHERE coalesce(floor, 0) > supply_own) AS raised FROM (SELECT sz.*, sf.floor FROM sz LEFT JOIN sf USING (month)) GROUP BY 1")
def news_wide(spark, sf):
    """How far each month's events for all supplies lift the items' own supply risk."""
    paths = op.mapping_paths(mapping(spark, sf))
    sums = stored(op.item_months(*op.events(stored(op.articles(article_rows(spark, sf), "text"), "news-articles"), country_weights(spark, sf), paths), paths), "news-sums")
    scale = op.quantiles(sums.where("score > 0"), ["bucket"], "score", {"scale": 0.9})
    r = sums.join(F.broadcast(scale), "bucket", "left").withColumn("risk", F.coalesce(1 - F.exp(-F.try_divide("score", "scale")), F.lit(0.0)))
    supply = F.max(F.when(F.col("bucket") == "supply", F.col("risk")))
    own = r.where(F.col("item") != op.ALL_ITEMS).groupBy("month", "item").agg(F.coalesce(supply, F.lit(0.0)).alias("own"))
    floor = r.where(F.col("item") == op.ALL_ITEMS).groupBy("month").agg(supply.alias("floor"))
    return own.join(floor, "month", "left").groupBy("month").agg(F.count("*").alias("items"), F.round(F.max("floor"), 5).alias("floor"), F.count_if(F.coalesce("floor", F.lit(0.0)) > F.col("own")).alias("raised"))
