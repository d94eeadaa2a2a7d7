"""Queries on document joins, title rules, official files, registries, update frames, bulk mappings, adaptive and what-if orders, samples, and scoring with saved models."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio.operators import forecast as fop
from provisio.operators import handoff as op
from provisio.operators import inventory as inv
from provisio.plans import bindings as b
from provisio.plans import features as fea
from provisio.plans import forecast as fo
from provisio.plans import inventory as pinv
from provisio.registry import query
from provisio.sources import new_path, stored

TOPICS, RISKS = ["and", "der", "les", "los", "with"], ["the", "die", "que", "to"]
Q = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"


@query("src_topic_documents", f"""WITH w AS (SELECT conv_id, text[:24] AS snippet, list_distinct(string_split_regex(lower(coalesce(text, '')), '{op.NOT_LETTERS}')) AS ws FROM conversations),
t AS (SELECT conv_id, snippet, list_intersect(ws, {Q(TOPICS)}) AS t, list_has_any(ws, {Q(RISKS)}) AS r FROM w),
f AS (SELECT conv_id, array_to_string(list_sort(list(DISTINCT topic)), ';') AS topics, coalesce(array_to_string(list_sort(list(DISTINCT topic) FILTER (WHERE r)), ';'), '') AS risky_topics FROM (SELECT conv_id, r, unnest(t) AS topic FROM t) GROUP BY 1),
s AS (SELECT conv_id, least(count(DISTINCT snippet), 12) AS snippets, min(snippet) AS first_snippet FROM t WHERE len(t) > 0 GROUP BY 1),
d AS (SELECT doc_id AS conv_id, lang, 'http://' || source || '.example/' || (2020 + doc_id % 6) || '/' || doc_id AS url, greatest(2020 + doc_id % 6, CASE WHEN doc_id BETWEEN 2000 AND 2099 THEN doc_id ELSE 0 END) AS y FROM documents WHERE lang <> 'es')
SELECT conv_id, topics, risky_topics, snippets, first_snippet, url FROM f JOIN s USING (conv_id) JOIN d USING (conv_id) WHERE risky_topics <> '' AND y >= 2023""")
def src_topics(spark, sf):
    """Conversations as the rows of documents, joined with a table of contents that is filtered by language and by the year in its urls."""
    d = b.table(spark, sf, "documents")
    toc = d.where("lang <> 'es'").select(F.col("doc_id").alias("conv_id"), F.concat(F.lit("http://"), "source", F.lit(".example/"), (2020 + F.col("doc_id") % 6).cast("string"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"))
    found = op.topic_documents(b.table(spark, sf, "conversations"), "conv_id", "text", TOPICS, RISKS)
    return found.join(toc, "conv_id").where(op.fresh(F.col("url"), F.lit("2024-06-01").cast("date"))).select("conv_id", "topics", "risky_topics", "snippets", "first_snippet", "url")


WORD = lambda *ws: f"(^|[^a-zà-ÿ])({'|'.join(ws)})([^a-zà-ÿ]|$)"
TITLE = {"negative": WORD("was", "nicht"), "clear": WORD("the", "der"), "vague": WORD("to", "de", "que"), "context": WORD("in", "la", "und")}
SUBJECTS = [(WORD("of", "die"), "supply"), (WORD("and", "les", "los"), "price"), (WORD("a", "en"), "policy")]


@query("src_title_classifier", f"""WITH p AS (SELECT url, date_trunc('month', DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER))::DATE AS month, regexp_extract(CASE WHEN page_id % 5 = 0 THEN '' ELSE html END, '<title>([^<]*)</title>', 1) AS t0, trim(regexp_replace(regexp_extract(url, '([^/?#]+)/?(?:[?#].*)?$', 1), '[-_.]+', ' ', 'g')) AS slug FROM pages),
t AS (SELECT url, month, lower(CASE WHEN trim(t0) <> '' THEN trim(t0) WHEN len(string_split(slug, ' ')) >= 3 THEN slug ELSE '' END) AS t FROM p),
k AS (SELECT url, month, CASE WHEN regexp_matches(t, '{TITLE['negative']}') THEN 'drop' WHEN NOT (regexp_matches(t, '{TITLE['clear']}') OR (regexp_matches(t, '{TITLE['vague']}') AND regexp_matches(t, '{TITLE['context']}'))) THEN 'none' {' '.join(f"WHEN regexp_matches(t, '{p}') THEN '{s}'" for p, s in SUBJECTS)} ELSE 'other' END AS subject FROM t),
o AS (SELECT url, min(row(month, subject)) AS x FROM k WHERE subject NOT IN ('drop', 'none') GROUP BY 1)
SELECT x[1] AS month, x[2] AS subject, count(*) AS n FROM o GROUP BY 1, 2""")
def src_titles(spark, sf):
    html = F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("html"))
    p = b.table(spark, sf, "pages").select("url", F.trunc(F.expr("date_add(date'2024-01-01', cast(page_id % 366 as int))"), "MM").alias("month"), op.title_class(op.title_of(html, F.col("url")), **TITLE, subjects=SUBJECTS).alias("subject"))
    one = p.where("subject not in ('drop', 'none')").groupBy("url").agg(F.min(F.struct("month", "subject")).alias("x"))
    return one.groupBy("x.month", "x.subject").agg(F.count("*").alias("n"))


@query("src_official_csv", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || ' 정' AS p_name FROM part")
def src_official(spark, sf):
    """Part names written in a legacy Korean encoding, and read by the validated loader, which finds the encoding."""
    path = new_path(spark, "official")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    b.table(spark, sf, "part").select(F.col("p_partkey").cast("string"), F.concat("p_name", F.lit(" 정")).alias("p_name")).write.option("encoding", "x-windows-949").csv(path, header=True)
    return op.official_csv(spark, path, ["p_partkey", "p_name"], 100)


@query("src_registry_scope", "SELECT n_nationkey, upper(chr(CAST(97 + n_nationkey % 26 AS INTEGER)) || chr(CAST(97 + n_regionkey AS INTEGER))) AS code FROM nation WHERE n_nationkey % 3 <> 0 AND n_regionkey < 3")
def src_registry(spark, sf):
    letter = lambda c: F.char(97 + c)
    n = b.table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit(" "), letter(F.col("n_nationkey") % 26), letter(F.col("n_regionkey"))).alias("code"), F.when(F.col("n_nationkey") % 3 == 0, "draft").otherwise("Approved ").alias("status"), F.when(F.col("n_regionkey") < 3, "customs").otherwise("other").alias("provider"))
    return op.registry(n, "code", "status", "customs").select("n_nationkey", "code")


@query("src_update_frame", "WITH h AS (SELECT p_partkey, p_retailprice AS mu, p_partkey % 4 <> 0 AS e, p_partkey % 9 = 0 AS r, CASE WHEN p_partkey % 5 = 0 THEN 'NOT_VERIFIED' WHEN p_partkey % 2 = 0 THEN 'ACTIVE' ELSE 'CENSORED' END AS demand_class FROM part) SELECT 'T' || p_partkey AS target_key, mu, demand_class FROM h WHERE e AND NOT r AND demand_class <> 'NOT_VERIFIED' AND mu >= 0")
def src_update(spark, sf):
    k = F.col("p_partkey")
    h = b.table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("mu"), (k % 4 != 0).alias("load_eligible"), (k % 9 == 0).alias("needs_review"), F.when(k % 5 == 0, "NOT_VERIFIED").when(k % 2 == 0, "ACTIVE").otherwise("CENSORED").alias("demand_class"))
    m = b.table(spark, sf, "part").select("p_partkey", F.concat(F.lit("T"), k.cast("string")).alias("target_key"))
    return op.update_frame(h, m, "p_partkey", "target_key", "mu", ["ACTIVE", "CENSORED"])


CLAIMS = "cm AS (SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS institution_code, p_brand AS item_code, p_type AS material, CASE p_size % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'X' END AS tier, p_size > 10 AS eligible_market, p_size > 20 AS eligible_trade, p_size > 30 AS eligible_news, p_size > 40 AS eligible_order FROM part JOIN supplier ON s_suppkey = p_partkey % 7 + 1)"


@query("cls_bulk_mapping", f"""WITH {b.FACT}, {CLAIMS}, l AS (SELECT institution_code, department, item_code, max(row(year_month, stock_item_key))[2] AS stock_item_key FROM fact GROUP BY 1, 2, 3)
SELECT stock_item_key, material, CAST(max(CASE tier WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.7 WHEN 'C' THEN 0.4 ELSE 0.0 END) AS DOUBLE) AS weight, bool_or(eligible_market) AS eligible_market, bool_or(eligible_trade) AS eligible_trade, bool_or(eligible_news) AS eligible_news, bool_or(eligible_order) AS eligible_order
FROM l JOIN cm USING (institution_code, item_code) GROUP BY 1, 2 HAVING max(CASE tier WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.7 WHEN 'C' THEN 0.4 ELSE 0.0 END) > 0""")
def cls_bulk(spark, sf):
    return bulk(spark, sf)[0]


def bulk(spark, sf):
    from provisio.plans import ledger as led

    p, s = b.table(spark, sf, "part"), b.table(spark, sf, "supplier")
    size = F.col("p_size")
    tier = F.element_at(F.array(*(F.lit(t) for t in "ABCX")), (size % 4 + 1).cast("int"))
    claims = p.join(s, F.col("s_suppkey") == F.col("p_partkey") % 7 + 1).select(F.col("s_nationkey").cast("string").alias("institution_code"), F.col("p_brand").alias("item_code"), F.col("p_type").alias("material"), tier.alias("tier"), (size > 10).alias("eligible_market"), (size > 20).alias("eligible_trade"), (size > 30).alias("eligible_news"), (size > 40).alias("eligible_order")).distinct()
    return op.bulk_mapping(led.fact(spark, sf), claims, "year_month")


@query("cls_bulk_mapping_counts", f"WITH {b.FACT}, {CLAIMS}, l AS (SELECT DISTINCT institution_code, department, item_code FROM fact) SELECT count(*) FILTER (WHERE material IS NULL) AS unmatched, count(material) AS matched FROM l LEFT JOIN cm USING (institution_code, item_code)")
def cls_bulk_counts(spark, sf):
    return bulk(spark, sf)[1]


LEAD = "ld AS (SELECT avg(x) AS m, stddev_samp(x) AS s FROM (SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS x FROM orders JOIN lineitem ON o_orderkey = l_orderkey) WHERE x BETWEEN 0 AND 365)"


@query("lt_adaptive_orders", f"""WITH {b.SERIES_FACT}, {LEAD}, mo AS (SELECT institution_code, item_code, avg(consumption_qty) AS demand_mean, stddev_samp(consumption_qty) AS demand_sd, count(consumption_qty) AS months FROM sfact GROUP BY 1, 2),
sn AS (SELECT institution_code, item_code, month_end_stock, coalesce(stockout_rate, 0) AS r FROM sfact WHERE year_month = (SELECT max(year_month) FROM sfact)),
x AS (SELECT *, m * (1 + 0.5 * r) + 14 * r AS lead, s * (1 + 0.5 * r) AS lsd, demand_mean / 30 AS d, demand_sd / sqrt(30) AS dsd, greatest(coalesce(month_end_stock, 0), 0) AS h FROM sn JOIN mo USING (institution_code, item_code), ld WHERE months >= 6 AND demand_mean > 0 AND demand_sd IS NOT NULL),
y AS (SELECT *, 1.645 * sqrt(lead * dsd * dsd + d * d * lsd * lsd) AS ss FROM x)
SELECT institution_code, item_code, round(lead, 4) AS lead_days, round(ss, 4) AS safety_stock, round(d * (30 + lead) + ss, 4) AS target_stock, round(greatest(d * (30 + lead) + ss - h, 0), 4) AS recommended_order, round(greatest(d * 45 * 1.2 - h, 0), 4) AS current_policy_order FROM y""")
def lt_adaptive(spark, sf):
    f = fea.fact(spark, sf)
    o, li = b.table(spark, sf, "orders"), b.table(spark, sf, "lineitem")
    days = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    lead = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(days.alias("x")).where("x between 0 and 365").agg(F.avg("x"), F.stddev_samp("x")).first()
    moments = f.groupBy(*fea.KEY).agg(F.avg("consumption_qty").alias("demand_mean"), F.stddev_samp("consumption_qty").alias("demand_sd"), F.count("consumption_qty").alias("months"))
    last = f.agg(F.max("year_month").alias("year_month"))
    snapshot = f.join(F.broadcast(last), "year_month").select(*fea.KEY, "month_end_stock", F.coalesce("stockout_rate", F.lit(0.0)).alias("supply_risk"))
    out = op.adaptive_orders(snapshot, moments, fea.KEY, float(lead[0] or 0), float(lead[1] or 0))
    return out.select(*fea.KEY, *(F.round(c, 4).alias(c) for c in ("lead_days", "safety_stock", "target_stock", "recommended_order", "current_policy_order")))


HASH = "(('0x' || sha256(CAST(p_partkey AS VARCHAR))[:16])::UBIGINT)"


@query("smp_approval_sample", f"""WITH r AS (SELECT p_partkey, p_size % 3 = 0 AS approved, p_retailprice AS usage, p_type AS reason FROM part), a AS (SELECT p_partkey, 'usage' AS picked_by FROM r WHERE approved ORDER BY usage DESC, p_partkey LIMIT 20),
k AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY {HASH}, p_partkey) AS k FROM r WHERE NOT approved), z AS (SELECT p_partkey, 'reason' AS picked_by FROM k ORDER BY k, reason LIMIT 20) SELECT * FROM a UNION ALL SELECT * FROM z""")
def smp_approval(spark, sf):
    r = b.table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 3 == 0).alias("approved"), F.col("p_retailprice").alias("usage"), F.col("p_type").alias("reason"))
    return op.approval_sample(r, "approved", "usage", "reason", "p_partkey", 40).select("p_partkey", "picked_by")


@query("smp_presentation", f"""WITH {pinv.PRED}, o AS (SELECT year_month, institution_code, item_code, base_stock, round(greatest(base_stock + risk_buffer - position, 0), 6) AS recommended_order FROM rec WHERE status = 'ACTIVE' AND year_month = DATE '2001-07-01'),
d AS (SELECT *, CASE WHEN recommended_order > 0 THEN 'ORDER' ELSE 'HOLD' END AS decision FROM o) SELECT institution_code, item_code, decision, row_number() OVER (PARTITION BY institution_code, decision ORDER BY recommended_order DESC, item_code) AS place FROM d QUALIFY place <= 5""")
def smp_show(spark, sf):
    r = inv.recommend(inv.gated_risks(pinv.predictions(spark, sf))).where("status = 'ACTIVE' and year_month = '2001-07-01'").withColumn("recommended_order", F.round("recommended_order", 6))
    base = F.col("predicted_usage") / 30 * (30 + F.col("lead_days")) * 1.2
    return op.presentation(r, "institution_code", "recommended_order", "base_stock", base, ["item_code"]).select("institution_code", "item_code", "decision", F.col("place").cast("long").alias("place"))


@query("srv_what_if_order", f"""WITH {fo.BASE}, g AS (SELECT CAST(n_nationkey AS VARCHAR) AS institution_code, n_nationkey * 10.0 AS stock, n_nationkey % 40 + 1.0 AS lead, 7.0 * (n_nationkey % 4 + 1) AS review, n_nationkey % 5 AS on_order, n_nationkey % 3 AS back FROM nation),
x AS (SELECT year_month, b.institution_code, item_code, rolling_mean_3_pred / 30 AS d, stock, lead, review, on_order, back, series_observation_count AS k FROM base b JOIN g USING (institution_code) WHERE year_month >= DATE '2001-06-01' AND series_observation_count % 13 <> 0)
SELECT {fea.ID}, round(d * (review + lead) * 1.2, 5) AS base_stock, round(stock + on_order - back, 5) AS position, lead AS lead_days FROM x""")
def srv_what_if(spark, sf):
    """Orders under given stock, lead and review values by institution; stale predictions take none."""
    n = F.col("n_nationkey")
    given = b.table(spark, sf, "nation").select(n.cast("string").alias("institution_code"), (n * 10.0).alias("current_stock"), (n % 40 + 1.0).alias("lead_time_days"), (7.0 * (n % 4 + 1)).alias("review_period_days"), (n % 5).cast("double").alias("on_order_qty"), (n % 3).cast("double").alias("backorder_qty"))
    r = inv.recommend(inv.gated_risks(op.what_if(pinv.predictions(spark, sf), given, ["institution_code"])))
    return r.select(*fea.IDS, *(F.round(c, 5).alias(c) for c in ("base_stock", "position")), "lead_days")


# ---- trained models


def _pipeline(estimator):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler

    return Pipeline(stages=[Imputer(inputCols=fo.NUMBERS, outputCols=[f"{c}_i" for c in fo.NUMBERS], strategy="median"), StringIndexer(inputCol="item_code", outputCol="item_index", handleInvalid="keep"), VectorAssembler(inputCols=[*(f"{c}_i" for c in fo.NUMBERS), "item_index"], outputCol="features"), estimator])


@query("for_hyper_grid")
def for_hyper(spark, sf):
    """Boosted trees of two depths over two rolling-origin folds without test rows: depth, folds, rows, WAPE over the folds, and the selected depth."""
    from pyspark.ml.regression import GBTRegressor

    rows = stored(fo.training_rows(spark, sf).where("split <> 'test'").select("year_month", "item_code", *fo.NUMBERS, "target_next_month", "weight"), "training")  # four fits and four scorings read it
    folds = [(a, z) for a, z in fo.FOLDS if z <= "2001-01-01"][-2:]
    out = None
    for depth in (2, 4):
        for a, z in folds:
            model = _pipeline(GBTRegressor(labelCol="target_next_month", weightCol="weight", lossType="absolute", maxIter=4, maxDepth=depth, maxBins=64, seed=1)).fit(rows.where(F.col("year_month") < F.add_months(F.lit(a).cast("date"), -1)))
            scored = model.transform(rows.where((F.col("year_month") >= a) & (F.col("year_month") < z))).select(F.lit(depth).alias("depth"), F.lit(a).alias("fold"), F.col("target_next_month").alias("y"), F.greatest("prediction", F.lit(0.0)).alias("p"))
            out = scored if out is None else out.unionByName(scored)
    m = out.groupBy("depth").agg(F.count_distinct("fold").alias("folds"), F.count("*").alias("rows"), (100 * F.try_divide(F.sum(F.abs(F.col("p") - F.col("y"))), F.sum(F.abs("y")))).alias("wape"))
    best = m.agg(F.min_by("depth", F.struct("wape", "depth")).alias("best"))
    return m.join(F.broadcast(best), F.lit(True)).select("depth", "folds", "rows", "wape", (F.col("depth") == F.col("best")).alias("selected"))


@query("for_batch_scoring")
def for_scoring(spark, sf):
    """Models are fitted and saved with a manifest; a batch loads each and adds its prediction, clipped at 0."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    rows = fo.training_rows(spark, sf)
    manifest = {}
    for name, estimator in (("boosted", GBTRegressor(labelCol="target_next_month", weightCol="weight", maxIter=3, maxDepth=3, maxBins=64, seed=1)), ("linear", LinearRegression(labelCol="target_next_month", weightCol="weight", regParam=0.1))):
        manifest[name] = new_path(spark, f"model-{name}")
        _pipeline(estimator).fit(rows.where("split in ('historical', 'train')")).write().save(manifest[name])
    return fop.batch_scored(rows.where("split = 'validation'"), {n: PipelineModel.load(p) for n, p in manifest.items()}).select(*fea.IDS, "target_next_month", *(f"{n}_pred" for n in manifest))
