"""Lead time, sampling, contract and serving queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio.functions import correlation
from provisio.operators import analysis as op
from provisio.operators.ordered import quantiles
from provisio.operators import contracts as rel
from provisio.operators import inventory as inv
from provisio.plans import bindings as b
from provisio.plans import features as fea
from provisio.plans import forecast as fo
from provisio.plans import inventory as pinv
from provisio.plans import risk as prisk
from provisio.registry import query
from provisio.sources import stored

R = lambda *cs: [F.round(c, 5).alias(c) for c in cs]
S = lambda *cs: ", ".join(f"round({c}, 5) AS {c}" for c in cs)
LEAD = """ld AS (SELECT l_orderkey, l_linenumber, l_partkey, p_brand, o_orderpriority, o_orderdate::DATE AS receipt, l_shipdate::DATE AS due, l_shipdate::DATE - o_orderdate::DATE AS d, l_extendedprice, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
le AS (SELECT *, d AS lead FROM ld WHERE d BETWEEN 0 AND 365)"""


def leads(spark, sf):
    li, o, p = (b.table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p, li["l_partkey"] == p["p_partkey"])
    j = j.withColumns({"receipt": F.col("o_orderdate").cast("date"), "due": F.col("l_shipdate").cast("date")})
    return j.withColumn("lead", op.lead_days(F.col("receipt"), F.col("due"))).where("lead is not null")


@query("lt_lead_summary", f"WITH {LEAD} SELECT o_orderpriority, count(*) AS n, round(avg(lead), 5) AS mean, quantile_cont(lead, 0.25) AS p25, quantile_cont(lead, 0.5) AS p50, quantile_cont(lead, 0.75) AS p75, round(quantile_cont(lead, 0.9), 5) AS p90 FROM le GROUP BY 1")
def lt_summary(spark, sf):
    return op.lead_summary(leads(spark, sf), ["o_orderpriority"]).withColumns({"mean": F.round("mean", 5), "p90": F.round("p90", 5)})


@query("lt_item_lag_statistics", f"WITH {LEAD}, a AS (SELECT p_brand, median(lead) AS m1 FROM le WHERE receipt < DATE '1998-01-01' GROUP BY 1 HAVING count(*) >= 5), c AS (SELECT p_brand, median(lead) AS m2 FROM le WHERE receipt >= DATE '1998-01-01' GROUP BY 1 HAVING count(*) >= 5) SELECT count(*) AS items, round(corr(m1, m2), 5) AS r FROM a JOIN c USING (p_brand)")
def lt_periods(spark, sf):
    x = leads(spark, sf)
    half = lambda cond, n: op.lead_summary(x.where(cond), ["p_brand"]).where("n >= 5").select("p_brand", F.col("p50").alias(n))
    j = half("receipt < '1998-01-01'", "m1").join(half("receipt >= '1998-01-01'", "m2"), "p_brand")
    return j.agg(F.count("*").alias("items"), F.round(correlation("m1", "m2"), 5).alias("r"))


@query("lt_restock_gaps", "WITH e AS (SELECT DISTINCT l_partkey, l_shipdate::DATE AS d FROM lineitem WHERE l_linenumber <= 3), g AS (SELECT l_partkey, d, d - lag(d) OVER (PARTITION BY l_partkey ORDER BY d) AS gap FROM e) SELECT l_partkey, count(*) AS n, median(gap) AS median_gap FROM g WHERE gap BETWEEN 1 AND 365 GROUP BY 1")
def lt_gaps(spark, sf):
    e = b.table(spark, sf, "lineitem").where("l_linenumber <= 3").withColumn("d", F.col("l_shipdate").cast("date"))
    return op.gaps(e, ["l_partkey"], "d").groupBy("l_partkey").agg(F.count("*").alias("n"), F.percentile("gap", F.lit(0.5)).alias("median_gap"))


@query("lt_shrunk_quantiles", f"WITH {LEAD}, g AS (SELECT p_brand, count(*) AS n, quantile_cont(lead, 0.75) AS own, var_samp(lead) AS s2 FROM le GROUP BY 1 HAVING count(*) >= 5), t AS (SELECT avg(s2) AS i, var_samp(own) AS o, avg(own) AS grand FROM g) SELECT p_brand, n, own, round(n / (n + coalesce(i / nullif(o, 0), 0)) * own + (1 - n / (n + coalesce(i / nullif(o, 0), 0))) * grand, 5) AS shrunk FROM g, t")
def lt_shrunk(spark, sf):
    return op.shrunk_quantile(leads(spark, sf), "p_brand", "lead").withColumn("shrunk", F.round("shrunk", 5))


@query("lt_estimator_pinball", f"""WITH {LEAD}, g AS (SELECT p_brand, avg(lead) AS mean, median(lead) AS p50, quantile_cont(lead, 0.9) AS p90 FROM le WHERE receipt < DATE '1999-01-01' GROUP BY 1),
x AS (SELECT lead, unnest(['mean', 'p50', 'p90', 'fixed']) AS estimator, unnest([mean, p50, p90, 15]) AS e FROM le JOIN g USING (p_brand) WHERE receipt >= DATE '1999-01-01')
SELECT estimator, count(*) AS n, round(avg(abs(lead - e)), 5) AS mae, round(avg(CAST(lead > e AS DOUBLE)), 5) AS under_rate, round(avg(greatest(0.9 * (lead - e), -0.1 * (lead - e))), 5) AS pinball FROM x GROUP BY 1""")
def lt_pinball(spark, sf):
    x = leads(spark, sf)
    g = x.where("receipt < '1999-01-01'").groupBy("p_brand").agg(F.avg("lead").alias("mean"), F.percentile("lead", F.lit(0.5)).alias("p50"), F.percentile("lead", F.lit(0.9)).alias("p90"))
    j = x.where("receipt >= '1999-01-01'").select("p_brand", "lead").join(g, "p_brand").withColumn("fixed", F.lit(15.0))
    long = j.unpivot(["lead"], ["mean", "p50", "p90", "fixed"], "estimator", "e")
    d = F.col("lead") - F.col("e")
    return long.groupBy("estimator").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(d)), 5).alias("mae"), F.round(F.avg((d > 0).cast("double")), 5).alias("under_rate"), F.round(F.avg(F.greatest(0.9 * d, -0.1 * d)), 5).alias("pinball"))


@query("lt_sensitivity", f"""WITH {pinv.PRED} SELECT CAST(v.lead AS INTEGER) AS lead, round(sum(greatest(predicted_usage / 30 * (30 + v.lead) * 1.2 - position, 0)), 3) AS total_order, count(*) FILTER (WHERE round(predicted_usage / 30 * (30 + v.lead) * 1.2 - position, 9) > 0) AS items_to_order FROM rec, (VALUES (7), (15), (30), (60)) v(lead) GROUP BY 1""")
def lt_sensitivity(spark, sf):
    rows = pinv.predictions(spark, sf).withColumn("lead", F.explode(F.array(*(F.lit(x) for x in (7, 15, 30, 60)))))
    base = F.col("predicted_usage") / 30 * (30 + F.col("lead")) * 1.2
    position = F.coalesce("current_stock", F.lit(0.0)) + F.col("on_order_qty") - F.col("backorder_qty")
    return rows.groupBy("lead").agg(F.round(F.sum(F.greatest(base - position, F.lit(0.0))), 3).alias("total_order"), F.count_if(F.round(base - position, 9) > 0).alias("items_to_order"))


@query("lt_variance_safety_stock", f"""WITH {pinv.STATUS} SELECT CAST(z AS DOUBLE) AS z, CAST(risk AS DOUBLE) AS risk, round(sum(z * sqrt(15 * (1 + risk) * sigma * sigma + mu * mu * 25)), 3) AS safety_total FROM st, (VALUES (1.2816), (1.6449)) a(z), (VALUES (0.0), (0.5), (1.0)) c(risk) GROUP BY 1, 2""")
def lt_variance(spark, sf):
    rows = pinv.status(spark, sf).select("mu", "sigma", F.explode(F.array(F.lit(1.2816), F.lit(1.6449))).alias("z")).withColumn("risk", F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))))
    ss = F.col("z") * F.sqrt(15 * (1 + F.col("risk")) * F.col("sigma") * F.col("sigma") + F.col("mu") * F.col("mu") * 25)
    return rows.groupBy("z", "risk").agg(F.round(F.sum(ss), 3).alias("safety_total"))


@query("lt_average_rank", "WITH n AS (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY l_quantity) - n AS before, sum(n) OVER () AS total FROM n) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((before + (n + 1) / 2) / total, 6) AS rank_share FROM lineitem JOIN r USING (l_quantity)")
def lt_rank(spark, sf):
    return op.average_rank(b.table(spark, sf, "lineitem"), "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("rank_share", 6).alias("rank_share"))


@query("lt_target_encoding", f"WITH {LEAD}, g AS (SELECT p_brand, avg(lead) AS m, count(*) AS n FROM le WHERE receipt < DATE '1999-01-01' GROUP BY 1), t AS (SELECT avg(lead) AS grand FROM le WHERE receipt < DATE '1999-01-01') SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce((m * n + grand * 20) / (n + 20), grand), 5) AS encoded FROM le LEFT JOIN g USING (p_brand), t WHERE receipt >= DATE '1999-01-01'")
def lt_encode(spark, sf):
    x = leads(spark, sf)
    return op.target_encode(x.where("receipt < '1999-01-01'"), x.where("receipt >= '1999-01-01'"), "p_brand", "lead").select("l_orderkey", "l_linenumber", "l_partkey", *R("encoded"))


@query("lt_long_lead_classifier")
def lt_classifier(spark, sf):
    """P(lead > 180) by boosted trees on target-encoded and calendar features; chronological split."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = leads(spark, sf).withColumns({"label": (F.col("lead") > 180).cast("double"), "month": F.month("receipt"), "log_price": F.log1p("l_extendedprice")})
    x = stored(x.select("l_orderkey", "l_linenumber", "p_brand", "l_quantity", "receipt", "lead", "label", "month", "log_price"), "leads")  # the fit reads it many times
    train = x.where("receipt < '1999-01-01'")
    make = VectorAssembler(inputCols=["encoded", "month", "log_price", "l_quantity"], outputCol="features")
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(make.transform(op.target_encode(train, train, "p_brand", "lead")))
    scored = model.transform(make.transform(op.target_encode(train, x.where("receipt >= '1999-01-01'"), "p_brand", "lead")))
    return scored.select("l_orderkey", "l_linenumber", "label", vector_to_array("probability")[1].alias("p_long"))


@query("lt_risk_lagged", f"WITH {LEAD}, m AS (SELECT date_trunc('month', receipt)::DATE AS month, avg(lead) AS mean_lead, quantile_cont(lead, 0.75) AS p75 FROM le GROUP BY 1), r AS (SELECT date_trunc('month', l_shipdate)::DATE AS month, avg(l_tax) AS risk FROM lineitem GROUP BY 1) SELECT CAST(k AS INTEGER) AS lag, round(corr(mean_lead, risk), 5) AS r, count(*) AS n FROM m, range(4) t(k), r WHERE r.month = m.month - to_months(CAST(k AS INTEGER)) GROUP BY 1")
def lt_lagged(spark, sf):
    m = leads(spark, sf).groupBy(F.trunc("receipt", "MM").alias("month")).agg(F.avg("lead").alias("mean_lead"))
    r = b.table(spark, sf, "lineitem").groupBy(F.trunc("l_shipdate", "MM").alias("month")).agg(F.avg("l_tax").alias("risk"))
    shifted = r.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("month", F.expr("add_months(month, lag)"))
    return m.join(shifted, "month").groupBy("lag").agg(F.round(correlation("mean_lead", "risk"), 5).alias("r"), F.count("*").alias("n"))


@query("lt_pooling_units", f"WITH {b.FACT}, g AS (SELECT CASE WHEN grouping(institution_code) = 0 AND grouping(item_code) = 0 THEN 'institution_item' WHEN grouping(item_code) = 0 THEN 'item' ELSE 'institution' END AS unit, institution_code, item_code, count(DISTINCT year_month) AS months, stddev_samp(consumption_qty) / nullif(avg(consumption_qty), 0) AS cv FROM fact GROUP BY GROUPING SETS ((institution_code, item_code), (item_code), (institution_code)))\nSELECT unit, count(*) AS groups, median(months) AS median_months, round(avg(CAST(months >= 12 AS DOUBLE)), 6) AS share_12, round(median(cv), 5) AS median_cv FROM g GROUP BY 1")
def lt_pooling(spark, sf):
    from provisio.plans import ledger as led

    fact = led.fact(spark, sf)
    g = spark.sql("""SELECT CASE WHEN grouping(institution_code) = 0 AND grouping(item_code) = 0 THEN 'institution_item' WHEN grouping(item_code) = 0 THEN 'item' ELSE 'institution' END AS unit, count(DISTINCT year_month) AS months, try_divide(stddev_samp(consumption_qty), avg(consumption_qty)) AS cv
      FROM {fact} GROUP BY GROUPING SETS ((institution_code, item_code), (item_code), (institution_code))""", fact=fact)
    counts = g.groupBy("unit").agg(F.count("*").alias("groups"), F.round(F.avg((F.col("months") >= 12).cast("double")), 6).alias("share_12"))
    middle = quantiles(g, ["unit"], "months", {"median_months": 0.5}).join(quantiles(g, ["unit"], "cv", {"median_cv": 0.5}), "unit", "left")
    return counts.join(middle, "unit").select("unit", "groups", "median_months", "share_12", F.round("median_cv", 5).alias("median_cv"))


@query("lt_abc_classes", "WITH g AS (SELECT l_partkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS c FROM lineitem GROUP BY 1), s AS (SELECT *, sum(c) OVER (ORDER BY c DESC, l_partkey) / sum(c) OVER () AS share, row_number() OVER (ORDER BY c DESC, l_partkey) AS rank FROM g) SELECT l_partkey, round(c / 100, 2) AS v, round(share, 6) AS share, CAST(rank AS INTEGER) AS rank, CASE WHEN share <= 0.8 THEN 'A' WHEN share <= 0.95 THEN 'B' ELSE 'C' END AS abc FROM s")
def lt_abc(spark, sf):
    return op.abc(b.table(spark, sf, "lineitem"), "l_partkey", "l_extendedprice").select("l_partkey", F.round("v", 2).alias("v"), F.round("share", 6).alias("share"), "rank", "abc")


@query("lt_quantile_policy_effect", f"WITH {LEAD}, g AS (SELECT p_brand, quantile_cont(lead, 0.25) AS p25 FROM le GROUP BY 1) SELECT cap, round(sum(least(coalesce(p25, 15), cap) * p_size), 3) AS total FROM part LEFT JOIN g USING (p_brand), (VALUES (15), (45), (90)) v(cap) GROUP BY 1")
def lt_policy(spark, sf):
    g = leads(spark, sf).groupBy("p_brand").agg(F.percentile("lead", F.lit(0.25)).alias("p25"))
    j = b.table(spark, sf, "part").join(g, "p_brand", "left").withColumn("cap", F.explode(F.array(*(F.lit(x) for x in (15, 45, 90)))))
    return j.groupBy("cap").agg(F.round(F.sum(F.least(F.coalesce("p25", F.lit(15.0)), F.col("cap")) * F.col("p_size")), 3).alias("total"))


@query("smp_stratified_refill", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) SELECT p_partkey, p_type FROM r ORDER BY CAST(k > 3 AS INTEGER), p_retailprice DESC, p_partkey LIMIT 30")
def smp_strata(spark, sf):
    return op.stratified(b.table(spark, sf, "part"), "p_type", [F.desc("p_retailprice"), F.asc("p_partkey")], 3, 30).select("p_partkey", "p_type")


@query("smp_round_robin", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) SELECT p_partkey, p_brand FROM r ORDER BY k, p_brand LIMIT 40")
def smp_robin(spark, sf):
    return op.round_robin(b.table(spark, sf, "part"), "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], 40).select("p_partkey", "p_brand")


@query("smp_usage_and_hash", "WITH u AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY abs(p_retailprice) DESC, p_partkey) AS u FROM part), h AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY CAST(u <= 5 AS INTEGER) DESC, sha256(CAST(p_partkey AS VARCHAR))[:16], p_partkey) AS h FROM u) SELECT p_partkey, p_type FROM h WHERE h <= 10")
def smp_hash(spark, sf):
    return op.half_usage_half_hash(b.table(spark, sf, "part"), "p_type", "p_retailprice", "p_partkey", 10).select("p_partkey", "p_type")


@query("smp_prioritised_review", "WITH c AS (SELECT *, CASE WHEN p_size > 45 THEN 'large' WHEN p_type = 'PROMO' THEN 'promo' WHEN p_retailprice > 1500 THEN 'dear' END AS category FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY p_partkey) AS k FROM c WHERE category IS NOT NULL) SELECT p_partkey, category, CAST(k AS INTEGER) AS k FROM r WHERE k <= 7")
def smp_review(spark, sf):
    return op.prioritised(b.table(spark, sf, "part"), [(F.col("p_size") > 45, "large"), (F.col("p_type") == "PROMO", "promo"), (F.col("p_retailprice") > 1500, "dear")], [F.asc("p_partkey")], 7).select("p_partkey", "category", "k")


@query("smp_scenario_expansion", f"WITH {pinv.PRED} SELECT year_month, institution_code, item_code, CAST(v.s AS DOUBLE) AS scenario, round(least(greatest(daily * (1 + 0.35 * v.s) * (30 + lead_days * (1 + 0.5 * v.s) + 14 * v.s) * (1.2 + 0.25 * v.s) - base_stock, 0), 0.75 * protection), 4) AS risk_buffer FROM rec0, (VALUES (0.0), (0.3), (0.6), (0.9)) v(s)")
def smp_scenarios(spark, sf):
    rows = pinv.predictions(spark, sf).withColumn("fused_risk", F.explode(F.array(*(F.lit(x) for x in (0.0, 0.3, 0.6, 0.9)))))
    return inv.recommend(inv.gated_risks(rows)).select(*fea.IDS, F.col("fused_risk").alias("scenario"), F.round("risk_buffer", 4).alias("risk_buffer"))


@query("rel_validated_join", "SELECT l_orderkey, l_linenumber, l_partkey, p_type FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def rel_join(spark, sf):
    p = b.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return rel.joined(b.table(spark, sf, "lineitem"), p, ["l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "p_type")


@query("rel_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def rel_duplicates(spark, sf):
    return rel.duplicates(b.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("rel_filled_columns", "SELECT p_partkey, p_name FROM part")
def rel_filled(spark, sf):
    return rel.filled(b.table(spark, sf, "part"), ["p_name", "p_brand"]).select("p_partkey", "p_name")


@query("rel_match_indicator", "SELECT coalesce(a.c_custkey, o.o_custkey) AS custkey, CASE WHEN a.c_custkey IS NULL THEN 'right_only' WHEN o.o_custkey IS NULL THEN 'left_only' ELSE 'both' END AS merge FROM customer a FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000) o ON a.c_custkey = o.o_custkey")
def rel_match(spark, sf):
    o = b.table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("custkey")).distinct()
    return rel.with_match(b.table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey")), o, ["custkey"]).select("custkey", F.col("_merge").alias("merge"))


@query("rel_key_mapping", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def rel_mapping(spark, sf):
    n = b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return rel.mapped(b.table(spark, sf, "supplier"), n, "s_nationkey", "n_name").select("s_suppkey", "n_name")


@query("srv_forecast_bands", f"WITH {fo.BASE} SELECT year_month, item_code, {S('rolling_mean_3_pred')}, round(0.5 * rolling_mean_3_pred, 5) AS q10, round(1.5 * rolling_mean_3_pred, 5) AS q90 FROM base WHERE institution_code = '3' AND year_month >= DATE '2000-01-01' ORDER BY year_month, item_code LIMIT 500")
def srv_forecast(spark, sf):
    p = F.col("rolling_mean_3_pred")
    rows = fo.base(spark, sf).where("institution_code = '3' and year_month >= '2000-01-01'").orderBy("year_month", "item_code").limit(500)
    return rows.select("year_month", "item_code", *R("rolling_mean_3_pred"), F.round(0.5 * p, 5).alias("q10"), F.round(1.5 * p, 5).alias("q90"))


@query("srv_risk_view", f"WITH {prisk.FUSE}, l AS (SELECT * FROM fu QUALIFY row_number() OVER (PARTITION BY stock_item_key ORDER BY month DESC) = 1) SELECT stock_item_key, month, round(100 * total_risk, 4) AS score, CASE WHEN round(100 * total_risk, 6) >= 80 THEN 'critical' WHEN round(100 * total_risk, 6) >= 60 THEN 'high' WHEN round(100 * total_risk, 6) >= 30 THEN 'medium' ELSE 'low' END AS level FROM l")
def srv_risk(spark, sf):
    from provisio.functions import ladder

    latest = prisk.fused(spark, sf).groupBy("stock_item_key").agg(F.max("month").alias("month"), F.max_by("total_risk", "month").alias("r"))
    s = F.round(100 * F.col("r"), 6)
    return latest.select("stock_item_key", "month", F.round(100 * F.col("r"), 4).alias("score"), ladder([(s >= 80, "critical"), (s >= 60, "high"), (s >= 30, "medium")], "low").alias("level"))


@query("srv_order_list", f"WITH {pinv.PRED}, o AS (SELECT *, greatest(base_stock + risk_buffer - position, 0) AS q FROM rec WHERE status = 'ACTIVE') SELECT year_month, institution_code, item_code, round(q, 4) AS recommended_order FROM o WHERE q > 0 ORDER BY round(q, 6) DESC, year_month, institution_code, item_code LIMIT 50 OFFSET 50")
def srv_orders(spark, sf):
    r = inv.recommend(inv.gated_risks(pinv.predictions(spark, sf))).where("status = 'ACTIVE' and recommended_order > 0")
    return r.orderBy(F.desc(F.round("recommended_order", 6)), *fea.IDS).offset(50).limit(50).select(*fea.IDS, F.round("recommended_order", 4).alias("recommended_order"))


@query("srv_prediction_filter", f"WITH {fo.BASE} SELECT {fea.ID}, {S('last_month_pred')} FROM base WHERE institution_code = '1' AND item_code = 'Brand#12'")
def srv_filter(spark, sf):
    rows = fo.base(spark, sf)
    for c, v in {"institution_code": "1", "item_code": "Brand#12", "stock_item_key": None}.items():  # optional predicates
        rows = rows.where(F.col(c) == v) if v is not None else rows
    return rows.select(*fea.IDS, *R("last_month_pred"))
