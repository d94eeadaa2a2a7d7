"""Queries on approvals, gates, standard items and pooled forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio.functions import correlation, join_unique
from provisio.operators import approval as op
from provisio.operators import contracts as rel
from provisio.operators import inventory as inv
from provisio.operators.ordered import quantiles
from provisio.plans import analysis as lt
from provisio.plans import bindings as b
from provisio.plans import features as fea
from provisio.plans import forecast as fo
from provisio.plans import inventory as pinv
from provisio.plans import items as pi
from provisio.plans import risk as prisk
from provisio.registry import query

R = lambda *cs: [F.round(c, 5).alias(c) for c in cs]
S = lambda *cs: ", ".join(f"round({c}, 5) AS {c}" for c in cs)

RULES = [("STANDARD", "supply", "WATCH"), ("PROMO", "supply", "CRITICAL"), ("SMALL", "demand", "CRITICAL"), ("small", "supply", "WARNING"), ("MEDIUM", "supply", "NORMAL"), ("red", "event", "CRITICAL")]
RULE_SQL = "rl AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{x}', '{v}')" for a, x, v in RULES) + ") t(code, axis, level))"
LEVEL_SQL = RULE_SQL + """,
cd AS (SELECT p_partkey, p_size > 40 AS ov, unnest([p_type, split_part(p_name, ' ', 1)]) AS code FROM part),
lv AS (SELECT p_partkey, max(CASE WHEN axis = 'supply' THEN CASE level WHEN 'NORMAL' THEN 0 WHEN 'WATCH' THEN 1 WHEN 'WARNING' THEN 2 ELSE 3 END END) AS r, bool_or(axis IS NULL) AS unknown, bool_or(ov) AS ov FROM cd LEFT JOIN rl USING (code) GROUP BY 1),
lx AS (SELECT p_partkey, CASE WHEN coalesce(r, 0) = 3 AND NOT ov THEN 'WARNING' ELSE ['NORMAL', 'WATCH', 'WARNING', 'CRITICAL'][coalesce(r, 0) + 1] END AS level, unknown AS needs_review FROM lv)"""


def supply_levels(spark, sf):
    p = b.table(spark, sf, "part").withColumns({"codes": F.concat_ws(";", "p_type", F.regexp_extract("p_name", r"^(\w+)", 1)), "override": F.col("p_size") > 40})
    return op.supply_level(p, "p_partkey", "codes", spark.createDataFrame(RULES, "code string, axis string, level string"))


@query("rsk_supply_level", f"WITH {LEVEL_SQL} SELECT p_partkey, level, needs_review FROM lx")
def rsk_level(spark, sf):
    return supply_levels(spark, sf)


def gated(spark, sf):
    p = b.table(spark, sf, "part").join(supply_levels(spark, sf), "p_partkey")
    c = F.col
    rules = [(c("p_retailprice") > 1900, "PRICE_HIGH", "BLOCK"), (c("needs_review"), "UNKNOWN_CODE", "REVIEW"), (c("p_size") < 3, "SIZE_LOW", "REVIEW"), ((c("level") == "CRITICAL") & (c("p_size") < 45), "CRITICAL_SMALL", "BLOCK")]
    return op.anomalies(p, rules, "p_name", "level")


ANOM = LEVEL_SQL + """,
gp AS (SELECT p_name, count(DISTINCT level) > 1 AS split FROM part JOIN lx USING (p_partkey) GROUP BY 1),
an AS (SELECT p_partkey, CAST(p_retailprice > 1900 AS INTEGER) + CAST(level = 'CRITICAL' AND p_size < 45 AS INTEGER) AS blocks, CAST(needs_review AS INTEGER) + CAST(p_size < 3 AS INTEGER) + CAST(split AS INTEGER) AS reviews FROM part JOIN lx USING (p_partkey) JOIN gp USING (p_name)),
aq AS (SELECT *, CASE WHEN blocks > 0 THEN 'BLOCK' WHEN reviews > 0 THEN 'REVIEW' ELSE 'PASS' END AS quality_status FROM an)"""


@query("rsk_anomaly_rules", f"WITH {ANOM} SELECT p_partkey, blocks + reviews AS issues, quality_status FROM aq")
def rsk_anomalies(spark, sf):
    return gated(spark, sf).select("p_partkey", F.size("issues").alias("issues"), "quality_status")


@query("rsk_three_way_routing", f"WITH {ANOM} SELECT quality_status, count(*) AS rows, CAST(sum(blocks + reviews) AS BIGINT) AS issues FROM aq GROUP BY 1")
def rsk_routing(spark, sf):
    return op.routed(gated(spark, sf))


@query("cls_bulk_acceptance", """SELECT p_partkey, CASE WHEN p_size > 40 THEN 'approved' WHEN p_size > 10 AND p_type <> 'PROMO' THEN 'active' WHEN p_size > 10 THEN 'inactive' ELSE 'pending' END AS class_status,
  CASE WHEN p_size > 10 THEN p_brand || '::' || p_type ELSE 'PENDING-' || sha256(CAST(p_partkey AS VARCHAR))[:20] END AS class_id, p_size > 40 AS automatic_order FROM part""")
def cls_bulk(spark, sf):
    p = b.table(spark, sf, "part").select("p_partkey", (F.col("p_size") > 40).alias("strict"), (F.col("p_size") > 10).alias("complete"), (F.col("p_type") != "PROMO").alias("forecastable"), F.col("p_brand").alias("family"), F.col("p_type").alias("subtype"))
    return op.bulk_classified(p, "p_partkey").select("p_partkey", "class_status", "class_id", "automatic_order")


@query("cls_decision_rows", "SELECT p_partkey, p_brand AS family, 'APPROVED' AS decision FROM part WHERE p_size > 40 AND p_type <> 'PROMO'")
def cls_decisions(spark, sf):
    return b.table(spark, sf, "part").where("p_size > 40 and p_type <> 'PROMO'").select("p_partkey", F.col("p_brand").alias("family"), F.lit("APPROVED").alias("decision"))


@query("cls_taxonomy_rebuild", "WITH n AS (SELECT p_brand, p_type, TRUE AS generated, min(p_size) AS v FROM part WHERE p_size > 20 GROUP BY 1, 2), o AS (SELECT p_brand, p_type, FALSE AS generated, max(p_size) AS v FROM part WHERE p_partkey % 2 = 0 AND p_type <> 'PROMO' GROUP BY 1, 2) SELECT * FROM n UNION ALL SELECT * FROM o WHERE (p_brand, p_type) NOT IN (SELECT (p_brand, p_type) FROM n)")
def cls_taxonomy(spark, sf):
    p = b.table(spark, sf, "part")
    old = p.where("p_partkey % 2 = 0").groupBy("p_brand", "p_type").agg((F.first("p_type") == "PROMO").alias("generated"), F.max("p_size").alias("v"))
    new = p.where("p_size > 20").groupBy("p_brand", "p_type").agg(F.lit(True).alias("generated"), F.min("p_size").alias("v"))
    return op.taxonomy(old, new, ["p_brand", "p_type"])


@query("cls_approved_mapping", "SELECT l_orderkey, l_linenumber, l_partkey, p_brand AS family FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 40")
def cls_mapping(spark, sf):
    ok = b.table(spark, sf, "part").where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("family"))
    return rel.joined(b.table(spark, sf, "lineitem"), ok, ["l_partkey"], "inner").select("l_orderkey", "l_linenumber", "l_partkey", "family")


@query("cls_forecast_rollup", f"WITH {fo.BASE}, t AS (SELECT p_brand AS item_code, min(p_type) AS subtype FROM part WHERE p_size > 30 GROUP BY 1) SELECT year_month, subtype, round(sum(rolling_mean_3_pred), 4) AS predicted, sum(month_end_stock) AS stock, count(DISTINCT institution_code) AS institutions FROM base JOIN t USING (item_code) GROUP BY 1, 2")
def cls_rollup(spark, sf):
    t = b.table(spark, sf, "part").where("p_size > 30").groupBy(F.col("p_brand").alias("item_code")).agg(F.min("p_type").alias("subtype"))
    return fo.base(spark, sf).join(t, "item_code").groupBy("year_month", "subtype").agg(F.round(F.sum("rolling_mean_3_pred"), 4).alias("predicted"), F.sum("month_end_stock").alias("stock"), F.count_distinct("institution_code").alias("institutions"))


@query("cls_policy_sensitivity", f"""WITH {pinv.PRED} SELECT CAST(lv AS DOUBLE) AS level, CAST(m AS DOUBLE) AS multiplier, round(sum(least(greatest(daily * (1 + 0.35 * least(lv * m, 1)) * (30 + lead_days * (1 + 0.5 * least(lv * m, 1)) + 14 * least(lv * m, 1)) * (1.2 + 0.25 * least(lv * m, 1)) - base_stock, 0), 0.75 * protection)) / sum(base_stock), 6) AS uplift
  FROM rec0, (VALUES (0.0), (0.3), (0.55), (0.75), (1.0)) a(lv), (VALUES (0.5), (1.0), (1.5)) c(m) GROUP BY 1, 2""")
def cls_sensitivity(spark, sf):
    rows = pinv.predictions(spark, sf).withColumn("level", F.explode(F.array(*(F.lit(x) for x in (0.0, 0.3, 0.55, 0.75, 1.0))))).withColumn("multiplier", F.explode(F.array(*(F.lit(x) for x in (0.5, 1.0, 1.5)))))
    rows = rows.withColumn("fused_risk", F.least(F.col("level") * F.col("multiplier"), F.lit(1.0)))
    r = inv.recommend(inv.gated_risks(rows))
    return r.groupBy("level", "multiplier").agg(F.round(F.sum("risk_buffer") / F.sum("base_stock"), 6).alias("uplift"))


@query("mat_latest_stock_keys", f"WITH {b.FACT} SELECT institution_code, item_code, department, year_month FROM fact QUALIFY row_number() OVER (PARTITION BY institution_code, department, item_code ORDER BY year_month DESC) = 1")
def mat_latest(spark, sf):
    from provisio.plans import ledger as led

    return op.latest_keys(led.fact(spark, sf), ["institution_code", "department", "item_code"], "year_month").select("institution_code", "item_code", "department", "year_month")


@query("mat_rule_approval", "WITH r AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_partkey % 3 = 0 AND p_type <> 'PROMO') SELECT p_partkey, CASE WHEN r.p_brand IS NULL THEN 'NO_RULE' WHEN p_size < 10 THEN 'LOW_CONFIDENCE' WHEN p_retailprice > 1800 THEN 'NEEDS_REVIEW' ELSE 'APPROVED' END AS reason FROM part LEFT JOIN r USING (p_brand, p_type)")
def mat_approval(spark, sf):
    p = b.table(spark, sf, "part")
    rules = p.where("p_partkey % 3 = 0 and p_type <> 'PROMO'").select("p_brand", "p_type").distinct()
    return op.rule_approval(p, rules, ["p_brand", "p_type"], [(F.col("p_size") < 10, "LOW_CONFIDENCE"), (F.col("p_retailprice") > 1800, "NEEDS_REVIEW")]).select("p_partkey", "reason")


@query("mat_ingredient_matching", """WITH p AS (SELECT p_partkey, p_brand, p_type, p_name, CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 2) END AS ing FROM part),
a AS (SELECT p_brand, p_name, min(ing) AS i0 FROM p WHERE ing IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT ing) = 1), c AS (SELECT p_name, min(ing) AS i1 FROM p WHERE ing IS NOT NULL GROUP BY 1 HAVING count(DISTINCT ing) = 1), d AS (SELECT p_type, min(ing) AS i2 FROM p WHERE ing IS NOT NULL GROUP BY 1 HAVING count(DISTINCT ing) = 1)
SELECT p_partkey, coalesce(i0, i1, i2) AS identity, CAST(CASE WHEN i0 IS NOT NULL THEN 1.0 WHEN i1 IS NOT NULL THEN 0.95 WHEN i2 IS NOT NULL THEN 0.85 ELSE 0 END AS DOUBLE) AS score FROM p LEFT JOIN a USING (p_brand, p_name) LEFT JOIN c USING (p_name) LEFT JOIN d USING (p_type)""")
def mat_ingredients(spark, sf):
    p = b.table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_name", F.when(F.col("p_partkey") % 2 == 0, F.regexp_extract("p_name", r"(\w+)$", 1)).alias("ing"))
    return op.unique_identity(p, [(["p_brand", "p_name"], 1.0), (["p_name"], 0.95), (["p_type"], 0.85)], "ing").select("p_partkey", "identity", "score")


@query("mat_medical_classifier", "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN TRUE WHEN p_type = 'PROMO' THEN FALSE WHEN p_size > 30 THEN regexp_matches(p_name, 'gear|bolt') ELSE TRUE END AS is_medical FROM part")
def mat_medical(spark, sf):
    from provisio.functions import ladder

    c = F.col
    return b.table(spark, sf, "part").select("p_partkey", ladder([(c("p_partkey") % 11 == 0, True), (c("p_type") == "PROMO", False), (c("p_size") > 30, c("p_name").rlike("gear|bolt"))], True).alias("is_medical"))


@query("mat_review_candidates", "WITH m AS (SELECT p_name FROM part WHERE p_size > 45), d AS (SELECT p_name FROM part WHERE p_partkey % 5 = 0 AND p_size < 4) SELECT DISTINCT p_name, 'flagged_not_listed' AS kind FROM m WHERE p_name NOT IN (SELECT p_name FROM d) UNION ALL SELECT DISTINCT p_name, 'listed_not_flagged' FROM d WHERE p_name NOT IN (SELECT p_name FROM m)")
def mat_review(spark, sf):
    p = b.table(spark, sf, "part")
    m, d = p.where("p_size > 45").select("p_name").distinct(), p.where("p_partkey % 5 = 0 and p_size < 4").select("p_name").distinct()
    return m.join(d, "p_name", "left_anti").withColumn("kind", F.lit("flagged_not_listed")).unionByName(d.join(m, "p_name", "left_anti").withColumn("kind", F.lit("listed_not_flagged")))


@query("mat_metadata_rollup", "WITH g AS (SELECT p_brand, count(*) AS n, array_to_string(list_sort(list(DISTINCT p_type))[:20], ';') AS types FROM part WHERE p_size > 25 GROUP BY 1) SELECT p_partkey, coalesce(n, 0) AS mappings, coalesce(types, '') AS types FROM part LEFT JOIN g USING (p_brand)")
def mat_metadata(spark, sf):
    p = b.table(spark, sf, "part")
    g = p.where("p_size > 25").groupBy("p_brand").agg(F.count("*").alias("mappings"), join_unique(F.col("p_type")).alias("types"))
    return p.join(g, "p_brand", "left").select("p_partkey", F.coalesce("mappings", F.lit(0)).alias("mappings"), F.coalesce("types", F.lit("")).alias("types"))


@query("mat_structured_claims", "SELECT p_partkey, concat_ws(';', CASE WHEN p_size > 40 THEN 'PVC' END, CASE WHEN p_type = 'PROMO' THEN 'LATEX' END) AS claims, CASE WHEN p_size > 40 OR p_type = 'PROMO' THEN 'claimed' ELSE 'not_provided' END AS status FROM part")
def mat_claims(spark, sf):
    yes = {"PVC": F.when(F.col("p_size") > 40, "Y").otherwise("n"), "LATEX": F.when(F.col("p_type") == "PROMO", " yes").otherwise("")}
    hits = F.filter(F.array(*(F.when(F.lower(F.trim(v)).isin("y", "yes", "true"), F.lit(k)) for k, v in yes.items())), lambda x: x.isNotNull())
    return b.table(spark, sf, "part").select("p_partkey", F.array_join(hits, ";").alias("claims"), F.when(F.size(hits) > 0, "claimed").otherwise("not_provided").alias("status"))


@query("itm_standard_across_periods", """WITH h AS (SELECT p_partkey AS key, lower(p_name) || p_brand AS strict, lower(p_name) || p_type AS core FROM part WHERE p_partkey % 2 = 0), c AS (SELECT 'STD-' || p_brand || p_size AS standard, lower(p_name) || p_brand AS strict, lower(p_name) || p_type AS core FROM part WHERE p_partkey % 2 = 1 AND p_size < 10),
s AS (SELECT strict, min(standard) AS s1 FROM c GROUP BY 1), k AS (SELECT core, min(standard) AS s2 FROM c GROUP BY 1 HAVING count(DISTINCT standard) = 1)
SELECT key, coalesce(s1, s2, 'NAME::' || core) AS standard, CASE WHEN s1 IS NOT NULL THEN 'strict' WHEN s2 IS NOT NULL THEN 'core' ELSE 'fallback' END AS method, s1 IS NOT NULL OR s2 IS NOT NULL AS training_eligible FROM h LEFT JOIN s USING (strict) LEFT JOIN k USING (core)""")
def itm_standard(spark, sf):
    p = b.table(spark, sf, "part").withColumns({"strict": F.concat(F.lower("p_name"), "p_brand"), "core": F.concat(F.lower("p_name"), "p_type")})
    cur = p.where("p_partkey % 2 = 1 and p_size < 10").select(F.concat(F.lit("STD-"), "p_brand", F.col("p_size").cast("string")).alias("standard"), "strict", "core")
    return op.standard_items(p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key"), "strict", "core"), cur)


@query("itm_parent_concepts", "SELECT CASE WHEN regexp_matches(p_name, 'gear') THEN 'GEAR' WHEN regexp_matches(p_name, 'ring|plate') THEN 'FLAT' ELSE 'UNRESOLVED' END AS parent, count(*) AS children, CAST(sum(p_size) AS BIGINT) AS usage FROM part GROUP BY 1")
def itm_parents(spark, sf):
    from provisio.operators.items import first_rule

    parent = first_rule(F.col("p_name"), [("gear", "GEAR"), ("ring|plate", "FLAT")], "UNRESOLVED").alias("parent")
    return b.table(spark, sf, "part").groupBy(parent).agg(F.count("*").alias("children"), F.sum("p_size").alias("usage"))


@query("itm_evidence_tiers", "SELECT page_id, CASE WHEN url IS NULL THEN 0::DOUBLE WHEN regexp_matches(url, '://[^/]*example\\.org') THEN 0.98::DOUBLE WHEN regexp_matches(url, '://[^/]*example\\.com') THEN 0.65::DOUBLE ELSE 0.45::DOUBLE END AS confidence FROM pages")
def itm_tiers(spark, sf):
    host = F.try_parse_url(F.col("url"), F.lit("HOST"))
    return b.table(spark, sf, "pages").select("page_id", F.when(F.col("url").isNull(), 0.0).when(host.endswith("example.org"), 0.98).when(host.endswith("example.com"), 0.65).otherwise(0.45).alias("confidence"))


@query("itm_alias_duplicates", f"WITH {pi.WORK}, d AS (SELECT DISTINCT item_code, name, p_type FROM lk) SELECT item_code, name, p_type FROM d QUALIFY row_number() OVER (PARTITION BY item_code, name ORDER BY p_type) = 1")
def itm_duplicates(spark, sf):
    d = pi.work(spark, sf)[1].select("item_code", "name", "p_type").distinct()
    from provisio.sources import newest

    return newest(d, ["item_code", "name"], [F.asc("p_type")])


@query("for_occurrence_size", f"""WITH {fea.SEG}, s AS (SELECT item_code, institution_code, count(demand) AS n, count(*) FILTER (WHERE demand > 0) AS m, avg(ln(demand)) FILTER (WHERE demand > 0) AS mu, var_samp(ln(demand)) FILTER (WHERE demand > 0) AS s2 FROM (SELECT * FROM seg WHERE demand IS NULL OR demand <> 0) GROUP BY 1, 2),
p AS (SELECT item_code, sum(m) / sum(n) AS p0, var_samp(m / n) AS pv, sum(mu * m) / sum(m) AS m0, avg(s2) AS i, var_samp(mu) AS o FROM s GROUP BY 1),
q AS (SELECT *, least(greatest(p0 * (1 - p0) / greatest(pv, 1e-6) - 1, 1), 1000) AS st FROM p),
j AS (SELECT institution_code, item_code, (m + p0 * st) / (n + st) AS occurrence, (coalesce(mu, 0) * m + m0 * coalesce(i / nullif(o, 0), 1)) / (m + coalesce(i / nullif(o, 0), 1)) AS log_size, i FROM s JOIN q USING (item_code))
SELECT institution_code, item_code, round(occurrence, 5) AS occurrence, round(log_size, 5) AS log_size, round(occurrence * exp(log_size + coalesce(i, 0) / 2), 4) AS forecast FROM j""")
def for_occurrence(spark, sf):
    from provisio.operators import features as fop

    h = fop.demand(fea.fact(spark, sf)).where("demand is null or demand <> 0")
    return op.occurrence_size(h, ["institution_code"], "item_code", "demand").select("institution_code", "item_code", *R("occurrence", "log_size"), F.round("forecast", 4).alias("forecast"))


@query("for_prediction_frame", f"WITH {fo.PAT} SELECT year_month, institution_code, item_code, coalesce(demand_pattern, 'new_series') AS demand_pattern, CAST(datediff('month', year_month, DATE '2001-12-01') AS INTEGER) AS data_age_months FROM base LEFT JOIN pat USING (institution_code, item_code) WHERE year_month >= DATE '2001-01-01'")
def for_frame(spark, sf):
    rows = fo.base(spark, sf).where("year_month >= '2001-01-01'").join(fo.patterns(spark, sf).select(*fea.KEY, "demand_pattern"), fea.KEY, "left")
    age = (2001 * 12 + 12) - (F.year("year_month") * 12 + F.month("year_month"))
    return rows.select(*fea.IDS, F.coalesce("demand_pattern", F.lit("new_series")).alias("demand_pattern"), age.cast("int").alias("data_age_months"))


@query("trd_stockout_proxy", f"WITH {b.SERIES_FACT}, m AS (SELECT DISTINCT p_brand AS item_code, p_type AS hs_code FROM part WHERE p_size > 45) SELECT (year_month - INTERVAL 1 MONTH)::DATE AS month, hs_code, round(0.7 * avg(CAST(coalesce(stockout_rate, 0) > 0 AS DOUBLE)) + 0.3 * avg(coalesce(stockout_rate, 0)), 6) AS proxy, count(DISTINCT stock_item_key) AS series FROM sfact JOIN m USING (item_code) GROUP BY 1, 2")
def trd_proxy(spark, sf):
    m = b.table(spark, sf, "part").where("p_size > 45").select(F.col("p_brand").alias("item_code"), F.col("p_type").alias("hs_code")).distinct()
    rate = F.coalesce("stockout_rate", F.lit(0.0))
    j = fea.fact(spark, sf).join(m, "item_code")
    return j.groupBy(F.add_months("year_month", -1).alias("month"), "hs_code").agg(F.round(0.7 * F.avg((rate > 0).cast("double")) + 0.3 * F.avg(rate), 6).alias("proxy"), F.count_distinct("stock_item_key").alias("series"))


@query("trd_counterfactual_impact", f"WITH {prisk.FUSE} SELECT month, count(*) FILTER (WHERE t > 0) AS exposed, round(sum(supply_risk - base_supply), 5) AS total_delta, round(quantile_cont(supply_risk - base_supply, 0.9) FILTER (WHERE t > 0), 5) AS delta_p90 FROM fu GROUP BY 1")
def trd_impact(spark, sf):
    f = prisk.fused(spark, sf)
    d = F.col("supply_risk") - F.col("base_supply")
    g = f.groupBy("month").agg(F.count_if(F.col("trade_risk") > 0).alias("exposed"), F.round(F.sum(d), 5).alias("total_delta"))
    high = quantiles(f.where("trade_risk > 0").select("month", d.alias("d")), ["month"], "d", {"delta_p90": 0.9})
    return g.join(high, "month", "left").select("month", "exposed", "total_delta", F.round("delta_p90", 5).alias("delta_p90"))


@query("lt_change_order", f"WITH {lt.LEAD}, d AS (SELECT l_orderkey, max(l_linenumber) > 4 AS changed, max(lead) AS lead FROM le GROUP BY 1) SELECT changed, count(*) AS n, median(lead) AS p50, round(quantile_cont(lead, 0.9), 5) AS p90 FROM d GROUP BY 1")
def lt_change(spark, sf):
    d = lt.leads(spark, sf).groupBy("l_orderkey").agg((F.max("l_linenumber") > 4).alias("changed"), F.max("lead").alias("lead"))
    return d.groupBy("changed").agg(F.count("*").alias("n"), F.percentile("lead", F.lit(0.5)).alias("p50"), F.round(F.percentile("lead", F.lit(0.9)), 5).alias("p90"))


_STEPS = ", ".join(f"{k / 1000}" for k in range(500, 1000))


@query("lt_quantile_mapped", f"WITH {lt.LEAD}, q AS (SELECT quantile_cont(lead, [{_STEPS}]) AS q FROM le) SELECT p_partkey, round(q[CAST(least(floor((0.5::DOUBLE + 0.45::DOUBLE * (p_size / 50)) * 1000) - 500, 499) AS INTEGER) + 1], 4) AS lead_quantile FROM part, q")
def lt_mapped(spark, sf):
    p = b.table(spark, sf, "part")
    return op.quantile_mapped(p, F.col("p_size") / 50, lt.leads(spark, sf), "lead").select("p_partkey", F.round("lead_quantile", 4).alias("lead_quantile"))


@query("inv_ledger_zero_stock", f"WITH {b.FLAGGED}, g AS (SELECT institution_code, item_code, sum(greatest(consumption_qty, 0)) AS out_total, CAST(sum(physical_violation) AS BIGINT) AS violations, first(closing_stock ORDER BY {b.DESC}) FILTER (WHERE closing_stock IS NOT NULL) AS last_closing, coalesce(sum(greatest(consumption_qty, 0)) FILTER (WHERE closing_date >= DATE '2001-06-01'), 0) AS recent FROM flagged GROUP BY 1, 2) SELECT institution_code, item_code, CASE WHEN violations > 60 THEN 'DATA_ERROR' WHEN recent <= 0 THEN 'NOT_OPERATED' ELSE 'TRUE_STOCKOUT' END AS reason FROM g WHERE last_closing <= 0")
def inv_zero(spark, sf):
    from provisio.functions import ladder
    from provisio.plans import ledger as led

    used = F.greatest("consumption_qty", F.lit(0.0))
    g = led.rows(spark, sf).groupBy("institution_code", "item_code").agg(F.sum("physical_violation").alias("violations"), F.max_by("closing_stock", F.when(F.col("closing_stock").isNotNull(), F.struct(*b.ORDER))).alias("last_closing"), F.coalesce(F.sum(F.when(F.col("closing_date") >= "2001-06-01", used)), F.lit(0.0)).alias("recent"))
    return g.where("last_closing <= 0").select("institution_code", "item_code", ladder([(F.col("violations") > 60, "DATA_ERROR"), (F.col("recent") <= 0, "NOT_OPERATED")], "TRUE_STOCKOUT").alias("reason"))
