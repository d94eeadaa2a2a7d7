"""Queries on weights, quotas, sources and mappings."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provisio.operators import selection as op
from provisio.plans import bindings as b
from provisio.plans import features as fea
from provisio.plans import items as pi
from provisio.plans import risk as prisk
from provisio.registry import query

WEIGHTS = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)


@query("for_history_weight", f"""WITH {b.SERIES_FACT}, r AS (SELECT institution_code, item_code, greatest(consumption_qty, 0) AS v, {fea.SPLIT_SQL} AS split FROM sfact),
s AS (SELECT institution_code, item_code, coalesce(sum(v) FILTER (WHERE split = 'historical'), 0) AS hs, count(*) FILTER (WHERE split = 'historical') AS hn, coalesce(sum(v) FILTER (WHERE split = 'train'), 0) AS ts, count(*) FILTER (WHERE split = 'train') AS tn FROM r GROUP BY 1, 2),
m AS (SELECT CAST(w AS DOUBLE) AS weight, 100 * sum(abs(coalesce((w * hs + ts) / nullif(w * hn + tn, 0), 0) - v)) / sum(v) AS wape FROM r JOIN s USING (institution_code, item_code), (VALUES {', '.join(f'({w}::DOUBLE)' for w in WEIGHTS)}) t(w) WHERE split = 'validation' GROUP BY 1)
SELECT weight, round(wape, 5) AS wape, row_number() OVER (ORDER BY round(wape, 6), weight) = 1 AS selected FROM m""")
def for_weight(spark, sf):
    rows = fea.fact(spark, sf).withColumns({"v": F.greatest("consumption_qty", F.lit(0.0)), "split": fea.split()})
    m = op.history_weight(rows, fea.KEY, "v", "split", WEIGHTS)
    return m.select("weight", F.round("wape", 5).alias("wape"), (F.row_number().over(W.orderBy(F.round("wape", 6), "weight")) == 1).alias("selected"))


@query("for_dense_panel_holdout", f"""WITH {b.SERIES_FACT}, i AS (SELECT institution_code, item_code, year_month, consumption_qty AS v FROM sfact WHERE year_month BETWEEN DATE '2000-01-01' AND DATE '2001-12-01'),
f AS (SELECT institution_code, item_code, min(year_month) AS a FROM i GROUP BY 1, 2), d AS (SELECT institution_code, item_code, unnest(generate_series(a, DATE '2001-12-01', INTERVAL 1 MONTH))::DATE AS year_month FROM f),
p AS (SELECT d.*, coalesce(v, 0) AS v FROM d LEFT JOIN i USING (institution_code, item_code, year_month)),
w AS (SELECT *, lag(v) OVER o AS last, avg(v) OVER (PARTITION BY institution_code, item_code ORDER BY year_month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS mean3, avg(v) OVER (PARTITION BY institution_code, item_code ORDER BY year_month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS mean12 FROM p WINDOW o AS (PARTITION BY institution_code, item_code ORDER BY year_month))
SELECT year_month, count(*) AS series, round(100 * sum(abs(coalesce(last, 0) - v)) / nullif(sum(abs(v)), 0), 5) AS wape_last, round(100 * sum(abs(coalesce(mean3, 0) - v)) / nullif(sum(abs(v)), 0), 5) AS wape_mean3, round(100 * sum(abs(coalesce(mean12, 0) - v)) / nullif(sum(abs(v)), 0), 5) AS wape_mean12 FROM w WHERE year_month BETWEEN DATE '2001-08-01' AND DATE '2001-10-01' GROUP BY 1""")
def for_panel(spark, sf):
    p = op.dense_panel(fea.fact(spark, sf).withColumnRenamed("consumption_qty", "v"), fea.KEY, "v", "2000-01-01", 24)
    w = W.partitionBy(*fea.KEY).orderBy("year_month")
    p = p.withColumns({"last": F.lag("v").over(w), "mean3": F.avg("v").over(w.rowsBetween(-3, -1)), "mean12": F.avg("v").over(w.rowsBetween(-12, -1))}).where("year_month between '2001-08-01' and '2001-10-01'")
    wape = lambda c: F.round(100 * F.try_divide(F.sum(F.abs(F.coalesce(F.col(c), F.lit(0.0)) - F.col("v"))), F.sum(F.abs("v"))), 5).alias(f"wape_{c}")
    return p.groupBy("year_month").agg(F.count("*").alias("series"), wape("last"), wape("mean3"), wape("mean12"))


@query("smp_quota_allocation", "WITH c AS (SELECT p_brand AS stratum, count(*) AS n FROM part GROUP BY 1), q AS (SELECT *, least(n, 3) AS base FROM c) SELECT stratum, n, CAST(least(n, base + greatest(floor((200 - sum(base) OVER ()) * (n - base) / greatest(sum(n - base) OVER (), 1)), 0)) AS BIGINT) AS quota FROM q")
def smp_quotas(spark, sf):
    return op.quotas(b.table(spark, sf, "part").groupBy(F.col("p_brand").alias("stratum")).agg(F.count("*").alias("n")), 200, 3)


@query("inv_mapping_match", "WITH a AS (SELECT p_partkey, p_size AS v FROM part), c AS (SELECT p_partkey, p_size + CASE WHEN p_partkey % 10 = 0 THEN 5 ELSE 0 END AS v FROM part) SELECT (SELECT round(avg(CAST(abs(a.v - c.v) <= 1 AS DOUBLE)), 6) FROM a JOIN c USING (p_partkey)) AS matched, (SELECT round(avg(CAST(abs(a.v - c.v) <= 1 AS DOUBLE)), 6) FROM a JOIN c ON c.p_partkey = a.p_partkey + 1) AS control")
def inv_match(spark, sf):
    p = b.table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("v"))
    other = p.withColumn("v", F.col("v") + F.when(F.col("p_partkey") % 10 == 0, 5).otherwise(0))
    return op.match_share(p, other, "p_partkey", "v", 1).select(F.round("matched", 6).alias("matched"), F.round("control", 6).alias("control"))


@query("cls_three_way_composition", "SELECT p_partkey, CASE WHEN p_size > 30 THEN p_type WHEN p_size > 15 THEN lower(p_type) ELSE p_brand END AS family FROM part")
def cls_compose(spark, sf):
    p = b.table(spark, sf, "part")
    return op.composed([p.select("p_partkey", F.when(F.col("p_size") > 30, F.col("p_type")).alias("family")), p.select("p_partkey", F.when(F.col("p_size") > 15, F.lower("p_type")).otherwise(" ").alias("family")), p.select("p_partkey", F.col("p_brand").alias("family"))], "p_partkey", ["family"])


@query("itm_family_resolution", "WITH s AS (SELECT p_partkey, CASE WHEN p_size > 40 THEN 'A' END AS v, CASE WHEN p_name LIKE '%gear' THEN 'GEAR' END AS r, CASE WHEN p_type = 'PROMO' THEN 'P' ELSE '' END AS l FROM part) SELECT p_partkey, coalesce(v, r, nullif(l, ''), 'UNRESOLVED') AS family, CASE WHEN v IS NOT NULL THEN 'verified' WHEN r IS NOT NULL THEN 'rule' WHEN l <> '' THEN 'local' ELSE 'none' END AS family_source, CAST(v IS NOT NULL AS INTEGER) + CAST(r IS NOT NULL AS INTEGER) + CAST(l <> '' AS INTEGER) > 1 AS family_conflict FROM s")
def itm_resolve(spark, sf):
    c = F.col
    sources = [(F.when(c("p_size") > 40, "A"), "verified"), (F.when(c("p_name").endswith("gear"), "GEAR"), "rule"), (F.when(c("p_type") == "PROMO", "P").otherwise(""), "local")]
    return op.resolved_family(b.table(spark, sf, "part"), sources).select("p_partkey", "family", "family_source", "family_conflict")


@query("itm_prefix_folding", "SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '^Brand#1[0-9]') THEN 'Brand#1' WHEN regexp_matches(p_brand, '^Brand#2[0-9]') THEN 'Brand#2' WHEN regexp_matches(p_brand, '^Brand#[0-9]') THEN 'Brand#' END AS axis FROM part")
def itm_prefix(spark, sf):
    return b.table(spark, sf, "part").select("p_partkey", op.longest_prefix(F.col("p_brand"), ["Brand#", "Brand#1", "Brand#2"]).alias("axis"))


@query("itm_attribute_parser", f"WITH {pi.ALIASES} SELECT DISTINCT name, CASE WHEN name LIKE '%(x) 1,000ml 5mg' THEN 'capacity=1000ml;strength=5mg' ELSE '' END AS tokens, CASE WHEN name LIKE '%(x) 1,000ml 5mg' THEN trim(name[:-12]) ELSE name END AS leftover, CASE WHEN name LIKE '%(x) 1,000ml 5mg' THEN 'parsed' ELSE 'plain' END AS readiness FROM cl")
def itm_parser(spark, sf):
    return op.parsed(pi.cleaned(spark, sf), "name")


@query("mat_tariff_mapping", "WITH u AS (SELECT lower(p_name) AS k, min(p_partkey) AS leaf FROM part WHERE p_partkey % 17 = 0 GROUP BY 1 HAVING count(*) = 1) SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN -1 ELSE leaf END AS leaf, CASE WHEN p_type = 'PROMO' THEN 'curated' WHEN leaf IS NOT NULL THEN 'exact_name' ELSE 'none' END AS path FROM part LEFT JOIN u ON lower(p_name) = k")
def mat_tariff(spark, sf):
    p = b.table(spark, sf, "part")
    u = p.where("p_partkey % 17 = 0").groupBy(F.lower("p_name").alias("k")).agg(F.min("p_partkey").alias("leaf"), F.count("*").alias("n")).where("n = 1").drop("n")
    j = p.join(u, F.lower(p["p_name"]) == u["k"], "left")
    promo = F.col("p_type") == "PROMO"
    return j.select("p_partkey", F.when(promo, F.lit(-1)).otherwise(F.col("leaf")).cast("long").alias("leaf"), F.when(promo, "curated").when(F.col("leaf").isNotNull(), "exact_name").otherwise("none").alias("path"))


@query("mat_exposure_candidates", "WITH c AS (SELECT p_partkey, p_size, unnest([p_type, split_part(p_name, ' ', 1)]) AS code FROM part), f AS (SELECT p_type AS code, count(DISTINCT p_brand) AS factors FROM part WHERE p_size > 48 GROUP BY 1) SELECT p_partkey, code, coalesce(factors, 0) AS factors, CASE WHEN factors IS NULL THEN 'no_factor' WHEN p_size > 25 THEN 'high' ELSE 'normal' END AS priority FROM c LEFT JOIN f USING (code)")
def mat_exposure(spark, sf):
    from provisio.functions import ladder, split_codes

    p = b.table(spark, sf, "part")
    c = p.select("p_partkey", "p_size", F.explode(split_codes(F.concat_ws(";", "p_type", F.regexp_extract("p_name", r"^(\w+)", 1)))).alias("code"))
    f = p.where("p_size > 48").groupBy(F.col("p_type").alias("code")).agg(F.count_distinct("p_brand").alias("factors"))
    j = c.join(f, "code", "left")
    return j.select("p_partkey", "code", F.coalesce("factors", F.lit(0)).alias("factors"), ladder([(F.col("factors").isNull(), "no_factor"), (F.col("p_size") > 25, "high")], "normal").alias("priority"))


@query("trd_candidate_evaluation", f"""WITH {prisk.TRADE}, n AS (SELECT hs_code, month, trade_score, lead(greatest(-import_value_yoy, 0)) OVER (PARTITION BY hs_code ORDER BY month) AS y, suppliers AS w FROM ts), v AS (SELECT *, trade_score AS x FROM n WHERE y IS NOT NULL),
s AS (SELECT sum(w * x * y) / sum(w * x * x) AS slope, sum(w * y) / sum(w) AS level FROM v) SELECT round(slope, 5) AS slope, round((SELECT sum(w * abs(y - slope * x)) / sum(w) FROM v), 5) AS mae, round((SELECT sum(w * abs(y - level)) / sum(w) FROM v), 5) AS constant_mae FROM s""")
def trd_candidates(spark, sf):
    """A slope through the origin, weighted by suppliers, against a constant."""
    w = W.partitionBy("hs_code").orderBy("month")
    v = prisk.trade(spark, sf).select("hs_code", "month", F.col("trade_score").alias("x"), F.lead(F.greatest(-F.col("import_value_yoy"), F.lit(0.0))).over(w).alias("y"), F.col("suppliers").alias("w")).where("y is not null")
    s = v.agg((F.sum(F.col("w") * F.col("x") * F.col("y")) / F.sum(F.col("w") * F.col("x") * F.col("x"))).alias("slope"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("level"))
    j = v.join(F.broadcast(s), F.lit(True))
    mae = lambda p: F.round(F.sum(F.col("w") * F.abs(F.col("y") - p)) / F.sum("w"), 5)
    return j.agg(F.round(F.first("slope"), 5).alias("slope"), mae(F.col("slope") * F.col("x")).alias("mae"), mae(F.col("level")).alias("constant_mae"))
