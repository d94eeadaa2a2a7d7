"""Commodity, trade and fusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio.operators import risk as op
from provisio.plans import bindings as b
from provisio.plans import features as fea
from provisio.registry import query
from provisio.sources import stored

PF = fea.PRICES + """,
r AS (SELECT *, date - DATE '1970-01-01' AS dn, price / lag(price) OVER (PARTITION BY factor ORDER BY date) - 1 AS r FROM prices),
a AS (SELECT r.*, o.price AS p7, o.date AS d7 FROM r ASOF LEFT JOIN (SELECT factor, date, date + 7 AS k, price FROM prices) o ON r.factor = o.factor AND r.date >= o.k),
a2 AS (SELECT a.*, o.price AS p30, o.date AS d30 FROM a ASOF LEFT JOIN (SELECT factor, date, date + 30 AS k, price FROM prices) o ON a.factor = o.factor AND a.date >= o.k),
pf AS (SELECT *, CASE WHEN date - d7 BETWEEN 7 AND 14 THEN price / p7 - 1 ELSE 0 END AS return_7, CASE WHEN date - d30 BETWEEN 30 AND 60 THEN price / p30 - 1 ELSE 0 END AS return_30,
  coalesce(CASE WHEN count(r) OVER n >= 2 THEN stddev_samp(r) OVER n END, CASE WHEN count(r) OVER k >= 2 THEN stddev_samp(r) OVER k END, 0) * sqrt(30) AS volatility_30, price / avg(price) OVER q - 1 AS level_90 FROM a2
  WINDOW n AS (PARTITION BY factor ORDER BY dn RANGE BETWEEN 29 PRECEDING AND CURRENT ROW), q AS (PARTITION BY factor ORDER BY dn RANGE BETWEEN 89 PRECEDING AND CURRENT ROW), k AS (PARTITION BY factor ORDER BY dn ROWS 2 PRECEDING)),
fr AS (SELECT *, date_trunc('month', date)::DATE AS month, 0.45 * least(greatest(return_30, 0) / 0.2, 1) + 0.3 * least(greatest(volatility_30, 0) / 0.3, 1) + 0.25 * least(greatest(level_90, 0) / 0.2, 1) AS risk FROM pf),
fm AS (SELECT * FROM fr QUALIFY row_number() OVER (PARTITION BY factor, month ORDER BY date DESC) = 1)"""


def feats(spark, sf):
    return op.price_features(fea.prices(spark, sf))


@query("com_price_features", f"WITH {PF} SELECT factor, date, round(return_7, 6) AS return_7, round(return_30, 6) AS return_30, round(volatility_30, 5) AS volatility_30, round(level_90, 6) AS level_90 FROM pf")
def com_features(spark, sf):
    return feats(spark, sf).select("factor", "date", F.round("return_7", 6).alias("return_7"), F.round("return_30", 6).alias("return_30"), F.round("volatility_30", 5).alias("volatility_30"), F.round("level_90", 6).alias("level_90"))


@query("com_asof_return", f"WITH {PF} SELECT factor, date, round(return_30, 6) AS return_30 FROM pf")
def com_asof(spark, sf):
    return fea.prices(spark, sf).select("factor", "date", F.round(op.asof_return(30), 6).alias("return_30"))


@query("com_factor_risk", f"WITH {PF} SELECT factor, month, date, round(risk, 5) AS risk FROM fm")
def com_risk(spark, sf):
    return op.factor_risk(feats(spark, sf)).select("factor", "month", "date", F.round("risk", 5).alias("risk"))


def items(spark, sf):
    """Items by type with ;-joined material codes."""
    p = b.table(spark, sf, "part")
    return p.groupBy(F.col("p_type").alias("stock_item_key")).agg(F.array_join(F.array_sort(F.collect_set(F.regexp_extract("p_name", r"^(\w+)", 1))), ";").alias("codes"), F.max(F.col("p_size") / 50).alias("mapping_weight")).withColumn("confidence", F.when(F.col("stock_item_key") < "M", "High").otherwise("low"))


def factors(spark, sf):
    p = b.table(spark, sf, "part")
    return p.groupBy(F.regexp_extract("p_name", r"^(\w+)", 1).alias("code"), F.col("p_brand").alias("factor")).agg(F.min(F.col("p_size") / 50).alias("transmission"), F.avg(F.col("p_size") / 50).alias("proxy"), (F.max("p_size") * 2).cast("int").alias("lag_days"))


PATHS = """it AS (SELECT p_type AS stock_item_key, max(p_size / 50) AS mapping_weight, CASE WHEN p_type < 'M' THEN 0.9::DOUBLE ELSE 0.4::DOUBLE END AS conf FROM part GROUP BY 1, 3),
ic AS (SELECT DISTINCT p_type AS stock_item_key, split_part(p_name, ' ', 1) AS code FROM part),
fc AS (SELECT split_part(p_name, ' ', 1) AS code, p_brand AS factor, min(p_size / 50) AS transmission, avg(p_size / 50) AS proxy, max(p_size) * 2 AS lag_days FROM part GROUP BY 1, 2),
pa AS (SELECT *, CASE WHEN least(mapping_weight, conf, transmission, proxy) <= 0 THEN 0 ELSE exp((ln(mapping_weight) + ln(conf) + ln(transmission) + ln(proxy)) / 4) END AS path_weight FROM it JOIN ic USING (stock_item_key) JOIN fc USING (code))"""


@query("com_market_paths", f"WITH {PATHS} SELECT stock_item_key, code, factor, CAST(lag_days AS INTEGER) AS lag_days, round(path_weight, 6) AS path_weight FROM pa")
def com_paths(spark, sf):
    return op.market_paths(items(spark, sf), factors(spark, sf)).select("stock_item_key", "code", "factor", "lag_days", F.round("path_weight", 6).alias("path_weight"))


COMMODITY = f"""{PF}, {PATHS},
cx AS (SELECT stock_item_key, date_trunc('month', last_day(month) + CAST(lag_days AS INTEGER))::DATE AS score_month, factor, return_30, path_weight, least(risk * path_weight, 1) AS x FROM pa JOIN fm USING (factor)),
cs AS (SELECT stock_item_key, score_month AS month, 1 - product(1 - x) AS commodity_risk, sum(return_30 * path_weight) / nullif(sum(path_weight), 0) AS weighted_return, count(DISTINCT factor) AS factors, coalesce(array_to_string(list_sort(list(DISTINCT factor) FILTER (WHERE x >= 0.05)), ';'), '') AS event_codes, count(*) AS paths FROM cx GROUP BY 1, 2)"""


def commodity(spark, sf):
    return op.commodity_scores(op.market_paths(items(spark, sf), factors(spark, sf)), op.factor_risk(feats(spark, sf)))


@query("com_compound_scores", f"WITH {COMMODITY} SELECT stock_item_key, month, round(commodity_risk, 5) AS commodity_risk, round(weighted_return, 5) AS weighted_return, factors, paths FROM cs")
def com_scores(spark, sf):
    return commodity(spark, sf).select("stock_item_key", "month", F.round("commodity_risk", 5).alias("commodity_risk"), F.round("weighted_return", 5).alias("weighted_return"), "factors", "paths")


@query("com_lag_scan", f"""WITH {fea.PRICES}, m AS (SELECT factor, date_trunc('month', date)::DATE AS month, avg(price) AS value FROM prices WHERE factor IN ('Brand#12', 'Brand#13') GROUP BY 1, 2),
c AS (SELECT *, value / lag(value) OVER (PARTITION BY factor ORDER BY month) - 1 AS ch FROM m)
SELECT CAST(l AS INTEGER) AS lag, round(corr(u.ch, d.ch), 5) AS r, count(*) AS n FROM c u, range(7) t(l), c d WHERE u.factor = 'Brand#12' AND d.factor = 'Brand#13' AND d.month = u.month + to_months(CAST(l AS INTEGER)) AND u.ch IS NOT NULL AND d.ch IS NOT NULL GROUP BY 1 HAVING count(*) >= 12""")
def com_lags(spark, sf):
    m = fea.prices(spark, sf).where("factor in ('Brand#12', 'Brand#13')").groupBy("factor", F.trunc("date", "MM").alias("month")).agg(F.avg("price").alias("value"))
    out = op.lag_scan(m.where("factor = 'Brand#12'"), m.where("factor = 'Brand#13'"))
    return out.select("lag", F.round("r", 5).alias("r"), "n")


@query("com_demand_panel", f"""WITH {b.SERIES_FACT}, mat AS (SELECT DISTINCT p_brand AS item_code, p_type AS material FROM part WHERE p_size > 45)
SELECT year_month, material, sum(consumption_qty) AS consumption_qty, sum(month_end_stock) AS month_end_stock FROM sfact JOIN mat USING (item_code) GROUP BY 1, 2""")
def com_panel(spark, sf):
    mat = b.table(spark, sf, "part").where("p_size > 45").select(F.col("p_brand").alias("item_code"), F.col("p_type").alias("material")).distinct()
    return fea.fact(spark, sf).join(mat, "item_code").groupBy("year_month", "material").agg(F.sum("consumption_qty").alias("consumption_qty"), F.sum("month_end_stock").alias("month_end_stock"))


@query("com_customs_unit_price", "SELECT date_trunc('month', l_shipdate)::DATE AS month, p_type AS code, round(sum(l_extendedprice) / sum(l_quantity), 5) AS unit_price FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 GROUP BY 1, 2")
def com_unit_price(spark, sf):
    li, p = b.table(spark, sf, "lineitem").where("l_quantity > 0"), b.table(spark, sf, "part")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).groupBy(F.trunc("l_shipdate", "MM").alias("month"), F.col("p_type").alias("code")).agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 5).alias("unit_price"))


def flows(spark, sf):
    """Flows of each month, code and country. Every reader needs them at most that fine, so they are summed while lineitem passes once and written: a row per month, code and country, whatever lineitem's size.

    Orders meet their customers first, so lineitem is dealt out once for both, and names of codes come last.
    """
    li, p, s, o, c = (b.table(spark, sf, t) for t in ("lineitem", "part", "supplier", "orders", "customer"))
    buyers = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_nationkey")
    j = li.select("l_orderkey", "l_partkey", "l_suppkey", F.trunc("l_shipdate", "MM").alias("month"), "l_quantity", "l_extendedprice").join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("l_suppkey") == s["s_suppkey"])
    out = F.when(F.col("c_nationkey") != F.col("s_nationkey"), F.col("l_quantity") / 2).otherwise(0.0)
    rows = j.select("l_partkey", "month", F.col("s_nationkey").cast("string").alias("country_code"), F.when(F.col("l_quantity") > 3, F.col("l_extendedprice")).otherwise(0.0).alias("import_value"), F.col("l_quantity").alias("import_weight"), out.alias("export_weight"), (out * 1000).alias("export_value"))
    coded = rows.join(p.select("p_partkey", F.col("p_type").alias("hs_code")), F.col("l_partkey") == F.col("p_partkey"))
    return stored(op.country_flows(coded), "flows")


FLOWS = """flows AS (SELECT date_trunc('month', l_shipdate)::DATE AS month, p_type AS hs_code, CAST(s_nationkey AS VARCHAR) AS country_code, CASE WHEN l_quantity > 3 THEN l_extendedprice ELSE 0 END AS import_value, l_quantity AS import_weight, CASE WHEN c_nationkey <> s_nationkey THEN l_quantity / 2 ELSE 0 END AS export_weight, CASE WHEN c_nationkey <> s_nationkey THEN l_quantity / 2 ELSE 0 END * 1000 AS export_value
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
tt AS (SELECT month, hs_code, sum(import_value) AS import_value, sum(import_weight) AS import_weight, sum(export_value) AS export_value, sum(export_weight) AS export_weight, sum(import_value) / nullif(sum(import_weight), 0) AS unit_value, greatest(sum(import_value) - sum(export_value), 0) AS net_import FROM flows GROUP BY 1, 2)"""
TRADE = FLOWS + """,
tl AS (SELECT *, ln(unit_value) - ln(lag(unit_value) OVER w) AS dl, sum(CAST(import_value > 0 AS INTEGER)) OVER w AS island, coalesce(max(import_value) OVER (PARTITION BY hs_code ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) > 0, FALSE) AS prior_positive FROM tt WINDOW w AS (PARTITION BY hs_code ORDER BY month)),
tw AS (SELECT *, CASE WHEN count(import_value) OVER s >= 3 THEN stddev_pop(import_value) OVER s / nullif(avg(import_value) OVER s, 0) END AS import_cv, CASE WHEN count(dl) OVER s >= 3 THEN stddev_pop(dl) OVER s END AS price_volatility, CAST(sum(CAST(import_value <= 0 AS INTEGER)) OVER (PARTITION BY hs_code, island ORDER BY month) AS BIGINT) AS zero_streak FROM tl WINDOW s AS (PARTITION BY hs_code ORDER BY month ROWS 5 PRECEDING)),
ty AS (SELECT t.*, t.import_value / nullif(p.import_value, 0) - 1 AS import_value_yoy, t.unit_value / nullif(p.unit_value, 0) - 1 AS unit_value_yoy FROM tw t LEFT JOIN tt p ON p.hs_code = t.hs_code AND p.month = t.month - INTERVAL 1 YEAR),
tc AS (SELECT month, hs_code, max(share) AS top1, sum(share * share) AS hhi, count(*) FILTER (WHERE v > 0) AS suppliers, least(sum(v) / nullif(first(total), 0), 1) AS coverage FROM (SELECT month, hs_code, country_code, sum(flows.import_value) AS v, first(tt.import_value) AS total, least(greatest(sum(flows.import_value) / nullif(first(tt.import_value), 0), 0), 1) AS share FROM flows JOIN tt USING (month, hs_code) GROUP BY 1, 2, 3) GROUP BY 1, 2),
tr AS (SELECT *, CASE WHEN import_value_yoy IS NOT NULL THEN least(greatest(-import_value_yoy / 0.5, 0), 1) END AS fall_risk, least(greatest((hhi - 0.1) / 0.4, 0), 1) AS concentration_risk, CASE WHEN import_cv IS NOT NULL THEN least(greatest(import_cv, 0), 1) END AS volatility_risk, CASE WHEN unit_value_yoy IS NOT NULL THEN least(greatest(unit_value_yoy / 0.5, 0), 1) END AS price_risk, CASE WHEN prior_positive AND zero_streak > 0 THEN 1.0 ELSE 0.0 END AS interruption_risk FROM ty JOIN tc USING (month, hs_code)),
ts AS (SELECT *, 0.25 * coalesce(fall_risk, 0) + 0.2 * coalesce(concentration_risk, 0) + 0.15 * coalesce(volatility_risk, 0) + 0.2 * coalesce(price_risk, 0) + 0.2 * interruption_risk AS trade_score, CAST(0.25 * CAST(fall_risk IS NOT NULL AS INTEGER) + 0.2 + 0.15 * CAST(volatility_risk IS NOT NULL AS INTEGER) + 0.2 * CAST(price_risk IS NOT NULL AS INTEGER) + 0.2 AS DOUBLE) AS trade_confidence FROM tr)"""


def totals(spark, sf):
    return op.trade_totals(flows(spark, sf))


def trade(spark, sf, f=None):
    f = flows(spark, sf) if f is None else f
    t = op.trade_totals(f)
    y = op.year_ago(t, ["import_value", "unit_value"]).select("month", "hs_code", "import_value_yoy", "unit_value_yoy")
    return op.trade_components(op.trade_windows(t).join(y, ["month", "hs_code"]).join(op.concentration(f, t), ["month", "hs_code"]))


R = lambda *cs: [F.round(c, 5).alias(c) for c in cs]
S = lambda *cs: ", ".join(f"round({c}, 5) AS {c}" for c in cs)


@query("trd_totals", f"WITH {FLOWS} SELECT month, hs_code, round(import_value, 2) AS import_value, import_weight, {S('unit_value')}, round(net_import, 2) AS net_import FROM tt")
def trd_totals(spark, sf):
    return totals(spark, sf).select("month", "hs_code", F.round("import_value", 2).alias("import_value"), "import_weight", *R("unit_value"), F.round("net_import", 2).alias("net_import"))


@query("trd_rolling_and_streak", f"WITH {TRADE} SELECT month, hs_code, {S('import_cv', 'price_volatility')}, prior_positive, zero_streak FROM tw")
def trd_windows(spark, sf):
    return op.trade_windows(totals(spark, sf)).select("month", "hs_code", *R("import_cv", "price_volatility"), "prior_positive", "zero_streak")


@query("trd_year_ago", f"WITH {TRADE} SELECT month, hs_code, {S('import_value_yoy', 'unit_value_yoy')} FROM ty")
def trd_year(spark, sf):
    return op.year_ago(totals(spark, sf), ["import_value", "unit_value"]).select("month", "hs_code", *R("import_value_yoy", "unit_value_yoy"))


@query("trd_concentration", f"WITH {TRADE} SELECT month, hs_code, {S('top1', 'hhi', 'coverage')}, suppliers FROM tc")
def trd_concentration(spark, sf):
    f = flows(spark, sf)
    return op.concentration(f, op.trade_totals(f)).select("month", "hs_code", *R("top1", "hhi", "coverage"), "suppliers")


@query("trd_component_scores", f"WITH {TRADE} SELECT month, hs_code, {S('fall_risk', 'concentration_risk', 'volatility_risk', 'price_risk', 'trade_score', 'trade_confidence')} FROM ts")
def trd_components(spark, sf):
    return trade(spark, sf).select("month", "hs_code", *R("fall_risk", "concentration_risk", "volatility_risk", "price_risk", "trade_score", "trade_confidence"))


@query("trd_event_codes", f"""WITH {TRADE} SELECT month, hs_code, concat_ws(';', CASE WHEN round(fall_risk, 9) >= 0.3 THEN 'FALL' END, CASE WHEN round(concentration_risk, 9) >= 0.3 THEN 'CONCENTRATION' END, CASE WHEN round(volatility_risk, 9) >= 0.3 THEN 'VOLATILITY' END, CASE WHEN round(price_risk, 9) >= 0.3 THEN 'PRICE' END, CASE WHEN interruption_risk >= 0.3 THEN 'INTERRUPTION' END) AS event_codes FROM ts""")
def trd_codes(spark, sf):
    return trade(spark, sf).select("month", "hs_code", "event_codes")


def trade_paths(spark, sf):
    """Brands reach types with effective dates."""
    p = b.table(spark, sf, "part")
    g = p.groupBy(F.col("p_brand").alias("stock_item_key"), F.col("p_type").alias("hs_code")).agg(F.avg(F.col("p_size") / 50).alias("weight"), F.min("p_size").alias("k"))
    return g.select("stock_item_key", "hs_code", "weight", F.expr("date_add(date'1995-01-01', k * 30)").alias("valid_from"), F.expr("date_add(date'1999-01-01', k * 20)").alias("valid_to"))


def propagated(spark, sf):
    seen = fea.fact(spark, sf).select(F.col("year_month").alias("month"), F.col("item_code").alias("stock_item_key"))
    return op.propagate_trade(trade(spark, sf), trade_paths(spark, sf), seen)


PROP = TRADE + """,
tp AS (SELECT p_brand AS stock_item_key, p_type AS hs_code, avg(p_size / 50) AS weight, DATE '1995-01-01' + min(p_size) * 30 AS valid_from, DATE '1999-01-01' + min(p_size) * 20 AS valid_to FROM part GROUP BY 1, 2),
ob AS (SELECT DISTINCT date_trunc('month', l_shipdate)::DATE AS month, p_brand AS stock_item_key FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
px AS (SELECT month, stock_item_key, hs_code, least(trade_score * weight, 1) AS x FROM ob JOIN tp USING (stock_item_key) JOIN ts USING (month, hs_code) WHERE month BETWEEN valid_from AND valid_to),
pr AS (SELECT month, stock_item_key, 1 - exp(sum(ln(greatest(1 - x, 1e-12)))) AS trade_risk, array_to_string(list_sort(list(DISTINCT hs_code)), ';') AS hs_codes, count(*) AS paths FROM px GROUP BY 1, 2)"""


@query("trd_item_propagation", f"WITH {PROP} SELECT month, stock_item_key, {S('trade_risk')}, hs_codes, paths FROM pr")
def trd_propagation(spark, sf):
    return propagated(spark, sf).select("month", "stock_item_key", *R("trade_risk"), "hs_codes", "paths")


@query("trd_threshold_calibration", f"WITH {TRADE} SELECT hs_code, count(*) FILTER (WHERE unit_value_yoy > 0) AS n, round(CASE WHEN count(*) FILTER (WHERE unit_value_yoy > 0) >= 10 THEN quantile_cont(unit_value_yoy, 0.9) FILTER (WHERE unit_value_yoy > 0) ELSE 0.5 END, 5) AS threshold FROM ty GROUP BY 1")
def trd_threshold(spark, sf):
    y = op.year_ago(totals(spark, sf), ["unit_value"])
    return op.positive_quantile(y, ["hs_code"], "unit_value_yoy", 0.9, 0.5).select("hs_code", "n", *R("threshold"))


@query("trd_chronological_split", f"WITH {FLOWS}, m AS (SELECT month, row_number() OVER (ORDER BY month DESC) AS k FROM (SELECT DISTINCT month FROM tt)) SELECT month, hs_code, CASE WHEN k <= 6 THEN 'test' WHEN k <= 12 THEN 'validation' ELSE 'train' END AS split FROM tt JOIN m USING (month)")
def trd_split(spark, sf):
    return op.chronological(totals(spark, sf), "month", 6, 6).select("month", "hs_code", "split")


@query("trd_collection_completeness", f"""WITH {FLOWS}, e AS (SELECT n_nationkey::VARCHAR AS country_code, hs_code FROM nation, (SELECT DISTINCT hs_code FROM flows)), d AS (SELECT DISTINCT country_code, hs_code FROM flows WHERE month >= DATE '2001-10-01')
SELECT country_code, hs_code FROM e ANTI JOIN d USING (country_code, hs_code)""")
def trd_completeness(spark, sf):
    """Expected pairs of the country list and the code list (both small dimensions) without flows since a month."""
    f = flows(spark, sf)
    codes = f.select("hs_code").distinct()
    want = b.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("country_code")).join(F.broadcast(codes), F.lit(True))
    return want.join(f.where("month >= '2001-10-01'").select("country_code", "hs_code").distinct(), ["country_code", "hs_code"], "left_anti")


def signals(spark, sf):
    """news, market and trade signals for fusion, by type and month."""
    li, p = b.table(spark, sf, "lineitem"), b.table(spark, sf, "part")
    j = li.join(p, li["l_partkey"] == p["p_partkey"]).withColumns({"month": F.trunc("l_shipdate", "MM"), "stock_item_key": F.concat_ws("::", "p_brand", "p_type")})
    news = j.where("l_linenumber <= 3").groupBy("month", "stock_item_key").agg((F.max("l_discount") * 8).alias("disease_news_risk"), (F.max("l_tax") * 10).alias("supply_news_risk"), (F.min("l_tax") * 10).alias("material_news_risk"), F.avg("l_discount").alias("news_confidence"), (F.max("l_linenumber") > 1).alias("material_approved"), (F.min("l_linenumber") > 1).alias("demand_approved"), F.lit("N1;").alias("news_codes"))
    market = j.where("l_linenumber in (3, 4, 5)").groupBy("month", "stock_item_key").agg((F.max("l_tax") * 9).alias("commodity_risk"), F.avg("l_tax").alias("market_confidence"), F.lit(";M1").alias("market_codes"))
    trade_ = j.where("l_linenumber >= 6").groupBy("month", "stock_item_key").agg((F.max("l_discount") * 9).alias("trade_risk"), F.avg("l_tax").alias("trade_confidence"), F.lit("").alias("trade_codes"))
    return news, market, trade_


FUSE = """sj AS (SELECT *, date_trunc('month', l_shipdate)::DATE AS month, p_brand || '::' || p_type AS stock_item_key FROM lineitem JOIN part ON l_partkey = p_partkey),
ne AS (SELECT month, stock_item_key, max(l_discount) * 8 AS disease_news_risk, max(l_tax) * 10 AS supply_news_risk, min(l_tax) * 10 AS material_news_risk, avg(l_discount) AS news_confidence, max(l_linenumber) > 1 AS material_approved, min(l_linenumber) > 1 AS demand_approved, 'N1' AS nc FROM sj WHERE l_linenumber <= 3 GROUP BY 1, 2),
ma AS (SELECT month, stock_item_key, max(l_tax) * 9 AS commodity_risk, avg(l_tax) AS market_confidence, 'M1' AS mc FROM sj WHERE l_linenumber IN (3, 4, 5) GROUP BY 1, 2),
tq AS (SELECT month, stock_item_key, max(l_discount) * 9 AS trade_risk, avg(l_tax) AS trade_confidence FROM sj WHERE l_linenumber >= 6 GROUP BY 1, 2),
f0 AS (SELECT month, stock_item_key, coalesce(disease_news_risk, 0) AS dn, coalesce(supply_news_risk, 0) AS sn, coalesce(material_news_risk, 0) AS mn, coalesce(news_confidence, 0) AS c1, coalesce(commodity_risk, 0) AS cr, coalesce(market_confidence, 0) AS c2, coalesce(trade_risk, 0) AS t, coalesce(trade_confidence, 0) AS c3, coalesce(material_approved, FALSE) AS mg, coalesce(demand_approved, FALSE) AS dg, concat_ws(';', nc, mc) AS event_codes
  FROM ne FULL JOIN ma USING (month, stock_item_key) FULL JOIN tq USING (month, stock_item_key)),
f1 AS (SELECT *, CASE WHEN dg THEN dn ELSE 0 END AS demand_risk, CASE WHEN mg OR cr > 0 OR t > 0 THEN least(greatest(sn, 0.8 * mn, 0.7 * cr, 0), 1) ELSE 0 END AS base_supply FROM f0),
f2 AS (SELECT *, CASE WHEN t > 0 THEN 1 - (1 - base_supply) * (1 - 0.224 * t) ELSE base_supply END AS supply_risk FROM f1),
fu AS (SELECT *, greatest(demand_risk, supply_risk) AS total_risk, coalesce((c1 + c2 + c3) / nullif(CAST(c1 > 0 AS INTEGER) + CAST(c2 > 0 AS INTEGER) + CAST(c3 > 0 AS INTEGER), 0), 0) AS confidence, CASE WHEN demand_risk > supply_risk THEN 'demand' ELSE 'supply' END AS driver FROM f2)"""
LEVEL = "CASE WHEN total_risk >= 0.75 THEN 'critical' WHEN total_risk >= 0.55 THEN 'warning' WHEN total_risk >= 0.3 THEN 'watch' ELSE 'normal' END"


def fused(spark, sf):
    return op.fuse(*signals(spark, sf))


@query("rsk_signal_fusion", f"WITH {FUSE} SELECT month, stock_item_key, {S('demand_risk', 'base_supply', 'supply_risk', 'total_risk', 'confidence')}, round(supply_risk - base_supply, 5) AS trade_contribution, event_codes FROM fu")
def rsk_fusion(spark, sf):
    return fused(spark, sf).select("month", "stock_item_key", *R("demand_risk", "base_supply", "supply_risk", "total_risk", "confidence", "trade_contribution"), "event_codes")


@query("rsk_alerts", f"WITH {FUSE} SELECT month, stock_item_key, {LEVEL} AS risk_level, driver FROM fu WHERE total_risk >= 0.3")
def rsk_alerts(spark, sf):
    return fused(spark, sf).where("total_risk >= 0.3").select("month", "stock_item_key", "risk_level", "driver")


@query("rsk_audit_long", f"""WITH {FUSE}, l AS (SELECT * FROM fu WHERE month = (SELECT max(month) FROM fu)), a AS (SELECT month, stock_item_key, 'disease_news_risk' AS signal, dn AS value, 1.0 AS weight FROM l UNION ALL SELECT month, stock_item_key, 'supply_news_risk', sn, 1.0 FROM l UNION ALL SELECT month, stock_item_key, 'material_news_risk', mn, 0.8 FROM l UNION ALL SELECT month, stock_item_key, 'commodity_risk', cr, 0.7 FROM l UNION ALL SELECT month, stock_item_key, 'trade_risk', t, 0.224 FROM l)
SELECT month, stock_item_key, signal, round(value, 5) AS value, CAST(weight AS DOUBLE) AS weight, round(value * weight, 5) AS contribution FROM a""")
def rsk_audit(spark, sf):
    return op.audit(fused(spark, sf), latest_only=True).select("month", "stock_item_key", "signal", *R("value"), "weight", *R("contribution"))


@query("rsk_run_report", f"WITH {FUSE} SELECT {LEVEL} AS risk_level, count(*) AS rows, count(DISTINCT stock_item_key) AS items, count(DISTINCT month) AS months FROM fu GROUP BY 1")
def rsk_report(spark, sf):
    return fused(spark, sf).groupBy("risk_level").agg(F.count("*").alias("rows"), F.count_distinct("stock_item_key").alias("items"), F.count_distinct("month").alias("months"))
