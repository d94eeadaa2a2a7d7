"""Inventory and censored-demand queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio.operators import inventory as op
from provisio.plans import bindings as b
from provisio.plans import features as fea
from provisio.plans import forecast as fo
from provisio.plans import ledger as led
from provisio.registry import query

SERIES = list(b.SERIES)


def predictions(spark, sf):
    """The last labelled month of each series with a forecast, stock and made risks."""
    rows = fo.base(spark, sf).where("year_month >= '2001-06-01'").join(fea.risk(spark, sf), ["year_month", "stock_item_key"], "left")
    k = F.col("series_observation_count")
    return rows.select(*fea.IDS, "stock_item_key", F.col("rolling_mean_3_pred").alias("predicted_usage"), F.col("month_end_stock").alias("current_stock"), F.when(k % 4 != 0, (k % 200).cast("double")).alias("lead_time_days"), (k % 7).cast("double").alias("on_order_qty"), (k % 3).cast("double").alias("backorder_qty"),
        F.when(k % 2 == 0, F.coalesce(F.col("news_risk") * 10, F.lit(0.0))).alias("fused_risk"), F.coalesce("news_risk", F.lit(0.0)).alias("news_risk"), F.coalesce("commodity_risk", F.lit(0.0)).alias("commodity_risk"), (F.coalesce("news_risk", F.lit(0.0)) / 2).alias("trade_risk"),
        F.when(k % 5 != 0, "Yes").otherwise("no").alias("mapping_approved"), F.when(k % 13 == 0, "STALE").when(k % 11 == 0, "DORMANT").otherwise("ACTIVE").alias("status"))


PRED = fo.BASE + f""", {fea.RISK},
pr AS (SELECT year_month, institution_code, item_code, stock_item_key, rolling_mean_3_pred AS predicted_usage, month_end_stock AS current_stock, CASE WHEN series_observation_count % 4 <> 0 THEN CAST(series_observation_count % 200 AS DOUBLE) END AS lead_time_days,
  CAST(series_observation_count % 7 AS DOUBLE) AS on_order_qty, CAST(series_observation_count % 3 AS DOUBLE) AS backorder_qty, CASE WHEN series_observation_count % 2 = 0 THEN coalesce(news_risk * 10, 0) END AS fused_risk, coalesce(news_risk, 0) AS news_risk, coalesce(commodity_risk, 0) AS commodity_risk, coalesce(news_risk, 0) / 2 AS trade_risk,
  series_observation_count % 5 <> 0 AS ok, CASE WHEN series_observation_count % 13 = 0 THEN 'STALE' WHEN series_observation_count % 11 = 0 THEN 'DORMANT' ELSE 'ACTIVE' END AS status
  FROM base LEFT JOIN risk USING (year_month, stock_item_key) WHERE year_month >= DATE '2001-06-01'),
ga AS (SELECT *, CASE WHEN ok THEN least(greatest(news_risk, 0), 1) ELSE 0 END AS gate_news, CASE WHEN ok THEN least(greatest(news_risk, commodity_risk, 0), 1) ELSE 0 END AS gate_material, CASE WHEN ok THEN least(greatest(trade_risk, 0), 1) ELSE 0 END AS gate_trade,
  least(CASE WHEN lead_time_days IS NULL OR lead_time_days < 1 THEN 15.0::DOUBLE ELSE lead_time_days END, 120.0::DOUBLE) AS lead_days, predicted_usage / 30 AS daily, CASE WHEN fused_risk IS NOT NULL THEN least(greatest(fused_risk, 0), 1) END AS s FROM pr),
rec0 AS (SELECT *, daily * (30 + lead_days) AS protection, daily * (30 + lead_days) * 1.2 AS base_stock FROM ga),
rec AS (SELECT *, CASE WHEN s IS NOT NULL THEN least(greatest(daily * (1 + 0.35 * s) * (30 + lead_days * (1 + 0.5 * s) + 14 * s) * (1.2 + 0.25 * s) - base_stock, 0), 0.75 * protection) ELSE protection * least(0.2 * gate_news + 0.2 * gate_material + 0.1 * gate_trade, 0.5) END AS risk_buffer,
  coalesce(current_stock, 0) + on_order_qty - backorder_qty AS position FROM rec0)"""


@query("inv_recommendation", f"""WITH {PRED} SELECT {fea.ID}, lead_days, round(base_stock, 5) AS base_stock, round(risk_buffer, 5) AS risk_buffer, round(position, 5) AS position,
  round(CASE WHEN status = 'STALE' THEN NULL WHEN status = 'DORMANT' THEN 0 ELSE greatest(base_stock + risk_buffer - position, 0) END, 5) AS recommended_order FROM rec""")
def inv_recommendation(spark, sf):
    r = op.recommend(op.gated_risks(predictions(spark, sf)))
    return r.select(*fea.IDS, "lead_days", *(F.round(c, 5).alias(c) for c in ("base_stock", "risk_buffer", "position", "recommended_order")))


@query("inv_risk_gate", f"WITH {PRED} SELECT {fea.ID}, gate_news, gate_material, round(gate_trade, 6) AS gate_trade, round(0.4 * gate_news + 0.3 * gate_material + 0.3 * gate_trade, 6) AS external_risk FROM ga")
def inv_risk_gate(spark, sf):
    return op.gated_risks(predictions(spark, sf)).select(*fea.IDS, "gate_news", "gate_material", F.round("gate_trade", 6).alias("gate_trade"), F.round("external_risk", 6).alias("external_risk"))


@query("inv_lead_time_resolution", f"WITH {PRED} SELECT {fea.ID}, lead_days, lead_time_days IS NULL OR lead_time_days < 1 AS defaulted, coalesce(lead_time_days > 120, FALSE) AS capped FROM ga")
def inv_lead(spark, sf):
    c = F.col("lead_time_days")
    return predictions(spark, sf).select(*fea.IDS, op.resolved_lead(c).alias("lead_days"), (c.isNull() | (c < 1)).alias("defaulted"), F.coalesce(c > 120, F.lit(False)).alias("capped"))


STATUS = b.FACT + """,
mx AS (SELECT max(year_month) AS corpus_month, max(last_date) AS corpus_date FROM fact),
st0 AS (SELECT institution_code, department, item_code, max_by(month_end_stock, year_month) AS mes0, first(month_end_stock ORDER BY year_month DESC) AS month_end_stock, max(year_month) AS latest_month, max(last_date) AS last_date, min(first_date) AS first_date, sum(outbound_sum) AS total, sum(outbound_squared_sum) AS squares,
  coalesce(sum(outbound_sum) FILTER (WHERE year_month > corpus_month - INTERVAL 3 MONTH), 0) AS recent, CAST(sum(physical_violation_count) AS BIGINT) AS violations, first(corpus_date) AS corpus_date FROM fact, mx GROUP BY 1, 2, 3),
st AS (SELECT *, corpus_date - first_date + 1 AS days, total / (corpus_date - first_date + 1) AS mu, sqrt(greatest(squares / (corpus_date - first_date + 1) - power(total / (corpus_date - first_date + 1), 2), 0)) AS sigma, corpus_date - last_date AS lag_days, recent / 92 AS rate_92 FROM st0),
rs AS (SELECT *, CASE WHEN month_end_stock > 0 THEN 'IN_STOCK' WHEN coalesce(month_end_stock, 0) <= 0 AND recent <= 0 AND lag_days <= 180 THEN 'NOT_OPERATED' WHEN lag_days > 180 THEN 'STALE' WHEN month_end_stock IS NULL THEN 'DATA_MISSING' WHEN coalesce(month_end_stock, 0) <= 0 THEN 'TRUE_STOCKOUT' ELSE 'IN_STOCK' END AS reason FROM st),
gs AS (SELECT *, sum(greatest(coalesce(month_end_stock, 0), 0)) OVER (PARTITION BY institution_code, item_code) AS exact_stock, count(*) OVER (PARTITION BY institution_code, item_code) AS exact_series, sum(greatest(coalesce(month_end_stock, 0), 0)) OVER (PARTITION BY institution_code) AS broad_stock, count(*) OVER (PARTITION BY institution_code) AS broad_series FROM rs),
ac AS (SELECT *, CASE WHEN reason = 'TRUE_STOCKOUT' AND recent > 0 AND exact_stock <= 0 AND broad_stock <= 0 THEN 'URGENT_SHORTAGE' WHEN reason = 'TRUE_STOCKOUT' AND recent > 0 AND NOT (exact_stock > 0) AND broad_stock > 0 THEN 'COVERED_BY_FAMILY' WHEN reason = 'TRUE_STOCKOUT' AND recent > 0 AND exact_stock > 0 THEN 'COVERED_BY_EQUIVALENT'
  WHEN reason = 'TRUE_STOCKOUT' AND recent > 0 THEN 'SHORTAGE' WHEN reason IN ('STALE', 'DATA_MISSING', 'NOT_OPERATED') THEN reason WHEN reason = 'IN_STOCK' AND month_end_stock < mu * 15 THEN 'BELOW_REORDER_POINT' WHEN reason = 'IN_STOCK' AND month_end_stock < 1.2 * mu * 15 THEN 'WATCH' ELSE 'OK' END AS action FROM gs)"""
KEY = "institution_code, department, item_code"


def status(spark, sf):
    return op.series_status(led.fact(spark, sf), SERIES)


def reasons(spark, sf):
    return op.zero_stock_reason(status(spark, sf))


def actions(spark, sf):
    return op.action_status(op.group_stock(reasons(spark, sf), ["institution_code", "item_code"], ["institution_code"]))


@query("inv_series_status", f"WITH {STATUS} SELECT {KEY}, latest_month, month_end_stock, first_date, total, recent, violations, CAST(days AS INTEGER) AS days, round(mu, 6) AS mu, round(sigma, 5) AS sigma, CAST(lag_days AS INTEGER) AS lag_days, round(rate_92, 6) AS rate_92 FROM st")
def inv_status(spark, sf):
    return status(spark, sf).select(*SERIES, "latest_month", "month_end_stock", "first_date", "total", "recent", "violations", "days", F.round("mu", 6).alias("mu"), F.round("sigma", 5).alias("sigma"), "lag_days", F.round("rate_92", 6).alias("rate_92"))


@query("inv_zero_stock_reason", f"WITH {STATUS} SELECT {KEY}, reason FROM rs")
def inv_reason(spark, sf):
    return reasons(spark, sf).select(*SERIES, "reason")


@query("inv_group_stock", f"WITH {STATUS} SELECT {KEY}, exact_stock, exact_series, broad_stock, broad_series FROM gs")
def inv_group(spark, sf):
    return op.group_stock(reasons(spark, sf), ["institution_code", "item_code"], ["institution_code"]).select(*SERIES, "exact_stock", "exact_series", "broad_stock", "broad_series")


@query("inv_action_status", f"WITH {STATUS} SELECT {KEY}, action FROM ac")
def inv_action(spark, sf):
    return actions(spark, sf).select(*SERIES, "action")


@query("inv_status_funnel", f"WITH {STATUS} SELECT reason, action, count(*) AS series, count(*) FILTER (WHERE month_end_stock IS NOT NULL) AS with_stock, count(*) FILTER (WHERE recent > 0) AS with_demand FROM ac GROUP BY 1, 2")
def inv_funnel(spark, sf):
    return actions(spark, sf).groupBy("reason", "action").agg(F.count("*").alias("series"), F.count("month_end_stock").alias("with_stock"), F.count_if(F.col("recent") > 0).alias("with_demand"))


@query("inv_department_collapse", f"""WITH {STATUS}, c AS (SELECT institution_code, item_code, sum(total) AS total, sum(squares) AS squares, max(days) AS days, min(list_position(['TRUE_STOCKOUT', 'DATA_MISSING', 'STALE', 'NOT_OPERATED', 'IN_STOCK'], reason)) AS r, array_to_string(list_sort(list(DISTINCT reason)), ';') AS reasons, bool_and(reason = 'NOT_OPERATED') AS dormant FROM rs GROUP BY 1, 2)
SELECT institution_code, item_code, total, ['TRUE_STOCKOUT', 'DATA_MISSING', 'STALE', 'NOT_OPERATED', 'IN_STOCK'][r] AS reason, reasons, dormant, round(total / days, 6) AS mu, round(sqrt(greatest(squares / days - power(total / days, 2), 0)), 5) AS sigma FROM c""")
def inv_collapse(spark, sf):
    return op.collapse_departments(reasons(spark, sf), ["institution_code", "item_code"]).select("institution_code", "item_code", "total", "reason", "reasons", "dormant", F.round("mu", 6).alias("mu"), F.round("sigma", 5).alias("sigma"))


@query("inv_exclusion_proposals", f"WITH {STATUS} SELECT {KEY}, reason FROM ac WHERE reason = 'NOT_OPERATED' OR (reason = 'DATA_MISSING' AND recent <= 0)")
def inv_exclusions(spark, sf):
    return actions(spark, sf).where("reason = 'NOT_OPERATED' or (reason = 'DATA_MISSING' and recent <= 0)").select(*SERIES, "reason")


LEVEL = STATUS + """,
lv AS (SELECT *, 15.0::DOUBLE * CASE WHEN violations > 0 THEN 1.3 ELSE 1 END AS lead FROM st),
lp AS (SELECT *, 1.2816 * sigma * sqrt(lead) AS ss, mu * lead + 1.2816 * sigma * sqrt(lead) AS rop FROM lv)"""


def levels(spark, sf):
    rows = status(spark, sf).withColumns({"z": F.lit(1.2816), "lead_time_days": F.lit(None).cast("double"), "lead_multiplier": F.when(F.col("violations") > 0, 1.3).otherwise(1.0), "current_stock": F.coalesce("month_end_stock", F.lit(0.0))})
    return op.level_policy(rows)


@query("rsk_level_safety_stock", f"""WITH {LEVEL} SELECT {KEY}, round(ss, 5) AS safety_stock, round(rop, 5) AS reorder_point, round(mu * (lead + 30) + ss, 5) AS target,
  CASE WHEN coalesce(month_end_stock, 0) <= ss THEN 'CRITICAL' WHEN coalesce(month_end_stock, 0) < rop THEN 'BELOW_ROP' WHEN coalesce(month_end_stock, 0) < 1.2 * rop THEN 'WATCH' ELSE 'OK' END AS level_status FROM lp""")
def rsk_levels(spark, sf):
    return levels(spark, sf).select(*SERIES, F.round("safety_stock", 5).alias("safety_stock"), F.round("reorder_point", 5).alias("reorder_point"), F.round("target", 5).alias("target"), "level_status")


@query("inv_family_rollup", f"""WITH {LEVEL}, f AS (SELECT institution_code, item_code, sum(greatest(coalesce(month_end_stock, 0), 0)) AS available, sum(rop) AS rop, count(*) AS n FROM lp GROUP BY 1, 2)
SELECT institution_code, item_code, available, n, CASE WHEN available < rop THEN 'BELOW' WHEN available < 1.2 * rop THEN 'WATCH' ELSE 'OK' END AS family_status FROM f""")
def inv_family(spark, sf):
    return spark.sql("""WITH f AS (SELECT institution_code, item_code, sum(greatest(current_stock, 0)) AS available, sum(reorder_point) AS rop, count(*) AS n FROM {series_levels} GROUP BY 1, 2)
      SELECT institution_code, item_code, available, n, CASE WHEN available < rop THEN 'BELOW' WHEN available < 1.2 * rop THEN 'WATCH' ELSE 'OK' END AS family_status FROM f""", series_levels=levels(spark, sf))


@query("inv_lead_cap_effect", f"WITH {STATUS} SELECT cap, round(sum(1.2816 * sigma * sqrt(least(lag_days + 1, cap))), 3) AS safety_total, quantile_cont(lag_days + 1, 0.5) AS lead_p50, quantile_cont(lag_days + 1, 0.9) AS lead_p90 FROM st, (VALUES (30), (60), (90), (120)) v(cap) GROUP BY cap")
def inv_caps(spark, sf):
    caps = F.explode(F.array(*(F.lit(x) for x in (30, 60, 90, 120)))).alias("cap")
    lead = F.col("lag_days") + 1
    return status(spark, sf).select("sigma", "lag_days", caps).groupBy("cap").agg(F.round(F.sum(1.2816 * F.col("sigma") * F.sqrt(F.least(lead, F.col("cap")))), 3).alias("safety_total"), F.percentile(lead, F.lit(0.5)).alias("lead_p50"), F.percentile(lead, F.lit(0.9)).alias("lead_p90"))


@query("inv_floor_cap_flags", f"WITH {STATUS} SELECT {KEY}, abs(mu - 0.01) < 1e-9 OR mu < 0.01 AS at_floor, mu > 1 AS over_cap, round(least(greatest(mu, 0.01), 1), 6) AS clamped FROM st")
def inv_flags(spark, sf):
    mu = F.col("mu")
    return status(spark, sf).select(*SERIES, ((F.abs(mu - 0.01) < 1e-9) | (mu < 0.01)).alias("at_floor"), (mu > 1).alias("over_cap"), F.round(F.least(F.greatest(mu, F.lit(0.01)), F.lit(1.0)), 6).alias("clamped"))


@query("inv_stock_transition", f"""WITH {PRED}, t AS (SELECT *, coalesce(current_stock, 0) AS op, CASE WHEN lead_days <= 30 THEN on_order_qty ELSE 0 END AS inq FROM ga)
SELECT {fea.ID}, round(op + inq, 5) AS available, round(least(predicted_usage, op + inq), 5) AS fulfilled, round(predicted_usage - least(predicted_usage, op + inq), 5) AS unmet, round(op + inq - least(predicted_usage, op + inq), 5) AS closing, round(coalesce(least(predicted_usage, op + inq) / nullif(predicted_usage, 0), 1), 5) AS fill_rate FROM t""")
def inv_transition(spark, sf):
    rows = predictions(spark, sf).withColumns({"opening_stock": F.coalesce("current_stock", F.lit(0.0)), "order_qty": F.col("on_order_qty"), "lead_days": op.resolved_lead(F.col("lead_time_days")), "demand": F.col("predicted_usage")})
    return op.transition(rows).select(*fea.IDS, *(F.round(c, 5).alias(c) for c in ("available", "fulfilled", "unmet", "closing", "fill_rate")))


@query("inv_group_summary_outliers", f"WITH {b.FACT} SELECT item_code, sum(consumption_qty) AS usage, coalesce(sum(consumption_qty) FILTER (WHERE consumption_qty <= 45), 0) AS usage_without_outliers, count(*) FILTER (WHERE consumption_qty > 45) AS outlier_rows, round(avg(stockout_rate), 6) AS stockout_rate FROM fact GROUP BY 1")
def inv_outliers(spark, sf):
    q = F.col("consumption_qty")
    return led.fact(spark, sf).groupBy("item_code").agg(F.sum(q).alias("usage"), F.coalesce(F.sum(F.when(q <= 45, q)), F.lit(0.0)).alias("usage_without_outliers"), F.count_if(q > 45).alias("outlier_rows"), F.round(F.avg("stockout_rate"), 6).alias("stockout_rate"))


def daily(spark, sf):
    """Sparse daily stock from events: the last value of a day, 0 under 50; demand from purchases and views."""
    e = b.table(spark, sf, "events").withColumn("closing_date", F.col("ts").cast("date"))
    used = F.when(F.col("event_type").isin("purchase", "view"), F.col("value")).otherwise(0.0)
    stock = F.max_by("value", F.struct("ts", "event_id"))
    d = e.groupBy(F.col("user_id").alias("institution_code"), F.col("event_type").alias("item_code"), "closing_date").agg(stock.alias("v"), F.sum(used).alias("consumption_qty"))
    return d.select("institution_code", "item_code", "closing_date", F.when(F.col("v") >= 90, F.lit(None)).when(F.col("v") < 50, 0.0).otherwise(F.col("v")).alias("closing_stock"), "consumption_qty")


DAILY = """daily AS (SELECT user_id AS institution_code, event_type AS item_code, CAST(ts AS DATE) AS closing_date, first(value ORDER BY ts DESC, event_id DESC) AS v, sum(CASE WHEN event_type IN ('purchase', 'view') THEN value ELSE 0 END) AS consumption_qty FROM events GROUP BY 1, 2, 3),
dd AS (SELECT *, CASE WHEN v >= 90 THEN NULL WHEN v < 50 THEN 0 ELSE v END AS closing_stock, coalesce(lead(closing_date) OVER (PARTITION BY institution_code, item_code ORDER BY closing_date), DATE '2024-01-31') - closing_date AS d FROM daily),
sp AS (SELECT institution_code, item_code, count(*) AS transaction_days, sum(greatest(consumption_qty, 0)) AS demand_total, CAST(sum(d) AS BIGINT) AS total_days, CAST(coalesce(sum(d) FILTER (WHERE closing_stock <= 0), 0) AS BIGINT) AS zero_days, CAST(coalesce(sum(d) FILTER (WHERE closing_stock > 0), 0) AS BIGINT) AS held_days, CAST(coalesce(sum(d) FILTER (WHERE closing_stock IS NULL), 0) AS BIGINT) AS unknown_days FROM dd GROUP BY 1, 2),
sr AS (SELECT *, zero_days / nullif(total_days, 0) AS zero_ratio, (zero_days + held_days) / nullif(total_days, 0) AS coverage, demand_total / nullif(total_days, 0) AS naive_rate, demand_total / nullif(held_days, 0) AS available_rate FROM sp)"""
BUHL = DAILY + """,
im AS (SELECT item_code, sum(demand_total) / sum(held_days) AS item_mean FROM sr WHERE held_days > 0 GROUP BY 1),
iv AS (SELECT item_code, first(item_mean) AS item_mean, count(*) AS n, sum(held_days) AS exposure, sum(held_days * power(available_rate - item_mean, 2)) AS ss FROM sr JOIN im USING (item_code) WHERE held_days > 0 GROUP BY 1),
pm AS (SELECT *, ss / exposure - item_mean / (exposure / n) AS between_var FROM iv),
pk AS (SELECT *, CASE WHEN n >= 5 AND between_var > 0 THEN item_mean / between_var END AS k FROM pm),
cap AS (SELECT quantile_cont(k, 0.9) AS k_cap, quantile_cont(k, 0.5) AS k_mid FROM pk),
sh AS (SELECT sr.*, (item_mean * coalesce(least(k, k_cap), k_mid, 1) + demand_total) / (coalesce(least(k, k_cap), k_mid, 1) + held_days) AS shrunk, CASE WHEN coverage < 0.9 THEN 'NOT_VERIFIED' WHEN demand_total <= 0 THEN 'DORMANT' WHEN zero_ratio >= 0.5 THEN 'CENSORED' ELSE 'ACTIVE' END AS demand_class FROM sr LEFT JOIN pk USING (item_code), cap),
p95 AS (SELECT quantile_cont(shrunk / nullif(naive_rate, 0), 0.95) AS p95 FROM sh WHERE demand_class = 'ACTIVE'),
co AS (SELECT *, CASE WHEN demand_class = 'CENSORED' THEN least(shrunk, naive_rate * least(coalesce(p95, 8), 8)) WHEN demand_class = 'ACTIVE' THEN available_rate ELSE naive_rate END AS corrected_rate FROM sh, p95)"""


def spells(spark, sf):
    return op.spells(daily(spark, sf), ["institution_code", "item_code"], "2024-01-30")


def corrected(spark, sf):
    m = spells(spark, sf)
    return op.corrected(m, op.credibility(m))


DC = ["transaction_days", "total_days", "zero_days", "held_days", "unknown_days"]


@query("dem_interval_durations", f"WITH {DAILY} SELECT institution_code, item_code, {', '.join(DC)}, round(demand_total, 4) AS demand_total, round(zero_ratio, 6) AS zero_ratio, round(naive_rate, 5) AS naive_rate, round(available_rate, 5) AS available_rate FROM sr")
def dem_spells(spark, sf):
    return spells(spark, sf).select("institution_code", "item_code", *DC, F.round("demand_total", 4).alias("demand_total"), F.round("zero_ratio", 6).alias("zero_ratio"), F.round("naive_rate", 5).alias("naive_rate"), F.round("available_rate", 5).alias("available_rate"))


@query("dem_daily_collapse", f"WITH {DAILY} SELECT institution_code, item_code, closing_date, closing_stock, round(consumption_qty, 4) AS consumption_qty FROM dd")
def dem_daily(spark, sf):
    return daily(spark, sf).withColumn("consumption_qty", F.round("consumption_qty", 4))


@query("dem_item_rollup", f"WITH {DAILY}, g AS (SELECT item_code, sum(demand_total) AS demand_total, CAST(sum(total_days) AS BIGINT) AS total_days, CAST(sum(zero_days) AS BIGINT) AS zero_days, CAST(sum(held_days) AS BIGINT) AS held_days FROM sr GROUP BY 1) SELECT item_code, round(demand_total, 3) AS demand_total, total_days, zero_days, held_days, round(zero_days / total_days, 6) AS zero_ratio, round(demand_total / nullif(held_days, 0), 5) AS available_rate FROM g")
def dem_rollup(spark, sf):
    g = spells(spark, sf).groupBy("item_code").agg(*(F.sum(c).alias(c) for c in ("demand_total", "total_days", "zero_days", "held_days")))
    return op.rates(g).select("item_code", F.round("demand_total", 3).alias("demand_total"), "total_days", "zero_days", "held_days", F.round("zero_ratio", 6).alias("zero_ratio"), F.round("available_rate", 5).alias("available_rate"))


@query("dem_credibility", f"WITH {BUHL} SELECT item_code, n, round(item_mean, 5) AS item_mean, round(between_var, 4) AS between_var, round(k, 5) AS k FROM pk")
def dem_credibility(spark, sf):
    return op.credibility(spells(spark, sf)).select("item_code", "n", F.round("item_mean", 5).alias("item_mean"), F.round("between", 4).alias("between_var"), F.round("k", 5).alias("k"))


@query("dem_classify_correct", f"WITH {BUHL} SELECT institution_code, item_code, demand_class, round(shrunk, 5) AS shrunk, round(corrected_rate, 5) AS corrected_rate FROM co")
def dem_correct(spark, sf):
    return corrected(spark, sf).select("institution_code", "item_code", "demand_class", F.round("shrunk", 5).alias("shrunk"), F.round("corrected_rate", 5).alias("corrected_rate"))


@query("dem_release_gate", f"""WITH {BUHL}, a AS (SELECT count(*) AS rows, avg(CAST(demand_class = 'CENSORED' AS DOUBLE)) AS s, count(*) FILTER (WHERE corrected_rate < 0) AS invalid FROM co)
SELECT rows, round(s, 6) AS censored_share, invalid, CAST(0 AS BIGINT) AS duplicate_keys, CASE WHEN invalid > 0 THEN 'REVIEW' WHEN s BETWEEN 0.2 AND 0.25 THEN 'PASS' ELSE 'PASS_WITH_REVIEW' END AS gate FROM a""")
def dem_gate(spark, sf):
    return op.release_gate(corrected(spark, sf), ["institution_code", "item_code"]).withColumn("censored_share", F.round("censored_share", 6))
