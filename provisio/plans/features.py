"""Feature queries on the nation x brand series, which have gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio.operators import features as op
from provisio.operators import ledger as led
from provisio.plans import bindings as b
from provisio.registry import query

KEY = ["institution_code", "item_code"]
ID = "year_month, institution_code, item_code"
IDS = ["year_month", *KEY]
W = "PARTITION BY institution_code, item_code, segment ORDER BY year_month"


def fact(spark, sf):
    rows = led.flagged(b.ledger(spark, sf).withColumn("year_month", F.trunc("closing_date", "MM")))
    f = rows.groupBy("year_month", *KEY).agg(
        F.sum("consumption_qty").alias("consumption_qty"), F.sum(F.col("purchase_in_qty") + F.col("transfer_in_qty") + F.col("return_in_qty")).alias("inbound_qty"),
        F.max_by("closing_stock", F.when(F.col("closing_stock").isNotNull(), F.struct(*b.ORDER))).alias("month_end_stock"),
        F.try_divide(F.count_if(F.col("closing_stock") == 0), F.count("closing_stock")).alias("stockout_rate"), F.sum("disposal_qty").alias("disposal_qty"), F.sum("auto_disposal_adjustment_qty").alias("auto_disposal_adjustment_qty"))
    return f.withColumn("stock_item_key", F.concat_ws("::", *KEY))


SEG = b.SERIES_FACT + f""",
seg0 AS (SELECT *, CASE WHEN consumption_qty >= 0 THEN consumption_qty END AS demand, CASE WHEN year_month = lag(year_month) OVER (PARTITION BY institution_code, item_code ORDER BY year_month) + INTERVAL 1 MONTH THEN 0 ELSE 1 END AS brk FROM sfact),
seg1 AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY institution_code, item_code ORDER BY year_month) AS BIGINT) AS segment, row_number() OVER (PARTITION BY institution_code, item_code ORDER BY year_month) AS series_observation_count FROM seg0),
seg AS (SELECT *, row_number() OVER ({W}) AS history_months FROM seg1)"""
LAG = ", ".join(f"lag({c}, {k - 1}) OVER ({W}) AS {c}_lag_{k}" for c, ks in op.LAGS.items() for k in ks)
LAGCOLS = [f"{c}_lag_{k}" for c, ks in op.LAGS.items() for k in ks]
ROLL = ", ".join(f"avg(demand) OVER ({W} ROWS {n - 1} PRECEDING) AS rolling_mean_{n}, stddev_samp(demand) OVER ({W} ROWS {n - 1} PRECEDING) AS rolling_std_{n}" for n in (3, 6, 12))
ROLL += f""", median(demand) OVER ({W} ROWS 2 PRECEDING) AS rolling_median_3, avg(demand) OVER ({W} ROWS UNBOUNDED PRECEDING) AS expanding_mean,
  avg(CAST(demand = 0 AS DOUBLE)) OVER ({W} ROWS 5 PRECEDING) AS zero_rate_6, avg(CAST(demand = 0 AS DOUBLE)) OVER ({W} ROWS 11 PRECEDING) AS zero_rate_12"""
ROLLCOLS = [*(f"rolling_{k}_{n}" for n in (3, 6, 12) for k in ("mean", "std")), "rolling_median_3", "expanding_mean", "zero_rate_6", "zero_rate_12"]
FEAT = SEG + f""",
feat AS (SELECT *, {LAG}, {ROLL}, lead(demand) OVER ({W}) AS target_next_month, (year_month + INTERVAL 1 MONTH)::DATE AS forecast_month FROM seg)"""


def table(spark, sf):
    return op.feature_table(fact(spark, sf), KEY)


@query("fea_time", f"WITH {b.SERIES_FACT} SELECT {ID}, (year_month + INTERVAL 1 MONTH)::DATE AS forecast_month, CAST(year(year_month + INTERVAL 1 MONTH) AS INTEGER) AS forecast_year, CAST(month(year_month + INTERVAL 1 MONTH) AS INTEGER) AS forecast_month_of_year, CAST(quarter(year_month + INTERVAL 1 MONTH) AS INTEGER) AS forecast_quarter FROM sfact")
def fea_time(spark, sf):
    return op.time_features(fact(spark, sf)).select(*IDS, "forecast_month", "forecast_year", "forecast_month_of_year", "forecast_quarter")


@query("fea_demand_definition", f"WITH {b.SERIES_FACT} SELECT {ID}, CAST(consumption_qty < 0 AS INTEGER) AS negative_demand, CASE WHEN consumption_qty >= 0 THEN consumption_qty END AS demand FROM sfact")
def fea_demand(spark, sf):
    return op.demand(fact(spark, sf)).select(*IDS, "negative_demand", "demand")


@query("fea_segments", f"WITH {SEG} SELECT {ID}, segment, history_months, series_observation_count FROM seg")
def fea_segments(spark, sf):
    return op.segments(fact(spark, sf), KEY).select(*IDS, F.col("segment").cast("long").alias("segment"), "history_months", "series_observation_count")


@query("fea_lags", f"WITH {FEAT} SELECT {ID}, {', '.join(f'round({c}, 6) AS {c}' for c in LAGCOLS)} FROM feat")
def fea_lags(spark, sf):
    return op.lags(op.segments(op.demand(fact(spark, sf)), KEY), KEY).select(*IDS, *(F.round(c, 6).alias(c) for c in LAGCOLS))


@query("fea_rolling", f"WITH {FEAT} SELECT {ID}, {', '.join(f'round({c}, 5) AS {c}' for c in ROLLCOLS)} FROM feat")
def fea_rolling(spark, sf):
    return op.rolling(op.segments(op.demand(fact(spark, sf)), KEY), KEY).select(*IDS, *(F.round(c, 5).alias(c) for c in ROLLCOLS))


@query("fea_target", f"WITH {FEAT} SELECT {ID}, target_next_month FROM feat")
def fea_target(spark, sf):
    return op.target(op.segments(op.demand(fact(spark, sf)), KEY), KEY).select(*IDS, "target_next_month")


@query("fea_season_yoy", f"""WITH {FEAT} SELECT {ID}, CAST(month(forecast_month) IN (12, 1, 2) AS INTEGER) AS is_winter, CAST(month(forecast_month) IN (6, 7, 8) AS INTEGER) AS is_summer, demand_lag_12 AS same_month_last_year,
  round(coalesce((demand_lag_1 - demand_lag_12) / nullif(demand_lag_12, 0), 0), 6) AS yoy FROM feat""")
def fea_season(spark, sf):
    return table(spark, sf).select(*IDS, "is_winter", "is_summer", "same_month_last_year", F.round("yoy", 6).alias("yoy"))


@query("fea_external_join", f"""WITH {b.SERIES_FACT}, ext AS (SELECT date_trunc('month', o_orderdate)::DATE AS year_month, CAST(c_nationkey AS VARCHAR) AS institution_code, round(avg(o_totalprice), 2) AS order_value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT {ID}, order_value FROM sfact LEFT JOIN ext USING (year_month, institution_code)""")
def fea_external(spark, sf):
    o, c = b.table(spark, sf, "orders"), b.table(spark, sf, "customer")
    ext = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.trunc("o_orderdate", "MM").alias("year_month"), F.col("c_nationkey").cast("string").alias("institution_code")).agg(F.round(F.avg("o_totalprice"), 2).alias("order_value"))
    return op.with_external(fact(spark, sf), ext, ["year_month", "institution_code"], ["order_value"]).select(*IDS, "order_value")


def risk(spark, sf):
    """Item-month signals from discounts and taxes; some items have none."""
    li, pa, su = (b.table(spark, sf, t) for t in ("lineitem", "part", "supplier"))
    j = li.join(pa, li["l_partkey"] == pa["p_partkey"]).join(su, li["l_suppkey"] == su["s_suppkey"]).where("l_discount > 0.05")
    return j.groupBy(F.trunc("l_shipdate", "MM").alias("year_month"), F.concat_ws("::", F.col("s_nationkey").cast("string"), "p_brand").alias("stock_item_key")).agg(F.max("l_discount").alias("news_risk"), F.max("l_tax").alias("commodity_risk"))


RISK = "risk AS (SELECT date_trunc('month', l_shipdate)::DATE AS year_month, CAST(s_nationkey AS VARCHAR) || '::' || p_brand AS stock_item_key, max(l_discount) AS news_risk, max(l_tax) AS commodity_risk FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_discount > 0.05 GROUP BY 1, 2)"


@query("fea_risk_zero_fill", f"WITH {b.SERIES_FACT}, {RISK} SELECT {ID}, coalesce(news_risk, 0) AS news_risk, coalesce(commodity_risk, 0) AS commodity_risk, 0.0::DOUBLE AS fused_risk FROM sfact LEFT JOIN risk USING (year_month, stock_item_key)")
def fea_risk(spark, sf):
    return op.with_external(fact(spark, sf), risk(spark, sf), ["year_month", "stock_item_key"], ["news_risk", "commodity_risk", "fused_risk"], 0.0).select(*IDS, "news_risk", "commodity_risk", "fused_risk")


def split():
    return F.when(F.col("year_month") < "1998-01-01", "historical").when(F.col("year_month") < "2000-07-01", "train").when(F.col("year_month") < "2001-01-01", "validation").otherwise("test")


SPLIT_SQL = "CASE WHEN year_month < DATE '1998-01-01' THEN 'historical' WHEN year_month < DATE '2000-07-01' THEN 'train' WHEN year_month < DATE '2001-01-01' THEN 'validation' ELSE 'test' END"


@query("fea_signal_coverage", f"""WITH {b.SERIES_FACT}, {RISK},
j AS (SELECT {SPLIT_SQL} AS split, coalesce(news_risk, 0) AS n, coalesce(commodity_risk, 0) AS c FROM sfact LEFT JOIN risk USING (year_month, stock_item_key)),
l AS (SELECT split, 'news_risk' AS signal, n AS value FROM j UNION ALL SELECT split, 'commodity_risk', c FROM j)
SELECT split, signal, count(*) AS rows, count(*) FILTER (WHERE value <> 0) AS nonzero_rows, max(value) AS max_value, round(count(*) FILTER (WHERE value <> 0) / count(*), 6) AS ratio FROM l GROUP BY 1, 2""")
def fea_coverage(spark, sf):
    joined = op.with_external(fact(spark, sf), risk(spark, sf), ["year_month", "stock_item_key"], ["news_risk", "commodity_risk"], 0.0)
    found = op.coverage(joined, ["news_risk", "commodity_risk"], split())
    return found.withColumn("ratio", F.round("ratio", 6))


@query("fea_signal_gate", f"""WITH {b.SERIES_FACT}, {RISK}
SELECT 'news_risk' AS signal, count(*) FILTER (WHERE coalesce(news_risk, 0) <> 0) AS nonzero_rows FROM sfact LEFT JOIN risk USING (year_month, stock_item_key) WHERE {SPLIT_SQL} = 'train'""")
def fea_gate(spark, sf):
    joined = op.with_external(fact(spark, sf), risk(spark, sf), ["year_month", "stock_item_key"], ["news_risk"], 0.0)
    return op.enforce_coverage(op.coverage(joined, ["news_risk"], split()), ["news_risk"], 0.01).where("split = 'train'").select("signal", "nonzero_rows")


@query("fea_model_columns", f"WITH {FEAT} SELECT history_months, series_observation_count, round(rolling_mean_3, 5) AS rolling_mean_3, demand_lag_1, CAST(year(forecast_month) AS INTEGER) AS forecast_year FROM feat")
def fea_columns(spark, sf):
    t = table(spark, sf).withColumns({"news_risk": F.lit(0.0), "x_pred": F.lit(0.0)})
    cols = op.model_columns(t, news=False)
    return t.select(*cols).select("history_months", "series_observation_count", F.round("rolling_mean_3", 5).alias("rolling_mean_3"), "demand_lag_1", "forecast_year")


PRICES = "prices AS (SELECT p_brand AS factor, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def prices(spark, sf):
    li, pa = b.table(spark, sf, "lineitem"), b.table(spark, sf, "part")
    return li.join(pa, li["l_partkey"] == pa["p_partkey"]).groupBy(F.col("p_brand").alias("factor"), F.col("l_shipdate").cast("date").alias("date")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


@query("fea_price_volatility", f"""WITH {PRICES}, r AS (SELECT *, date_trunc('month', date)::DATE AS month, ln(price) - lag(ln(price)) OVER (PARTITION BY factor ORDER BY date) AS r FROM prices),
m AS (SELECT factor, month, count(*) AS n, stddev_samp(r) AS std, count(r) AS returns, avg(price) AS mean FROM r GROUP BY 1, 2),
u AS (SELECT factor, median(n) AS usual FROM m GROUP BY 1)
SELECT factor, month, round(CASE WHEN usual >= 5 THEN CASE WHEN returns >= 5 THEN std END ELSE abs(ln(mean) - lag(ln(mean)) OVER (PARTITION BY factor ORDER BY month)) END, 6) AS volatility FROM m JOIN u USING (factor)""")
def fea_volatility(spark, sf):
    return op.price_volatility(prices(spark, sf)).withColumn("volatility", F.round("volatility", 6))


@query("fea_demand_moments", f"""WITH {b.SERIES_FACT}
SELECT institution_code, item_code, round(avg(consumption_qty), 5) AS mean, round(stddev_samp(consumption_qty), 5) AS std, count(consumption_qty) AS n FROM sfact GROUP BY 1, 2 HAVING count(consumption_qty) >= 6 AND avg(consumption_qty) > 0 AND stddev_samp(consumption_qty) IS NOT NULL""")
def fea_moments(spark, sf):
    return op.moments(fact(spark, sf), KEY, "consumption_qty").select(*KEY, F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), "n")


@query("led_forecast_data_quality", f"""WITH {FEAT}, len AS (SELECT institution_code, item_code, segment, count(*) AS n FROM seg GROUP BY ALL)
SELECT (SELECT count(*) FROM len) AS segments, (SELECT median(n) FROM len) AS length_p50, (SELECT quantile_cont(n, 0.95) FROM len) AS length_p95, count(*) AS rows, count(*) FILTER (WHERE consumption_qty < 0) AS negative_rows,
  count(*) FILTER (WHERE demand = 0) AS zero_rows, count(*) FILTER (WHERE target_next_month IS NOT NULL) AS labelled_rows, count(*) FILTER (WHERE {SPLIT_SQL} = 'train' AND target_next_month IS NOT NULL) AS train_rows FROM feat""")
def data_quality(spark, sf):
    t = op.target(op.segments(op.demand(fact(spark, sf)), KEY), KEY)
    sizes = t.groupBy(*KEY, "segment").agg(F.count("*").alias("n")).agg(F.count("*").alias("segments"), F.percentile("n", F.lit(0.5)).alias("length_p50"), F.percentile("n", F.lit(0.95)).alias("length_p95"))
    has = F.col("target_next_month").isNotNull()
    counts = t.agg(F.count("*").alias("rows"), F.count_if(F.col("consumption_qty") < 0).alias("negative_rows"), F.count_if(F.col("demand") == 0).alias("zero_rows"), F.count_if(has).alias("labelled_rows"), F.count_if(has & (split() == "train")).alias("train_rows"))
    return sizes.join(F.broadcast(counts), F.lit(True))  # one row each
