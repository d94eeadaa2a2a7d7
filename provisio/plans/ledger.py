"""Ledger queries: cleaning, rules, the monthly fact, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio.functions import read_year_month, safe_divide
from provisio.operators import ledger as op
from provisio.plans import bindings as b
from provisio.registry import query


def rows(spark, sf):
    return op.flagged(b.ledger(spark, sf).withColumn("year_month", F.trunc("closing_date", "MM")))


def fact(spark, sf):
    return op.derived(op.monthly(rows(spark, sf), list(b.KEYS), list(b.ORDER)))


@query("led_normalize_rows", f"""WITH {b.LEDGER}
SELECT institution_code, department, item_code, item_name, closing_date, year_month, opening_stock, coalesce(purchase_in_qty, 0) AS purchase_in_qty, consumption_qty, l_orderkey, l_linenumber FROM ledger""")
def normalize_rows(spark, sf):
    raw = b.ledger(spark, sf)  # as text with stray blanks, as a landed file has it
    text = raw.select(
        F.concat(F.lit(" "), "institution_code").alias("institution_code"), F.concat("department", F.lit(" ")).alias("department"), "item_code", F.regexp_replace("item_name", " ", " \n ").alias("item_name"),
        F.date_format("closing_date", "yyyyMMdd").alias("closing_date"), F.col("opening_stock").cast("string").alias("opening_stock"), F.col("purchase_in_qty").cast("string").alias("purchase_in_qty"), F.col("consumption_qty").cast("string").alias("consumption_qty"), "l_orderkey", "l_linenumber")
    return op.normalized(text).select("institution_code", "department", "item_code", "item_name", "closing_date", "year_month", "opening_stock", "purchase_in_qty", "consumption_qty", "l_orderkey", "l_linenumber")


@query("led_quality_flags", f"""WITH {b.FLAGGED}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, physical_violation, document_violation, opening_missing, round(balance_residual, 6) AS balance_residual,
  CAST(abs(balance_residual) > 1e-9 AS INTEGER) AS balance_violation FROM flagged""")
def quality_flags(spark, sf):
    return rows(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "physical_violation", "document_violation", "opening_missing", F.round("balance_residual", 6).alias("balance_residual"), (F.abs("balance_residual") > 1e-9).cast("int").alias("balance_violation"))


@query("led_physical_available", f"""WITH {b.LEDGER}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(greatest(opening_stock, 0), 0) + greatest(purchase_in_qty, 0) + greatest(transfer_in_qty, 0) + greatest(return_in_qty, 0) AS available FROM ledger""")
def physical_available(spark, sf):
    return b.ledger(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", op.physical_available().alias("available"))


_COLS = ["year_month", "institution_code", "department", "item_code", "first_date", "last_date", "item_name", "month_start_stock", "month_end_stock", "min_stock", "max_stock", "stock_observation_count", "stockout_count", "negative_stock_count", "price_count", *op.MOVES, "outbound_sum", "outbound_squared_sum", "physical_violation_count", "document_violation_count", "opening_missing_count", "balance_violation_count", "row_count"]
_ROUND = ["price_sum", "balance_residual_sum", "stock_sum"]


@query("led_monthly_partial_final", f"""WITH {b.MONTHLY}
SELECT {', '.join(_COLS)}, {', '.join(f'round({c}, 8) AS {c}' for c in _ROUND)} FROM monthly""")
def monthly_partial_final(spark, sf):
    return op.monthly(rows(spark, sf), list(b.KEYS), list(b.ORDER)).select(*_COLS, *(F.round(c, 8).alias(c) for c in _ROUND))


_DERIVED = ["average_stock", "average_unit_price", "stockout_rate"]


@query("led_monthly_fact", f"""WITH {b.FACT}
SELECT year_month, stock_item_key, inbound_qty, other_outbound_qty, net_stock_change, consumption_qty, month_end_stock, {', '.join(f'round({c}, 9) AS {c}' for c in _DERIVED)} FROM fact""")
def monthly_fact(spark, sf):
    return fact(spark, sf).select("year_month", "stock_item_key", "inbound_qty", "other_outbound_qty", "net_stock_change", "consumption_qty", "month_end_stock", *(F.round(c, 9).alias(c) for c in _DERIVED))


@query("led_corpus_summary", f"""WITH {b.FACT}
SELECT count(*) AS rows, min(year_month) AS first_month, max(year_month) AS last_month, count(DISTINCT year_month) AS months, count(DISTINCT institution_code) AS institutions, count(DISTINCT department) AS departments,
  count(DISTINCT item_code) AS items, count(DISTINCT stock_item_key) AS series, CAST(sum(balance_violation_count) AS BIGINT) AS balance_violations, CAST(sum(physical_violation_count) AS BIGINT) AS physical_violations FROM fact""")
def corpus_summary(spark, sf):
    return op.summary(fact(spark, sf))


@query("led_safe_divide_and_month", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN 0.0::DOUBLE ELSE round(l_extendedprice / (l_linenumber % 3), 4) END AS ratio,
  date_trunc('month', l_shipdate)::DATE AS month FROM lineitem""")
def safe_divide_and_month(spark, sf):
    li = b.table(spark, sf, "lineitem")
    code = F.date_format("l_shipdate", "yyyyMM").cast("int")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(safe_divide(F.col("l_extendedprice"), F.col("l_linenumber") % 3), 4).alias("ratio"), read_year_month(code).alias("month"))


@query("led_issue_quantity_distribution", f"""WITH {b.LEDGER},
s AS (SELECT consumption_qty AS q, count(*) AS n FROM ledger WHERE consumption_qty > 0 GROUP BY 1),
c AS (SELECT *, sum(n) OVER (ORDER BY q) AS cum, sum(n) OVER () AS total FROM s)
SELECT min(q) FILTER (WHERE cum >= 0.25 * total) AS p25, min(q) FILTER (WHERE cum >= 0.5 * total) AS p50, min(q) FILTER (WHERE cum >= 0.75 * total) AS p75, min(q) FILTER (WHERE cum >= 0.9 * total) AS p90,
  round(coalesce(sum(n) FILTER (WHERE q = 1), 0) / sum(n), 6) AS share_one, round(sum(n) FILTER (WHERE q <= 5) / sum(n), 6) AS share_le5, round(sum(n) FILTER (WHERE q <= 10) / sum(n), 6) AS share_le10,
  round(coalesce(sum(n) FILTER (WHERE q <> floor(q)), 0) / sum(n), 6) AS share_fraction, coalesce(sum(n) FILTER (WHERE q = 1), 0) / sum(n) >= 0.5 AS one_at_a_time FROM c""")
def issue_quantity_distribution(spark, sf):
    s = op.issue_sizes(b.ledger(spark, sf))
    q, n = F.col("q"), F.col("n")
    share = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0)) / F.sum(n)
    at = lambda p: F.min(F.when(F.col("cum") >= p * F.col("total"), q))
    return s.agg(at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"), at(0.9).alias("p90"), F.round(share(q == 1), 6).alias("share_one"), F.round(share(q <= 5), 6).alias("share_le5"), F.round(share(q <= 10), 6).alias("share_le10"), F.round(share(q != F.floor(q)), 6).alias("share_fraction"), (share(q == 1) >= 0.5).alias("one_at_a_time"))


@query("led_issue_top_sizes", f"""WITH {b.LEDGER}
SELECT consumption_qty AS q, count(*) AS n FROM ledger WHERE consumption_qty > 0 GROUP BY 1 ORDER BY n DESC, q LIMIT 10""")
def issue_top_sizes(spark, sf):
    return op.issue_sizes(b.ledger(spark, sf)).select("q", "n").orderBy(F.desc("n"), "q").limit(10)
