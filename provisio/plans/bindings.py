"""Test tables seen as the domain's inputs: Spark frames, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


MOVES = ("purchase_in_qty", "transfer_in_qty", "return_in_qty", "transfer_out_qty", "consumption_qty", "return_out_qty", "disposal_qty", "auto_disposal_adjustment_qty", "correction_out_qty")
KEYS = ("year_month", "institution_code", "department", "item_code")
SERIES = KEYS[1:]
ORDER = ("closing_date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """A daily ledger from lineitem, part and supplier. Stocks are made so that every quality flag occurs."""
    li, pa, su = (table(spark, sf, t) for t in ("lineitem", "part", "supplier"))
    rows = li.join(pa.select("p_partkey", "p_brand", "p_name"), li["l_partkey"] == F.col("p_partkey")).join(su.select("s_suppkey", "s_nationkey"), li["l_suppkey"] == F.col("s_suppkey"))
    k = F.col("l_orderkey")
    used = F.when(k % 53 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    opening = F.when(k % 11 != 0, F.floor(F.col("l_extendedprice") / 1000).cast("double"))
    rows = rows.select(
        F.col("s_nationkey").cast("string").alias("institution_code"), F.col("l_returnflag").alias("department"), F.col("p_brand").alias("item_code"), F.col("p_name").alias("item_name"),
        F.col("l_shipdate").cast("date").alias("closing_date"), opening.alias("opening_stock"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_linenumber").cast("double").alias("purchase_in_qty"), F.when(k % 5 == 0, 2.0).otherwise(0.0).alias("transfer_in_qty"), F.lit(0.0).alias("return_in_qty"), F.when(k % 9 == 0, 1.0).otherwise(0.0).alias("transfer_out_qty"),
        used.alias("consumption_qty"), F.lit(0.0).alias("return_out_qty"), F.when(k % 17 == 0, 3.0).otherwise(0.0).alias("disposal_qty"), F.when(k % 23 == 0, 1.0).otherwise(0.0).alias("auto_disposal_adjustment_qty"), F.lit(0.0).alias("correction_out_qty"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    )
    net = F.col("opening_stock") + F.col("purchase_in_qty") + F.col("transfer_in_qty") - F.col("transfer_out_qty") - F.col("consumption_qty") - F.col("disposal_qty")
    closing = F.when((F.col("l_orderkey") % 13 != 0) & net.isNotNull(), F.greatest(net + F.when(F.col("l_linenumber") % 7 == 0, 1.0).otherwise(0.0), F.lit(0.0)))
    return rows.withColumn("closing_stock", closing)


LEDGER = """ledger0 AS (
  SELECT CAST(s_nationkey AS VARCHAR) AS institution_code, l_returnflag AS department, p_brand AS item_code, p_name AS item_name, CAST(l_shipdate AS DATE) AS closing_date,
    CASE WHEN l_orderkey % 11 <> 0 THEN CAST(floor(l_extendedprice / 1000) AS DOUBLE) END AS opening_stock, l_extendedprice / l_quantity AS unit_price,
    CAST(l_linenumber AS DOUBLE) AS purchase_in_qty, CASE WHEN l_orderkey % 5 = 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS transfer_in_qty, 0.0::DOUBLE AS return_in_qty, CASE WHEN l_orderkey % 9 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS transfer_out_qty,
    CASE WHEN l_orderkey % 53 = 0 THEN -l_quantity ELSE l_quantity END AS consumption_qty, 0.0::DOUBLE AS return_out_qty, CASE WHEN l_orderkey % 17 = 0 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS disposal_qty,
    CASE WHEN l_orderkey % 23 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS auto_disposal_adjustment_qty, 0.0::DOUBLE AS correction_out_qty, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
ledger AS (
  SELECT *, date_trunc('month', closing_date)::DATE AS year_month,
    CASE WHEN l_orderkey % 13 <> 0 AND opening_stock IS NOT NULL THEN greatest(opening_stock + purchase_in_qty + transfer_in_qty - transfer_out_qty - consumption_qty - disposal_qty + CASE WHEN l_linenumber % 7 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 0.0::DOUBLE) END AS closing_stock
  FROM ledger0)"""
FLAGGED = LEDGER + """,
flagged AS (
  SELECT *, CAST(opening_stock IS NOT NULL AND greatest(consumption_qty, 0) > greatest(opening_stock, 0) + greatest(purchase_in_qty, 0) + greatest(transfer_in_qty, 0) + greatest(return_in_qty, 0) + 1e-9 AS INTEGER) AS physical_violation,
    CAST(opening_stock IS NOT NULL AND consumption_qty > opening_stock + purchase_in_qty + 1e-9 AS INTEGER) AS document_violation,
    CAST(opening_stock IS NULL AS INTEGER) AS opening_missing,
    closing_stock - (opening_stock + purchase_in_qty + transfer_in_qty + return_in_qty - transfer_out_qty - consumption_qty - return_out_qty - disposal_qty - correction_out_qty) AS balance_residual
  FROM ledger)"""
SRC = "closing_date, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
DESC = ", ".join(f"{c} DESC" for c in SRC.split(", "))
MONTHLY = FLAGGED + f""",
monthly AS (
  SELECT year_month, institution_code, department, item_code, min(closing_date) AS first_date, max(closing_date) AS last_date,
    first(item_name ORDER BY {DESC}) AS item_name,
    first(opening_stock ORDER BY {SRC}) FILTER (WHERE opening_stock IS NOT NULL) AS month_start_stock,
    first(closing_stock ORDER BY {DESC}) FILTER (WHERE closing_stock IS NOT NULL) AS month_end_stock,
    min(closing_stock) AS min_stock, max(closing_stock) AS max_stock, sum(closing_stock) AS stock_sum, count(closing_stock) AS stock_observation_count,
    count(*) FILTER (WHERE closing_stock = 0) AS stockout_count, count(*) FILTER (WHERE closing_stock < 0) AS negative_stock_count,
    sum(unit_price) AS price_sum, count(unit_price) AS price_count, coalesce(sum(balance_residual), 0.0::DOUBLE) AS balance_residual_sum,
    {', '.join(f'sum({m}) AS {m}' for m in MOVES)},
    sum(greatest(consumption_qty, 0)) AS outbound_sum, sum(greatest(consumption_qty, 0) * greatest(consumption_qty, 0)) AS outbound_squared_sum,
    CAST(sum(physical_violation) AS BIGINT) AS physical_violation_count, CAST(sum(document_violation) AS BIGINT) AS document_violation_count, CAST(sum(opening_missing) AS BIGINT) AS opening_missing_count,
    count(*) FILTER (WHERE abs(balance_residual) > 1e-9) AS balance_violation_count, count(*) AS row_count
  FROM flagged GROUP BY ALL)"""
FACT = MONTHLY + """,
fact AS (
  SELECT *, stock_sum / nullif(stock_observation_count, 0) AS average_stock, price_sum / nullif(price_count, 0) AS average_unit_price,
    stockout_count / nullif(stock_observation_count, 0)::DOUBLE AS stockout_rate, purchase_in_qty + transfer_in_qty + return_in_qty AS inbound_qty,
    transfer_out_qty + return_out_qty + disposal_qty + correction_out_qty AS other_outbound_qty, month_end_stock - month_start_stock AS net_stock_change,
    institution_code || '::' || department || '::' || item_code AS stock_item_key
  FROM monthly)"""
# Series at nation x brand, which has gaps and long segments.
SERIES_FACT = FLAGGED + f""",
sfact AS (
  SELECT year_month, institution_code, item_code, institution_code || '::' || item_code AS stock_item_key, sum(consumption_qty) AS consumption_qty, sum(purchase_in_qty + transfer_in_qty + return_in_qty) AS inbound_qty,
    first(closing_stock ORDER BY {DESC}) FILTER (WHERE closing_stock IS NOT NULL) AS month_end_stock,
    count(*) FILTER (WHERE closing_stock = 0) / nullif(count(closing_stock), 0)::DOUBLE AS stockout_rate, sum(disposal_qty) AS disposal_qty, sum(auto_disposal_adjustment_qty) AS auto_disposal_adjustment_qty
  FROM flagged GROUP BY ALL)"""
