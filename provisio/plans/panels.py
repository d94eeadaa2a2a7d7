"""Queries on procurement requests and price panels; requests are landed as files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio import sources as src
from provisio.operators import panels as op
from provisio.plans import bindings as b
from provisio.registry import query
from provisio.sources import requests as rq

# Some requests are written twice, some lines are broken, some dates are missing or in other formats.
_DAY = "CAST(o_orderdate AS DATE)"
_LINES = f"""SELECT o_orderkey AS k, {_DAY} AS r, o_orderpriority AS kind, CAST(o_orderkey * 37 % 430 - 20 AS INTEGER) AS d FROM orders UNION ALL SELECT o_orderkey, {_DAY}, 'again', CAST(o_orderkey % 90 AS INTEGER) FROM orders WHERE o_orderkey % 6 = 5"""
_REQUESTS = f"""ln AS ({_LINES}), ok AS (SELECT CASE WHEN k % 40 = 9 THEN NULL ELSE 'R' || k END AS request, CASE WHEN k % 17 = 3 THEN NULL ELSE r END AS receipt, CASE WHEN k % 19 = 4 THEN NULL ELSE r + d END AS due, kind FROM ln WHERE k % 23 <> 7),
fi AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY request ORDER BY receipt NULLS LAST, due NULLS LAST, kind) = 1), rs AS (SELECT request, receipt, due, kind, due - receipt AS lead_days FROM fi WHERE due - receipt BETWEEN 0 AND 365)"""


def requests(spark, sf):
    path = src.new_path(spark, "procurement-requests")
    o = b.table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_orderdate").cast("date").alias("r"), F.col("o_orderpriority").alias("kind"))
    o = o.withColumn("d", (F.col("k") * 37 % 430 - 20).cast("int")).unionByName(o.where("k % 6 = 5").withColumns({"kind": F.lit("again"), "d": (F.col("k") % 90).cast("int")}))
    k = F.col("k")
    text = F.to_json(F.struct(
        F.when(k % 40 == 9, "--").otherwise(F.concat(F.lit("R"), k)).alias("reqNo"), F.when(k % 17 == 3, "soon").when(k % 4 == 0, F.date_format("r", "yyyyMMdd")).otherwise(F.date_format("r", "yyyy-MM-dd")).alias("rcptDate"),
        F.when(k % 19 != 4, F.date_format(F.date_add("r", F.col("d")), "yyyy-MM-dd HH:mm:ss")).otherwise("--").alias("dueDate"), F.col("kind"), F.lit("left alone").alias("note"),
    ))
    o.select(F.when(k % 23 == 7, F.substring(text, 1, 25)).otherwise(text).alias("value")).write.text(path)
    return rq.read(spark, path, "reqNo", "rcptDate", "dueDate", ["kind"]).withColumnRenamed("reqNo", "request")


@query("src_procurement_requests", f"WITH {_REQUESTS} SELECT * FROM rs")
def request_rows(spark, sf):
    return requests(spark, sf)


_QUANTILES = ", ".join(f"round(quantile_cont(lead_days, {q}), 6) AS {n}" for n, q in (("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9)))


@query("lt_request_distribution", f"WITH {_REQUESTS} SELECT kind, CAST(count(*) AS BIGINT) AS n, {_QUANTILES}, round(avg(lead_days), 6) AS mean_days, round(stddev_samp(lead_days), 6) AS sd_days FROM rs GROUP BY 1")
def request_distribution(spark, sf):
    got = rq.distribution(requests(spark, sf), ["kind"])
    return got.select("kind", "n", *(F.round(c, 6).alias(c) for c in got.columns if c not in ("kind", "n")))


FLOWS = """fl AS (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 7) END AS month, p_type AS code, CASE CAST(l_orderkey % 13 AS INTEGER) WHEN 0 THEN 'n/a' WHEN 1 THEN '0' WHEN 2 THEN '-3' ELSE CAST(CAST(l_quantity AS INTEGER) AS STRING) END AS weight, CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 11 = 1 THEN 0 ELSE CAST(l_extendedprice AS DOUBLE) END AS value FROM {lineitem} JOIN {part} ON l_partkey = p_partkey),
qu AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date, CASE WHEN o_orderkey % 8 > 0 THEN o_orderpriority END AS factor, CASE WHEN o_orderkey % 7 = 0 THEN '.' ELSE CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING) END AS price FROM {orders})"""
_UNITS = "un AS (SELECT month, code, avg(value / TRY_CAST(weight AS DOUBLE) * 1000) AS price FROM fl WHERE TRY_CAST(weight AS DOUBLE) > 0 AND value > 0 AND month IS NOT NULL GROUP BY 1, 2)"


def made(spark, sf, name):
    return spark.sql(f"WITH {FLOWS} SELECT * FROM {name}", **{t: b.table(spark, sf, t) for t in ("lineitem", "part", "orders")})


def units(spark, sf):
    return op.unit_values(made(spark, sf, "fl"), "month", "code", "weight", "value")


_TABLES = FLOWS.format(lineitem="lineitem", part="part", orders="orders")


@query("com_price_panels", f"WITH {_TABLES}, {_UNITS} SELECT 'customs' AS panel, month, code, round(price, 4) AS price FROM un UNION ALL SELECT 'quoted', substr(date, 1, 7), factor, round(avg(CAST(price AS DOUBLE)), 4) FROM qu WHERE date <> 'unknown' AND factor IS NOT NULL AND price <> '.' GROUP BY 2, 3")
def price_panels(spark, sf):
    quoted = op.quoted_means(made(spark, sf, "qu"), "date", "factor", "price")
    both = units(spark, sf).withColumn("panel", F.lit("customs")).unionByName(quoted.withColumn("panel", F.lit("quoted")))
    return both.select("panel", "month", "code", F.round("price", 4).alias("price"))


CODES = ["ECONOMY", "PROMO", "STANDARD"]


@query("com_customs_panel", f"WITH {_TABLES}, {_UNITS} SELECT month, " + ", ".join(f"round(max(price) FILTER (code = '{c}'), 4) AS {c.lower()}" for c in CODES) + " FROM un GROUP BY 1")
def customs_panel(spark, sf):
    return op.wide(units(spark, sf), CODES).select("month", *(F.round(c, 4).alias(c.lower()) for c in CODES))
