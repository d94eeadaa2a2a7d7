"""Queries on pruned fact reads, published hand-offs and customs replies; the tables are landed as files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio import sources as src
from provisio.plans import bindings as b
from provisio.plans import features as fea
from provisio.plans import forecast as fo
from provisio.registry import query
from provisio.sources import customs, facts, publish


@query("src_pruned_fact_read", f"WITH {b.SERIES_FACT}, w AS (SELECT DISTINCT p_brand AS item_code FROM part WHERE p_brand BETWEEN 'Brand#12' AND 'Brand#18' AND p_size > 45) SELECT year_month, item_code, round(sum(consumption_qty), 4) AS consumption_qty, count(*) AS series FROM sfact WHERE year_month BETWEEN DATE '1996-03-01' AND DATE '1997-02-01' AND item_code IN (SELECT item_code FROM w) GROUP BY 1, 2")
def pruned(spark, sf):
    path = src.new_path(spark, "facts")
    facts.store(fea.fact(spark, sf), path, "year_month", "item_code")
    wanted = b.table(spark, sf, "part").where("p_brand between 'Brand#12' and 'Brand#18' and p_size > 45").select(F.col("p_brand").alias("item_code"))
    rows = facts.read(spark, path, ["year_month", "item_code", "consumption_qty"], "year_month", "1996-03-01", "1997-02-01", "item_code", wanted)
    return rows.groupBy("year_month", "item_code").agg(F.round(F.sum("consumption_qty"), 4).alias("consumption_qty"), F.count("*").alias("series"))


ROW_KEY, SEGMENT_KEY = ["forecast_month", "stock_item_key", "model"], ["segment_type", "segment_value", "model"]


def handoffs(spark, sf):
    """Row and segment hand-offs of the test months, published together; the folder."""
    test = fo.labelled(spark, sf).where("split = 'test'")
    long = fo.op.long_predictions(test, fo.PREDS[:2], ["forecast_month", "stock_item_key", "institution_code", "target_next_month"])
    rows = src.stored(long.select("forecast_month", "stock_item_key", "model", F.col("target_next_month").alias("actual_usage"), F.col("pred").alias("predicted_usage"), "institution_code"), "handoff-rows")
    wape = F.round(100 * F.try_divide(F.sum(F.abs(F.col("predicted_usage") - F.col("actual_usage"))), F.sum(F.abs("actual_usage"))), 5).alias("wape")
    by = lambda kind, value: rows.groupBy(F.lit(kind).alias("segment_type"), value.alias("segment_value"), "model").agg(F.count("*").alias("n"), wape)
    segments = by("all", F.lit("all")).unionByName(by("institution", F.col("institution_code")))
    path = src.new_path(spark, "published")
    publish.publish(spark, path, {
        "rows": publish.Part(rows.drop("institution_code"), "parquet", [publish.required(["actual_usage"]), publish.keyed(ROW_KEY), publish.measured(["actual_usage", "predicted_usage"])]),
        "segments": publish.Part(segments, "csv", [publish.keyed(SEGMENT_KEY)]),
        "report": publish.Part(rows.groupBy("model").agg(F.count("*").alias("rows"), F.min("forecast_month").alias("first"), F.max("forecast_month").alias("last")), "json", [publish.keyed(["model"])]),
    })
    return path


_HANDED = fo.LONG + ", h AS (SELECT forecast_month, stock_item_key, model, y AS actual_usage, p AS predicted_usage, institution_code FROM long WHERE split = 'test' AND model IN ({}))".format(", ".join(f"'{m}'" for m in fo.SHORT[:2]))


@query("src_published_rows", f"WITH {_HANDED} SELECT forecast_month, stock_item_key, model, round(actual_usage, 4) AS actual_usage, round(predicted_usage, 4) AS predicted_usage FROM h")
def published_rows(spark, sf):
    rows = publish.published(spark, handoffs(spark, sf), "rows")
    return rows.select("forecast_month", "stock_item_key", "model", F.round("actual_usage", 4).alias("actual_usage"), F.round("predicted_usage", 4).alias("predicted_usage"))


@query("src_published_segments", f"WITH {_HANDED}, m AS (SELECT 'all' AS segment_type, 'all' AS segment_value, * FROM h UNION ALL SELECT 'institution', institution_code, * FROM h) SELECT segment_type, segment_value, model, count(*) AS n, round(100 * sum(abs(predicted_usage - actual_usage)) / sum(abs(actual_usage)), 5) AS wape FROM m GROUP BY 1, 2, 3")
def published_segments(spark, sf):
    return publish.published(spark, handoffs(spark, sf), "segments", "csv", "segment_type string, segment_value string, model string, n long, wape double")


def replies(spark, sf):
    """A reply for each nation: nation 3's is refused, 5's is no XML, 7's is cut off, 9's has no items, and 4's items lack some tags."""
    li, su = b.table(spark, sf, "lineitem"), b.table(spark, sf, "supplier")
    k = F.col("k")
    tag = lambda t, v: F.concat(F.lit(f"<{t}>"), v.cast("string"), F.lit(f"</{t}>"))
    month = F.date_format("l_shipdate", "yyyy.MM")
    flows = li.join(su, li["l_suppkey"] == su["s_suppkey"]).groupBy(F.col("s_nationkey").cast("int").alias("k"), month.alias("m"), (F.col("l_partkey") % 5).alias("hs")).agg(F.sum("l_quantity").cast("long").alias("w"), F.sum(F.col("l_linenumber").cast("long")).alias("v"))
    some = F.when(k == 4, F.concat(tag("hsCode", F.col("hs") + 3000), tag("impDlr", F.lit("-")))).otherwise(F.concat(tag("hsCd", F.col("hs") + 3000), tag("statCd", F.concat(F.lit("N"), k)), tag("expDlr", F.col("v")), tag("impDlr", F.lit(" 7 "))))
    item = F.concat(F.lit("<item>"), tag("year", F.col("m")), some, tag("impWgt", F.col("w")), F.lit("</item>"))
    # a nation has at most months x 5 items
    whole = flows.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("items"))
    code = F.when(k == 3, "<header><resultCode>99</resultCode><resultMsg>LIMIT</resultMsg></header>").when(k == 6, "").otherwise("<header><resultCode>00</resultCode></header>")
    body = F.concat(F.lit("<response>"), code, F.lit("<body><items>"), F.when(k == 9, "").otherwise(F.col("items")), F.when(k == 7, "").otherwise("</items></body></response>"))
    path = src.new_path(spark, "customs-xml")
    whole.select("k", F.when(k == 5, "Service Unavailable <html").otherwise(body).alias("value")).repartition("k").write.partitionBy("k").text(path)
    return customs.scan(spark, path, "ALL", "totals", "part-*")


_FLOWS = "f AS (SELECT CAST(s_nationkey AS INTEGER) AS k, strftime(l_shipdate, '%Y.%m') AS m, l_partkey % 5 AS hs, CAST(CAST(sum(l_quantity) AS BIGINT) AS DOUBLE) AS w, CAST(sum(l_linenumber) AS DOUBLE) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)"


@query("src_customs_flows", f"WITH {_FLOWS} SELECT m AS month, CAST(CAST(hs + 3000 AS BIGINT) AS VARCHAR) AS hs_code, CASE WHEN k = 4 THEN 'ALL' ELSE 'N' || k END AS country_code, CASE WHEN k = 4 THEN 0 ELSE v END AS export_value, w AS import_weight, CASE WHEN k <> 4 THEN 7.0 END AS import_value FROM f WHERE k NOT IN (3, 5, 7, 9)")
def customs_flows(spark, sf):
    return replies(spark, sf)[0].select("month", "hs_code", "country_code", "export_value", "import_weight", "import_value")


@query("src_customs_reports", f"WITH {_FLOWS} SELECT CASE WHEN k = 3 THEN 'refused' WHEN k IN (5, 7) THEN 'broken' WHEN k = 9 THEN 'empty' ELSE 'ok' END AS status, CASE WHEN k = 3 THEN 'resultCode=99: LIMIT' WHEN k IN (5, 7) THEN 'no whole reply' ELSE '' END AS reason, count(DISTINCT k) AS files, count(*) FILTER (WHERE k NOT IN (5, 9)) AS items FROM f GROUP BY 1, 2")
def customs_reports(spark, sf):
    return replies(spark, sf)[1].groupBy("status", "reason").agg(F.count("*").alias("files"), F.sum("items").alias("items"))
