"""Queries on record gates, headers, counted rejects, reference codes, prepared signals and the hold-out comparison."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provisio import sources as src
from provisio.operators import gates as op
from provisio.operators import selection as sel
from provisio.plans import bindings as b
from provisio.plans import features as fea
from provisio.registry import query

# Records with every rule broken somewhere. The expressions run in both engines.
RECORDS = """rc0 AS (SELECT p_partkey, CAST(p_partkey AS BIGINT) AS q, p_name, p_type, p_size FROM {part}),
rc AS (SELECT q AS record, CASE WHEN q % 41 = 0 THEN ' ' ELSE 'I1' END AS institution_id, CASE WHEN q % 43 = 0 THEN NULL ELSE concat('C', q) END AS item_code, CASE WHEN q % 47 = 0 THEN '' ELSE p_name END AS raw_name, CASE WHEN q % 53 = 0 THEN '' ELSE p_name END AS product_name, CASE WHEN q % 59 = 0 THEN 'I1::X' ELSE concat('I1', '::', 'C', q) END AS local_item_key,
  CASE WHEN q % 61 = 0 THEN concat(p_name, ' ') ELSE p_name END AS cleaned_name, CASE WHEN q % 67 = 0 THEN 'ODD' WHEN p_type = 'PROMO' THEN 'PROMO' ELSE 'MED' END AS group_id, CASE WHEN q % 71 = 0 THEN 'x' WHEN p_type = 'PROMO' AND q % 5 > 0 THEN 'f' ELSE 't' END AS forecastable, CASE WHEN q % 3 = 0 THEN '' ELSE p_type END AS family_id, CASE WHEN q % 3 = 0 AND q % 73 > 0 THEN '' WHEN q % 79 = 0 THEN NULL ELSE 'Family' END AS family_name,
  CASE WHEN q % 3 > 0 OR q % 83 = 0 THEN 'S' ELSE '' END AS subtype_id, CASE WHEN q % 3 > 0 OR q % 89 = 0 THEN '5ML' ELSE '' END AS specification, CASE WHEN q % 97 = 0 THEN 1.5 WHEN q % 101 = 0 THEN -0.1 ELSE 0.5 END AS confidence, CASE WHEN q % 103 = 0 THEN 0 ELSE 3 END AS occurrences, CASE WHEN q % 107 = 0 THEN NULL ELSE p_size + 0.5 END AS usage,
  DATE '2020-01-05' AS first_seen, CASE WHEN q % 109 = 0 THEN DATE '2019-01-01' ELSE DATE '2021-01-01' END AS last_seen, CASE WHEN q % 113 = 0 THEN 'other' WHEN q % 3 = 0 THEN 'none' ELSE 'family' END AS status FROM rc0)"""
_ERRORS = " UNION ALL ".join(f"SELECT '{r}' AS rule, CAST(record AS VARCHAR) AS k FROM rc WHERE {c}" for r, c in op.RECORD_RULES)


@query("itm_record_gates", f"WITH {RECORDS.replace('{part}', 'part')}, e AS ({_ERRORS}) SELECT rule, count(*) AS n, array_to_string(list_sort(list(k))[1:5], ';') AS examples FROM e GROUP BY 1")
def itm_record_gates(spark, sf):
    rows = spark.sql(f"WITH {RECORDS} SELECT * FROM rc", part=b.table(spark, sf, "part"))
    return op.gated(rows, "record", strict=False, examples=5)[1]


@query("itm_gated_records", f"WITH {RECORDS.replace('{part}', 'part')}, e AS ({_ERRORS}) SELECT record, item_code, group_id, family_id, status FROM rc WHERE CAST(record AS VARCHAR) NOT IN (SELECT k FROM e)")
def itm_gated_records(spark, sf):
    rows = spark.sql(f"WITH {RECORDS} SELECT * FROM rc", part=b.table(spark, sf, "part"))
    return op.gated(rows, "record", strict=False)[0].select("record", "item_code", "group_id", "family_id", "status")


@query("src_header_union", "SELECT l_orderkey AS order_key, l_linenumber AS line, CASE WHEN l_linenumber > 3 THEN l_suppkey END AS vendor_code, CASE WHEN l_linenumber > 3 THEN l_partkey END AS extra, CAST(NULL AS VARCHAR) AS unit_price FROM lineitem")
def header_union(spark, sf):
    """Older files lack the vendor; newer ones have it and another column. Each file's header is checked on its own."""
    li, path = b.table(spark, sf, "lineitem"), src.new_path(spark, "ledger-layouts")
    text = lambda rows, *cols: rows.select(*(F.col(c).cast("string").alias(n) for c, n in cols)).write.mode("append").csv(path, sep="|", header=True)
    text(li.where("l_linenumber <= 3"), ("l_orderkey", "order_key"), ("l_linenumber", "line"))
    text(li.where("l_linenumber > 3"), ("l_suppkey", "vendor_code"), ("l_linenumber", "line"), ("l_partkey", "extra"), ("l_orderkey", "order_key"))
    df = op.scan_by_header(spark, path, ["order_key", "line"], ["vendor_code", "unit_price"])
    return df.select(*(F.col(c).cast("long").alias(c) for c in ("order_key", "vendor_code", "extra")), F.col("line").cast("int").alias("line"), "unit_price")


_LEDGER_KINDS = "CASE WHEN l_linenumber = 7 THEN 'ragged' WHEN l_orderkey % 11 = 3 THEN 'key' WHEN l_orderkey % 13 = 5 THEN 'date' ELSE 'ok' END"


@query("src_ledger_counters", f"""WITH r AS (SELECT {_LEDGER_KINDS} AS kind, l_orderkey % 5 = 1 AS unknown, l_orderkey % 7 = 2 AS off, l_orderkey % 17 = 4 AS negative, l_partkey % 19 = 6 AS odd FROM lineitem)
SELECT count(*) AS rows, count(*) FILTER (WHERE kind = 'ragged') AS bad_cols, count(*) FILTER (WHERE kind = 'key') AS bad_key, count(*) FILTER (WHERE kind = 'date') AS bad_date, count(*) FILTER (WHERE kind = 'ok') AS kept, count(*) FILTER (WHERE kind = 'ok' AND odd) AS bad_numbers,
  count(*) FILTER (WHERE kind = 'ok' AND negative) AS neg_closing, 0::BIGINT AS neg_prev, count(*) FILTER (WHERE kind = 'ok' AND NOT unknown) AS identity_checked, count(*) FILTER (WHERE kind = 'ok' AND NOT unknown AND (off OR negative)) AS identity_bad FROM r""")
def ledger_counters(spark, sf):
    """A text ledger in which every reject occurs; nothing is dropped unseen."""
    path = src.new_path(spark, "daily-text")
    li = b.table(spark, sf, "lineitem").withColumn("kind", F.expr(_LEDGER_KINDS))
    c, q = F.col, F.col("l_orderkey")
    closing = F.when(q % 17 == 4, "-5").when(q % 7 == 2, "9,000.5").otherwise(F.concat((c("l_suppkey") + 3).cast("string"), F.lit(".0")))
    fields = [F.when(c("kind") == "key", " ").otherwise(q.cast("string")), F.when(c("kind") == "date", "2020-13-40").when(c("l_linenumber") == 1, "20200131").otherwise("2020-01-31"), F.when(q % 5 == 1, "").otherwise(c("l_suppkey").cast("string")), F.lit("5"), F.lit("2"), closing, F.when(c("l_partkey") % 19 == 6, "n/a").otherwise("1")]
    li.select(F.concat_ws("|", *fields, *[F.when(c("kind") == "ragged", F.lit("surplus"))]).alias("value")).write.text(path)
    raw = src.scan_tolerant(spark, path, ["item", "day", "previous", "received", "issued", "closing", "price"], header=False)
    return op.ledger_rows(raw, "_bad", ["item"], "day", ["previous", "received", "issued", "closing", "price"], "previous", "closing", ["received"], ["issued"])[1]


_CODES = """cd AS (SELECT CAST(p_partkey AS BIGINT) AS q, CASE WHEN p_partkey % 23 = 1 THEN concat('X', p_partkey) WHEN p_partkey % 4 = 0 THEN concat(' ', 3000000000 + p_partkey) WHEN p_partkey % 4 = 1 THEN concat('', 300000 + p_partkey) ELSE concat('', 3000 + p_partkey % 900) END AS code, CASE WHEN p_partkey % 29 = 2 THEN ' ' ELSE p_name END AS name,
  CASE WHEN p_partkey % 31 = 3 THEN 'soon' ELSE '2020-01-01' END AS valid_from, CASE WHEN p_partkey % 37 = 4 THEN '2019-12-31' ELSE '9999-12-31' END AS valid_to FROM {part})"""
_PROBLEM = """pb AS (SELECT *, CASE WHEN NOT regexp_matches(trim(code), '^[0-9]{2,10}$') THEN 'bad_code' WHEN valid_from = 'soon' THEN 'bad_date' WHEN valid_to < valid_from THEN 'dates_reversed' WHEN trim(name) = '' THEN 'blank_name' WHEN count(*) OVER (PARTITION BY trim(code), valid_from) > 1 THEN 'doubled_code' END AS problem FROM cd)"""


@query("src_reference_codes", "WITH " + _CODES.replace("{part}", "part") + f", {_PROBLEM} SELECT trim(code) AS code, name, CAST(valid_from AS DATE) AS valid_from, CAST(length(trim(code)) AS INTEGER) AS digits, length(trim(code)) = 10 AS is_leaf FROM pb WHERE problem IS NULL")
def reference_codes(spark, sf):
    good, _ = op.reference_codes(spark.sql(f"WITH {_CODES} SELECT code, name, valid_from, valid_to FROM cd", part=b.table(spark, sf, "part")))
    return good.select("code", "name", "valid_from", "digits", "is_leaf")


@query("src_reference_problems", "WITH " + _CODES.replace("{part}", "part") + f", {_PROBLEM} SELECT problem, count(*) AS n FROM pb WHERE problem IS NOT NULL GROUP BY 1")
def reference_problems(spark, sf):
    return op.reference_codes(spark.sql(f"WITH {_CODES} SELECT code, name, valid_from, valid_to FROM cd", part=b.table(spark, sf, "part")))[1]


@query("rsk_prepared_signals", """WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 9 = 0 THEN ' ' ELSE 'K' || (l_partkey % 50) END AS stock_item_key, strftime(l_shipdate, '%Y-%m') AS month, l_partkey % 10 = 1 AS bad, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount END AS risk FROM lineitem),
k AS (SELECT * FROM s WHERE NOT bad AND trim(stock_item_key) <> '' QUALIFY row_number() OVER (PARTITION BY stock_item_key, month ORDER BY l_orderkey DESC, l_linenumber DESC) = 1) SELECT stock_item_key, month, coalesce(risk, 0) AS risk, 0.5 AS confidence, l_orderkey FROM k""")
def rsk_prepared(spark, sf):
    """Months come in four spellings, some as none; the last row of a key and month counts."""
    c, d = F.col, F.col("l_shipdate")
    month = F.when(c("l_partkey") % 10 == 1, "20-1x").when(c("l_linenumber") % 4 == 0, F.date_format(d, "yyyyMM")).when(c("l_linenumber") % 4 == 1, F.date_format(d, "yyyy.MM")).when(c("l_linenumber") % 4 == 2, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "yyyy-MM"))
    key = F.when(c("l_partkey") % 9 == 0, " ").otherwise(F.concat(F.lit("K"), c("l_partkey") % 50))
    raw = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", key.alias("stock_item_key"), month.alias("month"), F.when(c("l_linenumber") != 2, c("l_discount")).alias("risk"))
    return op.prepared(raw, ["stock_item_key"], "month", {"risk": 0.0, "confidence": 0.5}, [c("l_orderkey"), c("l_linenumber")]).select("stock_item_key", "month", "risk", "confidence", "l_orderkey")


PREDICTORS = ("last", "mean3", "mean6", "mean12", "same_month", "blend")
_ROWS = "PARTITION BY institution_code, item_code ORDER BY year_month"


@query("for_holdout_predictors", f"""WITH {b.SERIES_FACT}, i AS (SELECT institution_code, item_code, year_month, consumption_qty AS v FROM sfact WHERE year_month BETWEEN DATE '2000-01-01' AND DATE '2001-12-01'),
f AS (SELECT institution_code, item_code, min(year_month) AS a FROM i GROUP BY 1, 2), d AS (SELECT institution_code, item_code, unnest(generate_series(a, DATE '2001-12-01', INTERVAL 1 MONTH))::DATE AS year_month FROM f), p AS (SELECT d.*, coalesce(v, 0) AS v FROM d LEFT JOIN i USING (institution_code, item_code, year_month)),
w AS (SELECT *, lag(v) OVER ({_ROWS}) AS last, {', '.join(f'avg(v) OVER ({_ROWS} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS mean{n}' for n in (3, 6, 12))}, lag(v, 12) OVER ({_ROWS}) AS same_month, avg(CAST(v = 0 AS DOUBLE)) OVER ({_ROWS} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS zeros FROM p),
h AS (SELECT *, 0.5 * mean3 + 0.5 * mean12 AS blend, CASE WHEN zeros IS NULL THEN 'new' WHEN zeros >= 0.5 THEN 'sparse' ELSE 'regular' END AS segment FROM w WHERE year_month BETWEEN DATE '2001-08-01' AND DATE '2001-10-01'),
l AS ({' UNION ALL '.join(f"SELECT segment, '{n}' AS predictor, v, greatest(coalesce({n}, 0), 0) AS x FROM h UNION ALL SELECT 'all', '{n}', v, greatest(coalesce({n}, 0), 0) FROM h" for n in PREDICTORS)})
SELECT segment, predictor, count(*) AS n, round(100 * sum(abs(x - v)) / nullif(sum(abs(v)), 0), 5) AS wape, round(100 * sum(x - v) / nullif(sum(abs(v)), 0), 5) AS bias_pct FROM l GROUP BY 1, 2""")
def for_holdout(spark, sf):
    """Six predictors over three target months of a dense panel, by how many of the twelve months before were empty."""
    p = sel.dense_panel(fea.fact(spark, sf).withColumnRenamed("consumption_qty", "v"), fea.KEY, "v", "2000-01-01", 24)
    w = W.partitionBy(*fea.KEY).orderBy("year_month")
    mean = lambda n: F.avg("v").over(w.rowsBetween(-n, -1))
    zeros = F.avg((F.col("v") == 0).cast("double")).over(w.rowsBetween(-12, -1))
    p = p.withColumns({"last": F.lag("v").over(w), "mean3": mean(3), "mean6": mean(6), "mean12": mean(12), "same_month": F.lag("v", 12).over(w), "zeros": zeros}).where("year_month between '2001-08-01' and '2001-10-01'").withColumn("blend", 0.5 * F.col("mean3") + 0.5 * F.col("mean12"))
    segment = F.when(F.col("zeros").isNull(), "new").when(F.col("zeros") >= 0.5, "sparse").otherwise("regular")
    x = F.explode(F.array(*(F.struct(F.lit(n).alias("predictor"), F.greatest(F.coalesce(F.col(n), F.lit(0.0)), F.lit(0.0)).alias("x")) for n in PREDICTORS)))
    long = p.select("v", F.explode(F.array(segment, F.lit("all"))).alias("segment"), x.alias("p")).select("segment", "p.*", "v")
    size = F.sum(F.abs("v"))
    return long.groupBy("segment", "predictor").agg(F.count("*").alias("n"), F.round(100 * F.try_divide(F.sum(F.abs(F.col("x") - F.col("v"))), size), 5).alias("wape"), F.round(100 * F.try_divide(F.sum(F.col("x") - F.col("v")), size), 5).alias("bias_pct"))
