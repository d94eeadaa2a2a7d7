"""Source, sink and streaming queries: test tables are landed as files in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio import sources as src
from provisio import streaming
from provisio.plans import bindings as b
from provisio.registry import query


@query("src_pipe_ledger_scan", f"WITH {b.LEDGER} SELECT l_orderkey, l_linenumber, l_partkey, item_name || chr(10) || 'line' AS item_name, round(consumption_qty, 4) AS consumption_qty FROM ledger")
def pipe_scan(spark, sf):
    path = src.new_path(spark, "ledger-text")
    rows = b.ledger(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", F.concat("item_name", F.lit("\nline")).alias("NAME"), "consumption_qty")
    rows.write.csv(path, sep="|", quote='"', escape='"', header=True, quoteAll=True)
    df = src.scan_pipe(spark, path, ["l_orderkey", "item_name"], ["vendor_code"], {"NAME": "item_name"})
    return df.select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"), F.col("l_partkey").cast("long").alias("l_partkey"), "item_name", F.round(F.col("consumption_qty").cast("double"), 4).alias("consumption_qty"))


@query("src_tolerant_scan", "SELECT count(*) AS rows, count(*) FILTER (WHERE l_linenumber = 7) AS bad_rows, count(*) FILTER (WHERE l_linenumber = 6) AS bad_numbers FROM lineitem")
def tolerant(spark, sf):
    path = src.new_path(spark, "ragged-text")
    li = b.table(spark, sf, "lineitem")
    q = F.when(F.col("l_linenumber") == 6, "n/a").otherwise(F.col("l_quantity").cast("string"))
    line = F.concat_ws("|", F.col("l_orderkey").cast("string"), q, F.when(F.col("l_linenumber") != 7, F.lit("x")))
    line = F.when(F.col("l_linenumber") == 7, F.concat(line, F.lit("|y|z|surplus"))).otherwise(line)
    li.select(line.alias("value")).write.text(path)
    df = src.scan_tolerant(spark, path, ["key", "qty", "tag"], header=False)
    bad = F.col("_bad").isNotNull()
    return df.agg(F.count("*").alias("rows"), F.count_if(bad).alias("bad_rows"), F.count_if(~bad & F.expr("try_cast(qty as double)").isNull()).alias("bad_numbers"))


@query("src_json_lines_fullest", "WITH r AS (SELECT o_custkey AS request, o_orderdate::DATE AS receipt, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS kind, o_orderkey FROM orders) SELECT request, receipt, kind, o_orderkey FROM r QUALIFY row_number() OVER (PARTITION BY request, receipt ORDER BY CAST(kind IS NOT NULL AS INTEGER) DESC, o_orderkey) = 1")
def json_lines(spark, sf):
    path = src.new_path(spark, "requests-json")
    o = b.table(spark, sf, "orders")
    o.select(F.col("o_custkey").alias("request"), F.col("o_orderdate").cast("date").alias("receipt"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("kind"), "o_orderkey").write.json(path)
    df = spark.read.schema("request long, receipt date, kind string, o_orderkey long").json(path, mode="DROPMALFORMED")
    return src.fullest(df, ["request", "receipt"], [F.asc("o_orderkey")])


@query("src_xml_items", "SELECT n_nationkey AS code, n_name AS name FROM nation")
def xml_items(spark, sf):
    path = src.new_path(spark, "items-xml")
    b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name")).write.format("xml").option("rowTag", "item").option("rootTag", "items").save(path)
    return spark.read.format("xml").option("rowTag", "item").schema("code int, name string").load(path)


@query("src_trade_normalise", "SELECT strftime(l_shipdate, '%Y-%m') AS month, CAST(l_partkey + 10 AS VARCHAR) AS hs_code, 'N' || (l_suppkey % 5) AS country_code, l_extendedprice AS value, 0.0::DOUBLE AS weight FROM lineitem WHERE l_partkey % 7 <> 0")
def trade_normalise(spark, sf):
    li = b.table(spark, sf, "lineitem")
    code = F.when(F.col("l_partkey") % 7 == 0, "bad").otherwise(F.concat((F.col("l_partkey") + 10).cast("string"), F.lit(".0")))
    raw = li.select(F.date_format("l_shipdate", "yyyy.MM").alias("month"), code.alias("hs_code"), F.concat(F.lit(" n"), F.col("l_suppkey") % 5).alias("country_code"), F.col("l_extendedprice").cast("string").alias("value"), F.lit("-").alias("weight"))
    return src.trade_flows(raw)


@query("src_cache_merge", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders")
def cache_merge(spark, sf):
    o = b.table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    return src.merged_cache(o, o.where("o_orderkey % 3 = 0").withColumn("price", F.col("price") * 2), ["o_orderkey"])


@query("src_price_normalise", "SELECT p_brand AS factor, l_shipdate::DATE AS date, l_extendedprice AS price FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <> 2 AND l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'")
def price_normalise(spark, sf):
    li, p = b.table(spark, sf, "lineitem"), b.table(spark, sf, "part")
    j = li.join(p, li["l_partkey"] == p["p_partkey"])
    raw = j.select(F.col("p_brand").alias("factor"), F.col("l_shipdate").cast("date").alias("date"), F.when(F.col("l_linenumber") == 2, "-1").otherwise(F.col("l_extendedprice").cast("string")).alias("price"))
    return src.prices(raw, "1996-01-01", "1997-12-31")


@query("src_reference_load", "SELECT length(CAST(p_partkey AS VARCHAR)) AS digits, count(*) AS codes, count(*) FILTER (WHERE length(CAST(p_partkey AS VARCHAR)) = 4) AS leaves FROM part GROUP BY 1")
def reference_load(spark, sf):
    code = F.trim(F.col("p_partkey").cast("string"))
    d = b.table(spark, sf, "part").where(code.rlike(r"^\d+$")).select(F.length(code).cast("long").alias("digits"))
    return d.groupBy("digits").agg(F.count("*").alias("codes"), F.count_if(F.col("digits") == 4).alias("leaves"))


@query("src_json_master_flatten", "SELECT p_brand, p_partkey, p_name FROM part")
def json_flatten(spark, sf):
    nested = b.table(spark, sf, "part").groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("p_partkey").alias("ITEM_SEQ"), F.col("p_name").alias("itemName"))).alias("item"))).alias("body"))
    rows = nested.select("p_brand", F.explode_outer(F.from_json("body", "item array<struct<ITEM_SEQ:long,itemName:string,name:string>>").getField("item")).alias("x"))
    return rows.select("p_brand", F.col("x.ITEM_SEQ").alias("p_partkey"), F.coalesce("x.itemName", "x.name").alias("p_name"))


@query("src_evidence_html", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '/([0-9]+)', 1) AS target FROM pages")
def evidence(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "/([0-9]+)", 1).alias("target"))


TAGS = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>"


@query("src_evidence_visible_text", f"SELECT page_id, trim(regexp_replace(regexp_replace(html, '{TAGS}', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def evidence_text(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", src.visible_text(F.col("html")).alias("text"))


@query("src_partitioned_sink", f"WITH {b.SERIES_FACT} SELECT year_month, item_code, sum(consumption_qty) AS q FROM sfact WHERE year_month BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY 1, 2")
def sink(spark, sf):
    """Written by month, read with a month range that prunes partitions."""
    from provisio.plans import features as fea

    path = src.new_path(spark, "monthly")
    src.guarded_write(fea.fact(spark, sf), path, ["year_month"])
    back = spark.read.parquet(path).where("year_month between '1997-01-01' and '1998-12-31'")
    return back.groupBy("year_month", "item_code").agg(F.sum("consumption_qty").alias("q"))


@query("src_month_item_pivot", f"WITH {b.SERIES_FACT} SELECT year_month, sum(consumption_qty) FILTER (WHERE item_code = 'Brand#11') AS b11, sum(consumption_qty) FILTER (WHERE item_code = 'Brand#12') AS b12 FROM sfact WHERE item_code IN ('Brand#11', 'Brand#12') GROUP BY 1")
def pivot(spark, sf):
    from provisio.plans import features as fea

    rows = fea.fact(spark, sf).where("item_code in ('Brand#11', 'Brand#12')")
    return rows.groupBy("year_month").pivot("item_code", ["Brand#11", "Brand#12"]).agg(F.sum("consumption_qty")).select("year_month", F.col("`Brand#11`").alias("b11"), F.col("`Brand#12`").alias("b12"))


@query("src_distinct_relation", "SELECT l_partkey, l_suppkey, coalesce(l_returnflag, '') AS flag FROM lineitem GROUP BY ALL")
def relation(spark, sf):
    return b.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", F.coalesce("l_returnflag", F.lit("")).alias("flag")).distinct()


@query("src_handoff_export", f"WITH {b.SERIES_FACT} SELECT year_month, stock_item_key, greatest(consumption_qty, 0) AS qty FROM sfact")
def handoff(spark, sf):
    from provisio.operators import contracts as rel
    from provisio.plans import features as fea

    rows = fea.fact(spark, sf).select("year_month", "stock_item_key", F.greatest("consumption_qty", F.lit(0.0)).alias("qty"))
    rows = rel.unique(rel.filled(rows, ["year_month", "stock_item_key"]), ["year_month", "stock_item_key"])
    path = src.new_path(spark, "handoff")
    src.guarded_write(rows.orderBy("year_month", "stock_item_key"), path)
    return spark.read.parquet(path)


@query("src_ngram_document_join", "WITH g AS (SELECT conv_id, turn, role, lower(text) AS t FROM conversations) SELECT conv_id, count(*) FILTER (WHERE regexp_matches(t, 'token|the')) AS hits, bool_or(contains(t, 'license')) AS licensed FROM g GROUP BY 1")
def ngrams(spark, sf):
    t = F.lower("text")
    return b.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count_if(t.rlike("token|the")).alias("hits"), F.bool_or(t.contains("license")).alias("licensed"))


@query("src_event_archive_classifier", "WITH c AS (SELECT DISTINCT url, date_trunc('month', DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER))::DATE AS month, CASE WHEN contains(url, 'casino') OR contains(url, 'bets') THEN 'drop' WHEN regexp_matches(url, '/(fr|de)/') THEN 'foreign' ELSE 'local' END AS kind FROM pages) SELECT month, kind, count(*) AS n FROM (SELECT url, min(month) AS month, min(kind) AS kind FROM c GROUP BY 1) WHERE kind <> 'drop' GROUP BY 1, 2")
def archive(spark, sf):
    u = F.col("url")
    kind = F.when(u.contains("casino") | u.contains("bets"), "drop").when(u.rlike("/(fr|de)/"), "foreign").otherwise("local")
    p = b.table(spark, sf, "pages").select("url", F.trunc(F.expr("date_add(date'2024-01-01', cast(page_id % 366 as int))"), "MM").alias("month"), kind.alias("kind"))
    one = p.groupBy("url").agg(F.min("month").alias("month"), F.min("kind").alias("kind"))
    return one.where("kind <> 'drop'").groupBy("month", "kind").agg(F.count("*").alias("n"))


def _landed(spark, sf):
    path = src.new_path(spark, "events-by-day")
    e = b.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.withColumn("day", F.to_date("ts")).repartition(8, "day").sortWithinPartitions("ts").drop("day").write.parquet(path)
    return path, e.schema


@query("str_dedupe_ingest", "SELECT event_id, event_type FROM events")
def str_ingest(spark, sf):
    path, schema = _landed(spark, sf)
    return streaming.ingest(spark, path, schema, "event_id", late="40 days", files=4).select("event_id", "event_type")


@query("str_windowed_counts", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 3) AS v FROM events GROUP BY 1, 2")
def str_windows(spark, sf):
    path, schema = _landed(spark, sf)
    return streaming.windowed_counts(spark, path, schema, "event_type", late="40 days").select(F.col("start").cast("date").alias("day"), "event_type", "n", F.round("v", 3).alias("v"))
