"""Item identity, classification, material and news queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio.functions import join_unique, split_codes, stable_id
from provisio.operators import items as op
from provisio.plans import bindings as b
from provisio.registry import SQL, query
from provisio.sources import stored

R = lambda *cs: [F.round(c, 5).alias(c) for c in cs]
S = lambda *cs: ", ".join(f"round({c}, 5) AS {c}" for c in cs)


def aliases(spark, sf):
    """Raw names: variants of part names by supplier."""
    li, p = b.table(spark, sf, "lineitem"), b.table(spark, sf, "part")
    j = li.join(p, li["l_partkey"] == p["p_partkey"])
    k = F.col("l_linenumber") % 4
    raw = F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat(F.lit("[A] "), "p_name")).when(k == 2, F.concat("p_name", F.lit(" (x) 1,000ml 5mg"))).otherwise(F.concat(F.lit(" "), F.replace(F.col("p_name"), F.lit(" "), F.lit("  ")), F.lit(" #7")))
    return j.select(F.col("l_suppkey").alias("institution_id"), F.col("l_partkey").alias("item_code"), raw.alias("raw"), "p_name", "p_type", "p_brand", "p_size", "l_quantity", F.col("l_shipdate").cast("date").alias("date"), F.col("l_returnflag").alias("department"), "l_orderkey", "l_linenumber")


ALIASES = """al AS (SELECT l_suppkey AS institution_id, l_partkey AS item_code, CASE l_linenumber % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN '[A] ' || p_name WHEN 2 THEN p_name || ' (x) 1,000ml 5mg' ELSE ' ' || replace(p_name, ' ', '  ') || ' #7' END AS raw, p_name, p_type, p_brand, p_size, l_quantity, CAST(l_shipdate AS DATE) AS date, l_returnflag AS department, l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey),
cl AS (SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS name FROM al)"""
KEY = "regexp_replace(regexp_replace(lower({}), '(\\d)\\.(\\d)', '\\1p\\2', 'g'), '[^\\w]+', '', 'g')"


def cleaned(spark, sf):
    return aliases(spark, sf).withColumn("name", op.clean_name(F.col("raw"), None))


@query("itm_name_cleaning", f"WITH {ALIASES} SELECT DISTINCT raw, name FROM cl")
def itm_clean(spark, sf):
    return aliases(spark, sf).select("raw").distinct().withColumn("name", op.clean_name(F.col("raw")))


def stripped_sql(c, rounds=3):
    out = c
    for p in op.WRAPPERS * rounds:
        out = f"regexp_replace({out}, '(?i){p}', '')"
    return out


@query("itm_wrapper_stripping", f"WITH {ALIASES}, n AS (SELECT DISTINCT name, {stripped_sql('name')} AS bare FROM cl) SELECT name, CASE WHEN trim(bare) <> '' THEN trim(bare) ELSE name END AS product, name LIKE '[%' AS tagged FROM n")
def itm_strip(spark, sf):
    return cleaned(spark, sf).select("name").distinct().select("name", op.strip_wrappers(F.col("name")).alias("product"), F.col("name").rlike(r"^\[").alias("tagged"))


@query("itm_match_key", f"WITH {ALIASES} SELECT DISTINCT name, {KEY.format('name')} AS match_key FROM cl")
def itm_key(spark, sf):
    return cleaned(spark, sf).select("name").distinct().withColumn("match_key", op.match_key(F.col("name")))


FAMILIES = [("gear|bolt", "FASTENER"), ("widget", "WIDGET"), ("ring|plate", "PART"), ("anvil", "TOOL")]


@query("itm_family_rules", f"WITH {ALIASES} SELECT DISTINCT name, CASE WHEN regexp_matches(lower(name), 'gear|bolt') THEN 'FASTENER' WHEN regexp_matches(lower(name), 'widget') THEN 'WIDGET' WHEN regexp_matches(lower(name), 'ring|plate') THEN 'PART' WHEN regexp_matches(lower(name), 'anvil') THEN 'TOOL' ELSE 'UNRESOLVED' END AS family FROM cl")
def itm_family(spark, sf):
    return cleaned(spark, sf).select("name").distinct().withColumn("family", op.first_rule(F.col("name"), FAMILIES, "UNRESOLVED"))


@query("itm_specification_strength", f"WITH {ALIASES} SELECT DISTINCT name, CASE WHEN name LIKE '%1,000ml%' THEN '1000mL' ELSE '' END AS specification, CASE WHEN name LIKE '%5mg' THEN '5mg' ELSE '' END AS strengths FROM cl")
def itm_spec(spark, sf):
    return cleaned(spark, sf).select("name").distinct().withColumns({"specification": op.specification(F.col("name")), "strengths": op.strengths(F.col("name"))})


@query("itm_intrinsic_group", f"""WITH {ALIASES} SELECT DISTINCT name, item_code, CASE WHEN item_code % 10 = 0 THEN 'ASSET' WHEN name LIKE '%mg' THEN 'DRUG' WHEN regexp_matches(lower(name), 'widget|gear') THEN 'DEVICE' ELSE 'OTHER' END AS item_group,
  CASE WHEN item_code % 10 = 0 THEN 0.98::DOUBLE WHEN name LIKE '%mg' THEN 0.9::DOUBLE WHEN regexp_matches(lower(name), 'widget|gear') THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM cl""")
def itm_group(spark, sf):
    n = F.col("name")
    rules = [(F.col("item_code") % 10 == 0, "ASSET", 0.98), (n.endswith("mg"), "DRUG", 0.9), (F.lower(n).rlike("widget|gear"), "DEVICE", 0.8)]
    from provisio.functions import ladder

    return cleaned(spark, sf).select("name", "item_code").distinct().withColumns({"item_group": ladder([(c, g) for c, g, _ in rules], "OTHER"), "confidence": ladder([(c, s) for c, _, s in rules], 0.0)})


@query("itm_alias_statistics", f"WITH {ALIASES} SELECT institution_id, item_code, name, count(*) AS occurrences, sum(l_quantity) AS usage, min(date) AS first_date, max(date) AS last_date, first(department ORDER BY date, l_orderkey, l_linenumber, department) AS department FROM cl GROUP BY 1, 2, 3")
def itm_stats(spark, sf):
    return op.alias_stats(cleaned(spark, sf), ["institution_id", "item_code", "name"], "l_quantity", "date", "department", ["date", "l_orderkey", "l_linenumber", "department"])


def work(spark, sf):
    a = op.alias_stats(cleaned(spark, sf), ["institution_id", "item_code", "name", "p_type", "p_brand"], "l_quantity", "date", "department", ["date"]).withColumn("strict_name", op.match_key(F.col("name")))
    return op.worklist(a, ["p_type", "p_brand"])


WORK = ALIASES + f""",
aa AS (SELECT institution_id, item_code, name, p_type, p_brand, count(*) AS occurrences, {KEY.format('name')} AS strict_name FROM cl GROUP BY ALL),
lk AS (SELECT *, 'REP-' || sha256(strict_name)[:20] AS representative_id FROM aa),
nm AS (SELECT representative_id, name, sum(occurrences) AS n FROM lk GROUP BY 1, 2),
bn AS (SELECT representative_id, first(name ORDER BY n DESC, length(name), name DESC) AS representative_name FROM nm GROUP BY 1),
wk AS (SELECT representative_id, CAST(sum(occurrences) AS BIGINT) AS occurrences, count(*) AS aliases, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) ELSE '' END AS p_type, CASE WHEN count(DISTINCT p_type) > 1 OR count(DISTINCT p_brand) > 1 THEN 'conflict' ELSE 'consistent' END AS status FROM lk GROUP BY 1)"""


@query("itm_product_worklist", f"WITH {WORK} SELECT representative_id, representative_name, occurrences, aliases, p_type, status FROM wk JOIN bn USING (representative_id)")
def itm_work(spark, sf):
    return work(spark, sf)[0].select("representative_id", "representative_name", "occurrences", "aliases", "p_type", "status")


@query("itm_alias_links", f"WITH {WORK} SELECT institution_id, item_code, name, representative_id FROM lk")
def itm_links(spark, sf):
    return work(spark, sf)[1].select("institution_id", "item_code", "name", "representative_id")


@query("itm_stable_ids", "SELECT p_partkey, 'ITEM-' || sha256(p_name)[:20] AS item_id FROM part")
def itm_ids(spark, sf):
    return b.table(spark, sf, "part").select("p_partkey", stable_id("ITEM-", F.col("p_name")).alias("item_id"))


@query("itm_join_unique", "SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type))[:20], ';') AS types, array_to_string(list_sort(list(DISTINCT p_name))[:20], ';') AS names FROM part GROUP BY 1")
def itm_unique(spark, sf):
    return b.table(spark, sf, "part").groupBy("p_brand").agg(join_unique(F.col("p_type")).alias("types"), join_unique(F.col("p_name")).alias("names"))


@query("itm_quality_gates", f"WITH {ALIASES}, e AS (SELECT 'short_name' AS rule FROM cl WHERE length(name) < 9 UNION ALL SELECT 'bad_quantity' FROM cl WHERE l_quantity > 49 UNION ALL SELECT 'late' FROM cl WHERE date > DATE '2001-06-01') SELECT rule, count(*) AS rows FROM e GROUP BY 1")
def itm_gates(spark, sf):
    return op.validated(cleaned(spark, sf), [(F.length("name") < 9, "short_name"), (F.col("l_quantity") > 49, "bad_quantity"), (F.col("date") > F.lit("2001-06-01").cast("date"), "late")])


@query("itm_fact_enrichment", f"WITH {WORK} SELECT l_orderkey, l_linenumber, cl.institution_id, cl.item_code, representative_id, l_quantity FROM cl LEFT JOIN (SELECT DISTINCT institution_id, item_code, name, representative_id FROM lk) USING (institution_id, item_code, name)")
def itm_enrich(spark, sf):
    links = work(spark, sf)[1].select("institution_id", "item_code", "name", "representative_id").distinct()
    return cleaned(spark, sf).join(links, ["institution_id", "item_code", "name"], "left").select("l_orderkey", "l_linenumber", "institution_id", "item_code", "representative_id", "l_quantity")


@query("itm_tiered_master_match", """WITH m AS (SELECT p_partkey AS code, p_partkey AS code_key, lower(p_name) || p_size AS strict_key, lower(p_name) AS core_key FROM part WHERE p_partkey % 3 = 0),
i AS (SELECT p_partkey AS item, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END AS code_key, lower(p_name) || p_size AS strict_key, lower(p_name) AS core_key FROM part),
c AS (SELECT code_key, min(code) AS h1 FROM m GROUP BY 1 HAVING count(DISTINCT code) = 1), s AS (SELECT strict_key, min(code) AS h2 FROM m GROUP BY 1 HAVING count(DISTINCT code) = 1), k AS (SELECT core_key, min(code) AS h3 FROM m GROUP BY 1 HAVING count(DISTINCT code) = 1)
SELECT item, coalesce(h1, h2, h3) AS matched_code, CASE WHEN h1 IS NOT NULL THEN 'code_key' WHEN h2 IS NOT NULL THEN 'strict_key' WHEN h3 IS NOT NULL THEN 'core_key' ELSE 'none' END AS match_method, CAST(CASE WHEN h1 IS NOT NULL THEN 1.0 WHEN h2 IS NOT NULL THEN 0.95 WHEN h3 IS NOT NULL THEN 0.9 ELSE 0 END AS DOUBLE) AS confidence
FROM i LEFT JOIN c USING (code_key) LEFT JOIN s USING (strict_key) LEFT JOIN k USING (core_key)""")
def itm_match(spark, sf):
    p = b.table(spark, sf, "part")
    keys = {"strict_key": F.concat(F.lower("p_name"), F.col("p_size").cast("string")), "core_key": F.lower("p_name")}
    master = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("code"), F.col("p_partkey").alias("code_key"), *(v.alias(k) for k, v in keys.items()))
    item = p.select(F.col("p_partkey").alias("item"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).alias("code_key"), *(v.alias(k) for k, v in keys.items()))
    return op.tiered_match(item, master, [("code_key", 1.0), ("strict_key", 0.95), ("core_key", 0.9)], "code").select("item", "matched_code", "match_method", "confidence")


@query("itm_claims_unnest", "WITH g AS (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS t FROM part GROUP BY 1) SELECT p_brand, CAST(i AS INTEGER) AS position, t[i] AS code, lower(t[i]) AS name FROM g, unnest(range(1, len(t) + 1)) AS u(i)")
def itm_claims(spark, sf):
    g = b.table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("codes"))
    zipped = F.arrays_zip(F.col("codes").alias("code"), F.transform("codes", F.lower).alias("name"))
    return g.select("p_brand", F.posexplode(zipped).alias("p", "x")).select("p_brand", (F.col("p") + 1).cast("int").alias("position"), F.col("x.code").alias("code"), F.col("x.name").alias("name"))


@query("itm_unresolved_queue", f"WITH {WORK} SELECT representative_id, CASE WHEN occurrences <= 1 THEN 'one_off' ELSE 'active' END AS scope, occurrences FROM wk WHERE status = 'conflict'")
def itm_queue(spark, sf):
    q = work(spark, sf)[0].where("status = 'conflict'")
    return q.select("representative_id", F.when(F.col("occurrences") <= 1, "one_off").otherwise("active").alias("scope"), "occurrences").orderBy("scope", F.desc("occurrences"), "representative_id")


@query("itm_supply_clusters", "WITH c AS (SELECT CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'FAST' WHEN p_type = 'STANDARD' THEN 'BASE' ELSE 'OTHER' END AS cluster, count(*) AS items FROM part GROUP BY 1) SELECT cluster, items, round(items / sum(items) OVER (), 6) AS share FROM c")
def itm_clusters(spark, sf):
    from pyspark.sql import Window as W

    lookup = spark.createDataFrame([("ECONOMY", "FAST"), ("PROMO", "FAST"), ("STANDARD", "BASE")], "p_type string, cluster string")
    g = b.table(spark, sf, "part").join(F.broadcast(lookup), "p_type", "left").groupBy(F.coalesce("cluster", F.lit("OTHER")).alias("cluster")).agg(F.count("*").alias("items"))
    return g.withColumn("share", F.round(F.col("items") / F.sum("items").over(W.partitionBy()), 6))


@query("cls_local_rollup", f"WITH {WORK} SELECT item_code, count(DISTINCT representative_id) AS representatives, count(DISTINCT representative_id) FILTER (WHERE status = 'consistent') AS approved_representatives, count(DISTINCT row(lk.p_type, lk.p_brand)) AS tuples, count(DISTINCT representative_id) = count(DISTINCT representative_id) FILTER (WHERE status = 'consistent') AND count(DISTINCT row(lk.p_type, lk.p_brand)) = 1 AS is_approved FROM lk JOIN wk USING (representative_id) GROUP BY 1")
def cls_rollup(spark, sf):
    raw = aliases(spark, sf).groupBy("item_code", "raw", "p_type", "p_brand").agg(F.count("*").alias("occurrences"))  # institutions don't matter here, and a part has few raw names
    named = raw.withColumn("name", op.clean_name(F.col("raw"), None)).withColumn("strict_name", op.match_key(F.col("name"))).drop("raw")
    w, links = op.worklist(stored(named, "names"), ["p_type", "p_brand"])
    j = links.join(w.select("representative_id", (F.col("status") == "consistent").alias("ok")), "representative_id")
    return op.rollup_approval(j, "item_code", "representative_id", "ok", ["p_type", "p_brand"])


@query("cls_cluster_agreement", """WITH r AS (SELECT p_brand AS c, p_type AS f FROM part), n AS (SELECT c, f, count(*) AS n FROM r GROUP BY 1, 2), a AS (SELECT c, sum(n) AS a FROM n GROUP BY 1), d AS (SELECT f, sum(n) AS b FROM n GROUP BY 1),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) / (SELECT sum(a * (a - 1) / 2) FROM a) AS precision, (SELECT sum(n * (n - 1) / 2) FROM n) / (SELECT sum(b * (b - 1) / 2) FROM d) AS recall, (SELECT sum(n * n / a) / sum(n) FROM n JOIN a USING (c)) AS b3_precision, (SELECT sum(n * n / b) / sum(n) FROM n JOIN d USING (f)) AS b3_recall)
SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1, round(b3_precision, 6) AS b3_precision, round(b3_recall, 6) AS b3_recall, round(2 * b3_precision * b3_recall / (b3_precision + b3_recall), 6) AS b3_f1 FROM s""")
def cls_agreement(spark, sf):
    m = op.cluster_agreement(b.table(spark, sf, "part"), "p_brand", "p_type")
    return m.select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "b3_precision", "b3_recall", "b3_f1")))


@query("cls_over_merge_split", "WITH g AS (SELECT p_brand, count(DISTINCT p_type) AS n FROM part GROUP BY 1), h AS (SELECT p_name, count(DISTINCT p_brand) AS m FROM part GROUP BY 1) SELECT p_partkey, n > 5 AS over_merged, m > 20 AS over_split FROM part JOIN g USING (p_brand) JOIN h USING (p_name)")
def cls_over(spark, sf):
    p = b.table(spark, sf, "part")
    g, h = p.groupBy("p_brand").agg(F.count_distinct("p_type").alias("n")), p.groupBy("p_name").agg(F.count_distinct("p_brand").alias("m"))
    return p.join(g, "p_brand").join(h, "p_name").select("p_partkey", (F.col("n") > 5).alias("over_merged"), (F.col("m") > 20).alias("over_split"))


@query("cls_attention_flags", "SELECT p_partkey, concat_ws(';', CASE WHEN p_size > 40 THEN 'LARGE' END, CASE WHEN p_type = 'PROMO' THEN 'PROMO' END, CASE WHEN p_retailprice > 1500 THEN 'PRICE' END) AS flags, coalesce(CASE WHEN p_size > 40 THEN 'LARGE' END, CASE WHEN p_type = 'PROMO' THEN 'PROMO' END, CASE WHEN p_retailprice > 1500 THEN 'PRICE' END, 'REFERENCE') AS primary_flag FROM part")
def cls_flags(spark, sf):
    from provisio.functions import flags

    f = flags([(F.col("p_size") > 40, "LARGE"), (F.col("p_type") == "PROMO", "PROMO"), (F.col("p_retailprice") > 1500, "PRICE")])
    return b.table(spark, sf, "part").withColumn("f", f).select("p_partkey", F.array_join("f", ";").alias("flags"), F.coalesce(F.try_element_at("f", F.lit(1)), F.lit("REFERENCE")).alias("primary_flag"))


@query("cls_run_comparison", "WITH a AS (SELECT p_type, count(*) AS previous FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), c AS (SELECT p_type, count(*) AS current FROM part WHERE p_size > 10 GROUP BY 1) SELECT p_type, coalesce(previous, 0) AS previous, coalesce(current, 0) AS current, coalesce(current, 0) - coalesce(previous, 0) AS change FROM a FULL JOIN c USING (p_type)")
def cls_runs(spark, sf):
    p = b.table(spark, sf, "part")
    a, c = p.where("p_partkey % 2 = 0").groupBy("p_type").agg(F.count("*").alias("previous")), p.where("p_size > 10").groupBy("p_type").agg(F.count("*").alias("current"))
    return a.join(c, "p_type", "full_outer").fillna(0, ["previous", "current"]).withColumn("change", F.col("current") - F.col("previous"))


@query("cls_evidence_scenarios", """WITH e AS (SELECT *, least(greatest(CASE p_type WHEN 'STANDARD' THEN 0.9 WHEN 'PROMO' THEN 0.6 ELSE 0.4 END + CASE WHEN p_size > 25 THEN 0.1 ELSE 0 END - CASE WHEN p_partkey % 7 = 0 THEN 0.35 ELSE 0 END, 0), 1) AS score FROM part)
SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (WHERE score >= t - 1e-9) AS accepted, round(count(*) FILTER (WHERE score >= t - 1e-9) / count(*), 6) AS coverage, round(coalesce(sum(p_retailprice) FILTER (WHERE score >= t - 1e-9), 0) / sum(p_retailprice), 6) AS value_coverage FROM e, (VALUES (0.3), (0.5), (0.7), (0.9)) v(t) GROUP BY t""")
def cls_scenarios(spark, sf):
    c = F.col
    score = F.when(c("p_type") == "STANDARD", 0.9).when(c("p_type") == "PROMO", 0.6).otherwise(0.4) + F.when(c("p_size") > 25, 0.1).otherwise(0.0) - F.when(c("p_partkey") % 7 == 0, 0.35).otherwise(0.0)
    rows = b.table(spark, sf, "part").withColumns({"score": F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), "threshold": F.explode(F.array(*(F.lit(x) for x in (0.3, 0.5, 0.7, 0.9))))})
    ok = c("score") >= c("threshold") - 1e-9
    return rows.groupBy("threshold").agg(F.count_if(ok).alias("accepted"), F.round(F.count_if(ok) / F.count("*"), 6).alias("coverage"), F.round(F.coalesce(F.sum(F.when(ok, c("p_retailprice"))), F.lit(0.0)) / F.sum("p_retailprice"), 6).alias("value_coverage"))


@query("cls_field_regression", "WITH x AS (SELECT a.p_partkey, a.p_type = c.p_type AS t, a.p_brand = c.p_brand AS f FROM part a LEFT JOIN part c ON c.p_partkey = a.p_partkey + 1) SELECT round(avg(CAST(t AS DOUBLE)), 6) AS type_agreement, round(avg(CAST(f AS DOUBLE)), 6) AS brand_agreement, round(avg(CAST(t AND f AS DOUBLE)), 6) AS both_agreement FROM x")
def cls_regression(spark, sf):
    p = b.table(spark, sf, "part")
    n = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_type").alias("t"), F.col("p_brand").alias("f"))
    j = p.join(n, "p_partkey", "left").select((F.col("p_type") == F.col("t")).alias("t"), (F.col("p_brand") == F.col("f")).alias("f"))
    return j.agg(*(F.round(F.avg(x.cast("double")), 6).alias(k) for k, x in (("type_agreement", F.col("t")), ("brand_agreement", F.col("f")), ("both_agreement", F.col("t") & F.col("f")))))


@query("mat_consensus_vote", "WITH v AS (SELECT p_name, p_brand, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT p_name, first(p_brand ORDER BY n DESC, p_brand) AS winner, max(n) AS votes, round(max(n) / sum(n), 6) AS consensus, count(*) > 1 AS multiple FROM v GROUP BY 1")
def mat_vote(spark, sf):
    li, p = b.table(spark, sf, "lineitem"), b.table(spark, sf, "part")
    return op.consensus(li.join(p, li["l_partkey"] == p["p_partkey"]), "p_name", "p_brand", "l_suppkey").withColumn("consensus", F.round("consensus", 6))


@query("mat_fill_blanks", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE p_type END AS p_type FROM part")
def mat_fill(spark, sf):
    p = b.table(spark, sf, "part")
    df = p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_type")).alias("p_type"))
    return op.fill_blanks(df, p.select("p_partkey", F.lower("p_type").alias("p_type")), "p_partkey", ["p_type"])


@query("mat_inverted_index", "WITH c AS (SELECT p_partkey, unnest([p_type, split_part(p_name, ' ', 1)]) AS code FROM part) SELECT code, count(DISTINCT p_partkey) AS items FROM c GROUP BY 1")
def mat_index(spark, sf):
    p = b.table(spark, sf, "part").withColumn("codes", F.concat_ws(";", "p_type", F.regexp_extract("p_name", r"^(\w+)", 1)))
    return op.inverted_index(p, "p_partkey", "codes")


@query("mat_country_weights", "WITH c AS (SELECT p_type, s_nationkey, sum(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), s AS (SELECT *, v / sum(v) OVER (PARTITION BY p_type) AS share FROM c), w AS (SELECT *, sum(share) OVER (PARTITION BY p_type ORDER BY share DESC, s_nationkey) - share AS before FROM s) SELECT p_type, s_nationkey, round(share, 6) AS share FROM w WHERE before < 0.98 AND share >= 0.01")
def mat_countries(spark, sf):
    li, p, s = (b.table(spark, sf, t) for t in ("lineitem", "part", "supplier"))
    j = li.join(p, li["l_partkey"] == p["p_partkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])
    return op.country_weights(j, "p_type", "s_nationkey", "l_extendedprice").select("p_type", "s_nationkey", F.round("share", 6).alias("share"))


@query("mat_demand_share", "SELECT p_type AS material, round(100 * sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem JOIN part ON l_partkey = p_partkey), 6) AS share_pct FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def mat_share(spark, sf):
    from pyspark.sql import Window as W

    li, p = b.table(spark, sf, "lineitem"), b.table(spark, sf, "part")
    g = li.join(p, li["l_partkey"] == p["p_partkey"]).groupBy(F.col("p_type").alias("material")).agg(F.sum(F.greatest("l_quantity", F.lit(0.0))).alias("q"))
    return g.select("material", F.round(100 * F.col("q") / F.sum("q").over(W.partitionBy()), 6).alias("share_pct"))


@query("mat_tier_grouping", "WITH n AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN n >= 35 THEN 'tier1' WHEN p_size > 25 THEN 'tier2' WHEN p_type <> 'PROMO' THEN 'tier3' ELSE 'none' END AS tier FROM part JOIN n USING (p_name)")
def mat_tiers(spark, sf):
    from provisio.functions import ladder

    p = b.table(spark, sf, "part")
    j = p.join(p.groupBy("p_name").agg(F.count("*").alias("n")), "p_name")
    return j.select("p_partkey", ladder([(F.col("n") >= 35, "tier1"), (F.col("p_size") > 25, "tier2"), (F.col("p_type") != "PROMO", "tier3")], "none").alias("tier"))


@query("mat_impact_diff", "WITH a AS (SELECT p_type, sum(p_size) AS v FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), c AS (SELECT p_type, sum(p_size) AS v FROM part WHERE p_type <> 'PROMO' GROUP BY 1) SELECT p_type, CAST(a.v AS BIGINT) AS before, CAST(c.v AS BIGINT) AS after, CASE WHEN a.v IS NULL THEN 'added' WHEN c.v IS NULL THEN 'removed' WHEN abs(a.v - c.v) > 1e-9 THEN 'changed' ELSE 'same' END AS side FROM a FULL JOIN c USING (p_type)")
def mat_diff(spark, sf):
    from provisio.functions import ladder

    p = b.table(spark, sf, "part")
    a, c = p.where("p_partkey % 2 = 0").groupBy("p_type").agg(F.sum("p_size").alias("before")), p.where("p_type <> 'PROMO'").groupBy("p_type").agg(F.sum("p_size").alias("after"))
    side = ladder([(F.col("before").isNull(), "added"), (F.col("after").isNull(), "removed"), (F.abs(F.col("before") - F.col("after")) > 1e-9, "changed")], "same")
    return a.join(c, "p_type", "full_outer").select("p_type", "before", "after", side.alias("side"))


# ---- news


@query("news_relevance_filter", "SELECT doc_id, regexp_matches(lower(text), 'license|token|theand') AS relevant FROM documents")
def news_relevant(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", F.lower("text").rlike("license|token|theand").alias("relevant"))


@query("news_synthetic_share", "SELECT source, round(avg(CAST(contains(lower(text), 'license') AS DOUBLE)), 6) AS share, avg(CAST(contains(lower(text), 'license') AS DOUBLE)) >= 0.8 AS blocked FROM documents GROUP BY 1")
def news_synthetic(spark, sf):
    s = F.avg(F.lower("text").contains("license").cast("double"))
    return b.table(spark, sf, "documents").groupBy("source").agg(F.round(s, 6).alias("share"), (s >= 0.8).alias("blocked"))


@query("news_code_overlap", "WITH c AS (SELECT p_partkey, unnest([p_type, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)]) AS code FROM part), d AS (SELECT p_brand, unnest(list_distinct([p_type, split_part(p_name, ' ', 2)])) AS code FROM part) SELECT p_brand, count(DISTINCT c.p_partkey) AS items FROM (SELECT DISTINCT * FROM d) d JOIN c USING (code) GROUP BY 1")
def news_overlap(spark, sf):
    p = b.table(spark, sf, "part")
    word = lambda k: F.element_at(F.split("p_name", " "), k)
    items = p.select("p_partkey", split_codes(F.concat_ws(";", "p_type", word(1), word(2))).alias("codes"))
    owners = p.select("p_brand", F.explode(split_codes(F.concat_ws(";", "p_type", word(2)))).alias("code"))
    return op.code_overlap(items, "p_partkey", owners, "p_brand").withColumnRenamed("n", "items")
