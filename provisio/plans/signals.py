"""Queries on the news cascade, item matching, ten trade components and the rules of supply-risk records."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio.operators import risk as rk
from provisio.operators import signals as op
from provisio.plans import bindings as b
from provisio.plans import risk as pr
from provisio.registry import query
from provisio.sources import guarded_write, new_path, stored

Q = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"


def _pick(k, default):
    lit = lambda v: "NULL" if v is None else f"'{v}'"
    return f"CASE WHEN negated THEN {lit(default)} " + " ".join(f"WHEN list_has_any(cues, {Q(x[1])}) THEN {lit(x[k])}" for x in op.BRANCHES) + f" ELSE {lit(default)} END"


CASCADE = f"""c0 AS (SELECT doc_id AS article_id, lang, source, list_sort(list_intersect(list_distinct(string_split_regex(lower(coalesce(text, '')), '{op.NOT_LETTERS}')), {Q(op.CUES)})) AS cues FROM documents),
c1 AS (SELECT *, list_has_any(cues, {Q(op.NEGATION)}) AND len(cues) > 1 AS negated FROM c0),
c2 AS (SELECT *, {_pick(0, 'none')} AS branch, {_pick(2, 'none')} AS event_type, {_pick(3, 'flat')} AS direction, {_pick(4, None)} AS demand_code, {_pick(5, None)} AS material_code FROM c1),
ca AS (SELECT *, CASE WHEN event_type = 'none' THEN 0.0 WHEN len(cues) >= 3 THEN 0.9 WHEN len(cues) = 2 THEN 0.7 ELSE 0.4 END AS severity,
  (CAST(event_type <> 'none' AS INTEGER) + CAST(direction <> 'flat' AS INTEGER) + CAST(demand_code IS NOT NULL AS INTEGER) + CAST(material_code IS NOT NULL AS INTEGER) + CAST(len(cues) > 1 AS INTEGER)) / 5.0 AS completeness FROM c2)"""


def cascade(spark, sf):
    return op.cascaded(b.table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"), "lang", "source", "text"), "text").drop("text")


@query("news_event_cascade", f"WITH {CASCADE} SELECT article_id, branch, event_type, direction, demand_code, material_code, negated, CAST(severity AS DOUBLE) AS severity, round(0.7 * (0.6 + 0.1 * least(len(cues), 3)) + 0.3 * completeness, 6) AS confidence, array_to_string(cues, ';') AS cues FROM ca")
def news_cascade(spark, sf):
    return cascade(spark, sf).select("article_id", "branch", "event_type", "direction", "demand_code", "material_code", "negated", "severity", F.round("confidence", 6).alias("confidence"), F.array_join("cues", ";").alias("cues"))


@query("news_branch_report", f"WITH {CASCADE} SELECT branch, event_type, count(*) AS n, round(avg(severity), 6) AS severity FROM ca GROUP BY 1, 2")
def news_branches(spark, sf):
    return cascade(spark, sf).groupBy("branch", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("severity"), 6).alias("severity"))


ITEMS = f"""it0 AS (SELECT DISTINCT p_brand AS item, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS k FROM part),
it AS (SELECT item, ({Q(op.CUES)})[k % {len(op.CUES)} + 1] AS term, 'M' || (k % 7 + 1) AS material_code, 'D' || (k % 3) AS demand_code, (k % 10 + 1) / 10.0 AS weight FROM it0)"""


def items(spark, sf):
    k = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    t = b.table(spark, sf, "part").select(F.col("p_brand").alias("item"), k.alias("k")).distinct()
    return t.select("item", F.element_at(F.array(*(F.lit(w) for w in op.CUES)), F.col("k") % len(op.CUES) + 1).alias("term"), F.concat(F.lit("M"), F.col("k") % 7 + 1).alias("material_code"), F.concat(F.lit("D"), F.col("k") % 3).alias("demand_code"), ((F.col("k") % 10 + 1) / 10.0).alias("weight"))


@query("news_item_matching", f"""WITH {CASCADE}, {ITEMS}, a AS (SELECT * FROM ca WHERE event_type <> 'none'),
m AS (SELECT article_id, item, 1 AS rank, 'term' AS tier, weight FROM (SELECT article_id, unnest(cues) AS k FROM a) x JOIN it ON term = k UNION ALL SELECT article_id, item, 2, 'demand', weight FROM a JOIN it USING (demand_code) UNION ALL SELECT article_id, item, 3, 'material', weight FROM a JOIN it USING (material_code)),
z AS (SELECT article_id, item, tier, weight FROM m QUALIFY row_number() OVER (PARTITION BY article_id, item ORDER BY rank, weight DESC) = 1)
SELECT article_id, item, tier, CAST(weight AS DOUBLE) AS weight FROM z UNION ALL SELECT article_id, 'SUPPLY_WIDE', 'wide', 0.5 FROM a WHERE article_id NOT IN (SELECT article_id FROM z)""")
def news_matching(spark, sf):
    return op.matched_items(cascade(spark, sf), items(spark, sf))


@query("news_source_and_id", f"""WITH {CASCADE}, d AS (SELECT doc_id AS article_id, DATE '2024-01-01' + CAST(doc_id % 366 AS INTEGER) AS date, text[:40] AS title, CASE WHEN doc_id % 4 = 0 THEN ' id-' || doc_id || ' ' END AS given_id FROM documents)
SELECT article_id, CASE {' '.join(f"WHEN regexp_matches(source, '{p}') THEN '{v}'" for p, v in op.SOURCES)} ELSE 'other' END AS source_type, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in op.ALIASES.items())} ELSE upper(event_type) END AS event_alias,
  CASE WHEN trim(coalesce(given_id, '')) <> '' THEN trim(given_id) ELSE 'ART-' || sha256(concat_ws('|', CAST(date AS VARCHAR), source, title))[:16] END AS article_key FROM ca JOIN d USING (article_id)""")
def news_ids(spark, sf):
    d = b.table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"), "source", "text", F.expr("date_add(date'2024-01-01', cast(doc_id % 366 as int))").alias("date"), F.substring("text", 1, 40).alias("title"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" id-"), F.col("doc_id").cast("string"), F.lit(" "))).alias("given_id"))
    return op.identified(op.cascaded(d, "text"), "source", "event_type").select("article_id", "source_type", "event_alias", "article_key")


@query("news_mapping_inputs", f"WITH {CASCADE}, w AS (SELECT lang AS country, count(*) AS n FROM documents WHERE lang <> 'fr' GROUP BY 1) SELECT article_id, coalesce(round(n / 1000.0, 6), 0.5) AS country_weight, 'approved' AS review_status FROM ca LEFT JOIN w ON country = lang WHERE article_id % 3 <> 0")
def news_inputs(spark, sf):
    """Weights of countries with a default for unknown ones, approved rows only; the wide audit goes to a compressed table and comes back from there."""
    d = b.table(spark, sf, "documents")
    w = d.where("lang <> 'fr'").groupBy(F.col("lang").alias("country")).agg(F.round(F.count("*") / 1000.0, 6).alias("country_weight"))
    rows = cascade(spark, sf).withColumn("review_status", F.when(F.col("article_id") % 3 == 0, "draft")).join(w, F.col("lang") == F.col("country"), "left")
    audit = op.defaults(rows, {"country_weight": F.lit(0.5), "review_status": F.lit("approved"), "source_type": F.lit("other")})
    path = new_path(spark, "news-audit")
    guarded_write(audit, path)
    return spark.read.schema(audit.schema).parquet(path).where("review_status = 'approved'").select("article_id", "country_weight", "review_status")


TEN = pr.TRADE + """,
v0 AS (SELECT *, greatest(import_weight - export_weight, 0) AS net_volume, ln(unit_value) - ln(lag(unit_value) OVER (PARTITION BY hs_code ORDER BY month)) AS d FROM tt),
v1 AS (SELECT *, CASE WHEN count(import_weight) OVER s >= 3 THEN stddev_pop(import_weight) OVER s / nullif(avg(import_weight) OVER s, 0) END AS volume_cv, CASE WHEN count(d) OVER s >= 3 THEN stddev_pop(d) OVER s END AS price_vol FROM v0 WINDOW s AS (PARTITION BY hs_code ORDER BY month ROWS 5 PRECEDING)),
v2 AS (SELECT a.*, a.import_weight / nullif(p.import_weight, 0) - 1 AS import_weight_yoy, a.net_volume / nullif(p.net_volume, 0) - 1 AS net_volume_yoy, a.unit_value / nullif(p.unit_value, 0) - 1 AS unit_value_yoy, a.export_weight / nullif(p.export_weight, 0) - 1 AS export_weight_yoy FROM v1 a LEFT JOIN v1 p ON p.hs_code = a.hs_code AND p.month = a.month - INTERVAL 1 YEAR),
v3 AS (SELECT c.*, c.suppliers / nullif(p.suppliers, 0) - 1 AS suppliers_yoy FROM tc c LEFT JOIN tc p ON p.hs_code = c.hs_code AND p.month = c.month - INTERVAL 1 YEAR),
v4 AS (SELECT v2.*, v3.top1, v3.hhi, v3.coverage, v3.suppliers_yoy, tw.prior_positive, tw.zero_streak FROM v2 JOIN v3 USING (month, hs_code) JOIN tw USING (month, hs_code)),
v5 AS (SELECT month, hs_code, least(greatest(-import_weight_yoy, 0) / 0.3, 1) + 0 * import_weight_yoy AS volume_decline0, least(greatest(-net_volume_yoy, 0) / 0.3, 1) + 0 * net_volume_yoy AS net_import_decline0, CASE WHEN import_weight > 0 OR prior_positive THEN least(zero_streak / 3.0, 1) ELSE 0 END AS interruption0,
  least(greatest(unit_value_yoy, 0) / 0.25, 1) + 0 * unit_value_yoy AS price_increase0, least(volume_cv / 0.5, 1) + 0 * volume_cv AS volume_volatility0, least(price_vol / 0.3, 1) + 0 * price_vol AS price_volatility0, CASE WHEN coverage >= 0.5 THEN least(greatest((greatest(top1, hhi) - 0.3) / 0.7, 0), 1) END AS concentration0,
  least(greatest(-suppliers_yoy, 0) / 0.3, 1) + 0 * suppliers_yoy AS supplier_decline0, coalesce(least(greatest(import_value - export_value, 0) / nullif(import_value, 0), 1), 0) AS net_exposure0, least(greatest(export_weight_yoy, 0) / 0.5, 1) + 0 * export_weight_yoy AS export_surge0 FROM v4),
ten AS (SELECT month, hs_code, """ + ", ".join(f"coalesce({k}0, 0) AS {k}, {k}0 IS NOT NULL AS {k}_known" for k in op.COMPONENTS) + " FROM v5)"


def ten(spark, sf, f=None):
    f = pr.flows(spark, sf) if f is None else f
    t = rk.trade_totals(f).withColumn("net_volume", F.greatest(F.col("import_weight") - F.col("export_weight"), F.lit(0.0)))
    on = ["month", "hs_code"]
    change = lambda df, cs: rk.year_ago(df, cs).select(*on, *(f"{c}_yoy" for c in cs))
    c = rk.concentration(f, t)
    j = op.volume_windows(t).join(change(t, ["import_weight", "net_volume", "unit_value", "export_weight"]), on).join(rk.trade_windows(t).select(*on, "prior_positive", "zero_streak"), on).join(c, on).join(change(c, ["suppliers"]), on)
    return op.ten_components(j)


@query("trd_ten_components", f"WITH {TEN} SELECT month, hs_code, {', '.join(f'round({k}, 5) AS {k}' for k in op.COMPONENTS)}, round(({' + '.join(op.COMPONENTS)}) / 10.0, 5) AS trade_score, round(({' + '.join(f'CAST({k}_known AS INTEGER)' for k in op.COMPONENTS)}) / 10.0, 5) AS trade_confidence FROM ten")
def trd_ten(spark, sf):
    return ten(spark, sf).select("month", "hs_code", *(F.round(k, 5).alias(k) for k in (*op.COMPONENTS, "trade_score", "trade_confidence")))


def weights_sql(source: str = "ten", prior: dict[str, float] | None = None) -> str:
    """Common table expressions of the distribution weights; dr has a row per component."""
    prior = prior or dict.fromkeys(op.COMPONENTS, 0.1)
    ranks = ", ".join(f"rank() OVER (ORDER BY {k}) + (count(*) OVER (PARTITION BY {k}) - 1) / 2.0 AS {k}" for k in op.COMPONENTS)
    rows = " UNION ALL ".join(
        f"SELECT '{k}' AS component, {prior[k]}::DOUBLE AS prior, (SELECT avg(CAST({k}_known AS DOUBLE)) FROM tn) AS availability, (SELECT coalesce(list_avg(list_filter([{', '.join(f'abs(corr({k}, {o}))' for o in op.COMPONENTS if o != k)}], lambda x: NOT isnan(x))), 1.0) FROM rk) AS mean_correlation, (SELECT stddev_pop({k}) FROM tn) AS spread" for k in op.COMPONENTS
    )
    return f"tn AS (SELECT month, hs_code, {', '.join(f'round({k}, 9) AS {k}, {k}_known' for k in op.COMPONENTS)} FROM {source}), rk AS (SELECT {ranks} FROM tn), dw AS ({rows}), dr AS (SELECT *, prior * (0.5 + availability) * (0.5 + least(greatest(1 - mean_correlation, 0.05), 1)) * (0.5 + least(greatest(spread / nullif(max(spread) OVER (), 0), 0.05), 1)) AS raw FROM dw)"


FLOOR = """f0 AS (SELECT *, raw / sum(raw) OVER () AS share FROM dr), f1 AS (SELECT *, row_number() OVER (ORDER BY share, component) - 1 AS m, sum(share) OVER (ORDER BY share, component ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM f0),
f2 AS (SELECT min_by((1 - 0.03 * m) / tail, m) AS factor, min(m) AS m FROM f1 WHERE (1 - 0.03 * m) * share >= 0.03 * tail)"""


@query("trd_distribution_weights", f"WITH {TEN}, {weights_sql()}, {FLOOR} SELECT component, round(availability, 5) AS availability, round(mean_correlation, 5) AS mean_correlation, round(spread, 5) AS spread, round(share, 5) AS share, round(CASE WHEN f1.m < f2.m THEN 0.03 ELSE share * factor END, 5) AS weight FROM f1, f2")
def trd_weights(spark, sf):
    rows = stored(ten(spark, sf).select(*(F.round(k, 9).alias(k) for k in op.COMPONENTS), *(f"{k}_known" for k in op.COMPONENTS)), "ten")  # ranked and read several times
    w = op.distribution_weights(rows, dict.fromkeys(op.COMPONENTS, 0.1))
    return w.select("component", *(F.round(c, 5).alias(c) for c in ("availability", "mean_correlation", "spread", "share", "weight")))


# Made supply-risk records in which every rule is broken somewhere. The expressions run in both engines.
LEVEL_LIST = "array('NORMAL', 'WATCH', 'WARNING', 'CRITICAL')"
RECORDS = """r0 AS (SELECT p_partkey, p_type || ';' || CASE WHEN p_partkey % 6 = 0 THEN 'D:flu' ELSE p_brand END AS codes, p_size % 4 AS expected_rank, p_partkey % 6 = 0 AS demand_axis, p_partkey % 31 = 0 AS unmapped, p_partkey % 37 = 0 AS legacy,
    CASE WHEN p_partkey % 41 = 0 THEN 'SEVERE' WHEN p_partkey % 43 = 0 THEN '' ELSE LV[(p_size + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END) % 4 + OFFSET] END AS level, CASE WHEN p_partkey % 5 = 0 THEN 'event' WHEN p_partkey % 7 = 0 THEN 'approved_critical_override' ELSE 'policy' END AS level_source,
    CASE WHEN p_partkey % 17 = 0 THEN 'v2' WHEN p_partkey % 47 <> 0 THEN 'v3' END AS policy_version, ZV[p_size % 4 + OFFSET] AS z_expected, MV[p_size % 4 + OFFSET] AS multiplier_expected,
    CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE p_retailprice / 100 END AS mean_daily, CASE WHEN p_partkey % 59 = 0 THEN -1 ELSE p_size / 10 + 1 END AS sd, p_size % 30 + 5 AS lead, CASE WHEN p_partkey % 4 = 0 THEN 'WARNING' END AS event_level,
    CASE WHEN p_partkey % 19 = 0 THEN 'per_month' ELSE 'per_day' END AS rate_unit, 'per_sqrt_day' AS sd_unit, CASE WHEN p_partkey % 3 = 0 THEN 'level_based_v1' ELSE 'series' END AS method, p_partkey % 2 = 0 AS policy_applied, p_size % 3 AS risk_buffer FROM PART),
r1 AS (SELECT *, CASE level WHEN 'NORMAL' THEN 0 WHEN 'WATCH' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'CRITICAL' THEN 3 ELSE -1 END AS level_rank, CASE WHEN p_partkey % 61 = 0 THEN NULL WHEN p_partkey % 23 = 0 THEN z_expected + 0.1 ELSE z_expected END AS z, CASE WHEN p_partkey % 29 = 0 THEN 2.0 ELSE multiplier_expected END AS multiplier,
    z_expected * sd * sqrt(lead * multiplier_expected) AS ss_expected, mean_daily * lead * multiplier_expected + z_expected * sd * sqrt(lead * multiplier_expected) AS rop_expected FROM r0),
rc AS (SELECT *, ss_expected + CASE WHEN p_partkey % 67 = 0 THEN 1 ELSE 0 END AS ss, rop_expected + CASE WHEN p_partkey % 71 = 0 THEN 1 ELSE 0 END AS rop FROM r1)"""
DUCK = RECORDS.replace("LV[", "(['NORMAL', 'WATCH', 'WARNING', 'CRITICAL'])[").replace("ZV[", f"([{', '.join(f'{x}::DOUBLE' for x in op.Z)}])[").replace("MV[", f"([{', '.join(f'{x}::DOUBLE' for x in op.MULTIPLIER)}])[").replace("OFFSET", "1").replace("PART)", "part)").replace("p_size / 10 + 1", "p_size / 10.0::DOUBLE + 1")
SPARK = RECORDS.replace("LV[", f"{LEVEL_LIST}[").replace("ZV[", f"array({', '.join(f'{x}D' for x in op.Z)})[").replace("MV[", f"array({', '.join(f'{x}D' for x in op.MULTIPLIER)})[").replace("OFFSET", "0").replace("PART)", "{part})").replace("p_size / 10 + 1", "p_size / 10.0D + 1").replace("2.0 ELSE", "2.0D ELSE")
ORDERED = sorted([*op.RULES, ("SR013", "REVIEW", "split")])
AUDIT = DUCK + f""",
sp AS (SELECT codes, min(level) < max(level) AS split FROM rc WHERE level_rank >= 0 GROUP BY 1),
au AS (SELECT rc.*, concat_ws(';', {', '.join(f"CASE WHEN {c} THEN '{r}' END" for r, _, c in ORDERED)}) AS issues, CASE WHEN {' OR '.join(f'coalesce({c}, FALSE)' for _, a, c in ORDERED if a == 'BLOCK')} THEN 'BLOCK' WHEN {' OR '.join(f'coalesce({c}, FALSE)' for _, a, c in ORDERED if a == 'REVIEW')} THEN 'REVIEW' ELSE 'PASS' END AS quality_status FROM rc LEFT JOIN sp USING (codes))"""


def records(spark, sf):
    return op.audited(spark.sql(f"WITH {SPARK} SELECT * FROM rc", part=b.table(spark, sf, "part")), "p_partkey", "codes")


@query("rsk_record_rules", f"WITH {AUDIT} SELECT p_partkey, issues, quality_status FROM au")
def rsk_rules(spark, sf):
    return records(spark, sf).select("p_partkey", F.array_join("issues", ";").alias("issues"), "quality_status")


@query("rsk_issue_table", f"WITH {AUDIT} SELECT issue, count(*) AS rows, min(p_partkey) AS first_key FROM (SELECT p_partkey, unnest(string_split(issues, ';')) AS issue FROM au WHERE issues <> '') GROUP BY 1")
def rsk_issues(spark, sf):
    return records(spark, sf).select("p_partkey", F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("rows"), F.min("p_partkey").alias("first_key"))


@query("rsk_release_gate", f"""WITH {AUDIT}, g AS (SELECT count(*) AS rows, count(*) FILTER (WHERE quality_status = 'PASS') AS pass, count(*) FILTER (WHERE quality_status = 'REVIEW') AS review, count(*) FILTER (WHERE quality_status = 'BLOCK') AS block, avg(CAST(level_rank = 3 AS DOUBLE)) FILTER (WHERE level_rank >= 0) AS critical_share, sum(ss) FILTER (WHERE ss > 0 AND level_rank = 3) / sum(ss) FILTER (WHERE ss > 0) AS critical_stock_share FROM au),
h AS (SELECT *, concat_ws(';', CASE WHEN critical_share > 0.2 THEN 'SR014' END, CASE WHEN critical_stock_share > 0.4 THEN 'SR015' END) AS dataset_issues FROM g)
SELECT rows, pass, review, block, round(critical_share, 6) AS critical_share, round(critical_stock_share, 6) AS critical_stock_share, dataset_issues, CASE WHEN block > 0 OR dataset_issues <> '' THEN 'HOLD' WHEN review > 0 THEN 'REVIEW' ELSE 'RELEASE' END AS release FROM h""")
def rsk_release(spark, sf):
    r = op.release(records(spark, sf))
    return r.withColumns({c: F.round(c, 6) for c in ("critical_share", "critical_stock_share")})
