"""Queries on review periods, reference clusters, frozen fields, signals by factor, consolidated masters and folded axes."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio.operators import agreement as op
from provisio.operators import analysis as an
from provisio.operators import selection as so
from provisio.plans import bindings as b
from provisio.plans import features as fea
from provisio.plans import signals as ps
from provisio.registry import query
from provisio.sources import stored

GAPS = "e AS (SELECT DISTINCT l_partkey, l_shipdate::DATE AS d FROM lineitem), g0 AS (SELECT l_partkey, d, d - lag(d) OVER (PARTITION BY l_partkey ORDER BY d) AS gap FROM e), g AS (SELECT *, d - DATE '1970-01-01' AS day FROM g0 WHERE gap BETWEEN 1 AND 365)"


def gaps(spark, sf):
    e = b.table(spark, sf, "lineitem").select("l_partkey", F.col("l_shipdate").cast("date").alias("d"))
    return an.gaps(e, ["l_partkey"], "d").withColumn("day", F.datediff("d", F.lit("1970-01-01").cast("date")))


@query("lt_review_periods", f"""WITH {GAPS}, s AS (SELECT l_partkey, count(*) AS n, median(gap) AS m, var_samp(gap) AS v FROM g GROUP BY 1 HAVING count(*) >= 5),
t AS (SELECT avg(v) / greatest(var_samp(m), 1e-9) AS k, (SELECT median(gap) FROM g) AS grand FROM s)
SELECT l_partkey, n, m AS median_gap, round(n / (n + k), 5) AS credibility, round(n / (n + k) * m + (1 - n / (n + k)) * grand, 5) AS review_period FROM s, t""")
def lt_review(spark, sf):
    out = op.review_periods(gaps(spark, sf), "l_partkey", "gap")
    return out.withColumns({c: F.round(c, 5) for c in ("credibility", "review_period")})


@query("lt_split_half", f"""WITH {GAPS}, h AS (SELECT *, day > (SELECT median(day) FROM g) AS late FROM g),
m AS (SELECT l_partkey, median(gap) FILTER (WHERE NOT late) AS early, median(gap) FILTER (WHERE late) AS late FROM h GROUP BY 1 HAVING count(*) FILTER (WHERE late) >= 2 AND count(*) FILTER (WHERE NOT late) >= 2),
r AS (SELECT rank() OVER (ORDER BY early) + (count(*) OVER (PARTITION BY early) - 1) / 2.0 AS x, rank() OVER (ORDER BY late) + (count(*) OVER (PARTITION BY late) - 1) / 2.0 AS y FROM m)
SELECT count(*) AS items, round(corr(x, y), 5) AS rho FROM r""")
def lt_halves(spark, sf):
    """Whether a part's gaps in the first half of the history tell those in the second."""
    h = stored(op.halves(stored(gaps(spark, sf), "gaps"), "l_partkey", "gap", "day"), "halves")  # both are read several times
    rho = op.spearman(h, "early", "late")
    return h.agg(F.count("*").alias("items")).withColumn("rho", F.round(F.lit(rho).cast("double"), 5))


@query("cls_reference_clusters", """WITH a AS (SELECT p_partkey, p_brand || '-' || (p_size % 5) AS cluster FROM part),
rf AS (SELECT p_partkey, p_type || '-' || (p_size % 3) AS ref FROM part WHERE p_partkey % 13 <> 0 UNION ALL SELECT p_partkey, p_type || '-X' FROM part WHERE p_partkey % 11 = 0 UNION ALL SELECT -p_partkey, p_type FROM part WHERE p_partkey % 17 = 0),
k AS (SELECT p_partkey, min(ref) AS ref, count(DISTINCT ref) AS n FROM rf GROUP BY 1),
j AS (SELECT p_partkey, cluster, CASE WHEN cluster IS NULL THEN 'reference_only' WHEN ref IS NULL THEN 'missing_reference' WHEN n > 1 THEN 'ambiguous_reference' ELSE 'matched' END AS status, CASE WHEN n = 1 THEN ref END AS ref FROM a FULL JOIN k USING (p_partkey)),
m AS (SELECT cluster, count(DISTINCT ref) AS x FROM j WHERE status = 'matched' GROUP BY 1), s AS (SELECT ref, count(DISTINCT cluster) AS y FROM j WHERE status = 'matched' GROUP BY 1)
SELECT p_partkey, j.cluster, status, j.ref, CASE WHEN status = 'matched' THEN x ELSE 0 END AS refs_of_cluster, CASE WHEN status = 'matched' THEN y ELSE 0 END AS clusters_of_ref,
  CASE WHEN status <> 'matched' THEN '' WHEN x > 1 AND y > 1 THEN 'over_merge_and_split' WHEN x > 1 THEN 'over_merge' WHEN y > 1 THEN 'over_split' ELSE '' END AS reason FROM j LEFT JOIN m USING (cluster) LEFT JOIN s ON s.ref = j.ref""")
def cls_reference(spark, sf):
    p = b.table(spark, sf, "part")
    name = lambda c, n: F.concat(F.col(c), F.lit("-"), (F.col("p_size") % n).cast("string"))
    reference = p.where("p_partkey % 13 <> 0").select("p_partkey", name("p_type", 3).alias("ref"))
    reference = reference.unionByName(p.where("p_partkey % 11 = 0").select("p_partkey", F.concat("p_type", F.lit("-X")).alias("ref"))).unionByName(p.where("p_partkey % 17 = 0").select((-F.col("p_partkey")).alias("p_partkey"), F.col("p_type").alias("ref")))
    return op.reference_clusters(p.select("p_partkey", name("p_brand", 5).alias("cluster")), reference, "p_partkey", "cluster", "ref")


FIELDS = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query("cls_regression_fields", """WITH o AS (SELECT p_partkey, p_name, p_brand, CASE WHEN p_size % 9 = 0 THEN '' ELSE p_type END AS p_type, p_size, p_retailprice FROM part),
n AS (SELECT p_partkey, p_name, CASE WHEN p_size > 45 THEN 'other' ELSE p_brand END AS p_brand, CASE WHEN p_size % 9 <> 0 THEN p_type END AS p_type, p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS p_size, p_retailprice FROM part WHERE p_partkey % 19 <> 0),
j AS (SELECT n.p_partkey IS NOT NULL AS f, coalesce(o.p_name = n.p_name, FALSE) AS p_name, coalesce(o.p_brand = n.p_brand, FALSE) AS p_brand, n.p_partkey IS NOT NULL AND o.p_type = coalesce(n.p_type, '') AS p_type, coalesce(o.p_size = n.p_size, FALSE) AS p_size, coalesce(o.p_retailprice = n.p_retailprice, FALSE) AS p_retailprice FROM o LEFT JOIN n USING (p_partkey)),
l AS (SELECT f, unnest(['p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice', 'all']) AS field, unnest([p_name, p_brand, p_type, p_size, p_retailprice, p_name AND p_brand AND p_type AND p_size AND p_retailprice]) AS ok FROM j)
SELECT field, count(*) FILTER (WHERE ok) AS matched, count(*) AS evaluated, round(count(*) FILTER (WHERE ok) / count(*), 6) AS rate, count(*) FILTER (WHERE f) AS found FROM l GROUP BY 1""")
def cls_fields(spark, sf):
    p = b.table(spark, sf, "part").select("p_partkey", *FIELDS)
    plain = F.col("p_size") % 9 != 0
    old = p.withColumn("p_type", F.when(plain, F.col("p_type")).otherwise(""))
    new = p.where("p_partkey % 19 <> 0").withColumns({"p_brand": F.when(F.col("p_size") > 45, "other").otherwise(F.col("p_brand")), "p_type": F.when(plain, F.col("p_type")), "p_size": F.col("p_size") + F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0)})
    return op.field_regression(old, new, "p_partkey", FIELDS).withColumn("rate", F.round("rate", 6))


_X = "(abs(atanh(partial_r) * sqrt(n - 4)) / sqrt(2.0::DOUBLE))"
_T = f"(1 / (1 + 0.3275911::DOUBLE * {_X}))"
_P = f"{_T} * (0.254829592::DOUBLE + {_T} * (-0.284496736::DOUBLE + {_T} * (1.421413741::DOUBLE + {_T} * (-1.453152027::DOUBLE + {_T} * 1.061405429::DOUBLE)))) * exp(-{_X} * {_X})"


@query("news_factor_volatility", f"""WITH {ps.CASCADE}, {fea.PRICES}, c AS (SELECT month(DATE '2024-01-01' + CAST(article_id % 366 AS INTEGER)) - 1 AS k, ln(1 + count(*) FILTER (WHERE event_type <> 'none')) AS x FROM ca GROUP BY 1),
m AS (SELECT factor, year(date) * 12 + month(date) AS mm, month(date) - 1 AS k, stddev_samp(price) AS v FROM prices GROUP BY 1, 2, 3),
j AS (SELECT factor, x, v, lead(v) OVER (PARTITION BY factor ORDER BY mm) AS y FROM m JOIN c USING (k)), j1 AS (SELECT * FROM j WHERE y IS NOT NULL AND v IS NOT NULL),
g AS (SELECT factor, count(*) AS n, corr(x, y) AS raw_r, corr(x, v) AS xv, corr(y, v) AS yv FROM j1 GROUP BY 1 HAVING count(*) >= 8),
q AS (SELECT factor, n, raw_r, (raw_r - xv * yv) / sqrt((1 - xv * xv) * (1 - yv * yv)) AS partial_r FROM g), pp AS (SELECT *, {_P} AS p FROM q)
SELECT factor, n, round(raw_r, 5) AS raw_r, round(partial_r, 5) AS partial_r, round(p, 5) AS p, round(least(p * count(*) OVER (), 1), 5) AS bonferroni_p FROM pp""")
def news_factors(spark, sf):
    """Event articles of each month of the year against every factor's volatility of the month after."""
    k = F.month(F.expr("date_add(date'2024-01-01', cast(article_id % 366 as int))")) - 1
    c = ps.cascade(spark, sf).groupBy(k.alias("k")).agg(F.log1p(F.count_if(F.col("event_type") != "none")).alias("x"))
    m = fea.prices(spark, sf).groupBy("factor", (F.year("date") * 12 + F.month("date")).alias("mm"), (F.month("date") - 1).alias("k")).agg(F.stddev_samp("price").alias("v"))
    out = op.partial_by_factor(m.join(F.broadcast(c), "k"), "factor", "mm", "x", "v")  # twelve rows
    return out.select("factor", "n", *(F.round(x, 5).alias(x) for x in ("raw_r", "partial_r", "p", "bonferroni_p")))


@query("itm_master_consolidation", """WITH m AS (SELECT 'product' AS source, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE CAST(p_partkey AS VARCHAR) END AS code, CAST(p_partkey AS VARCHAR) AS record, CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN '[]' ELSE 'not_provided' END AS material FROM part
  UNION ALL SELECT 'attributes', CAST(l_partkey AS VARCHAR), CAST(l_orderkey AS VARCHAR), CASE WHEN l_quantity > 25 THEN l_returnflag ELSE '' END FROM lineitem UNION ALL SELECT 'registry', CAST(s_suppkey AS VARCHAR), '', '[]' FROM supplier),
k AS (SELECT *, CASE WHEN trim(code) <> '' THEN code ELSE record END AS key FROM m), a AS (SELECT key, string_agg(DISTINCT material, ';' ORDER BY material) AS v FROM k WHERE source = 'attributes' AND material <> '' GROUP BY 1)
SELECT source, code, record, CASE WHEN source = 'product' AND material IN ('', '[]', 'not_provided') THEN coalesce(v, material) ELSE material END AS material FROM k LEFT JOIN a USING (key) WHERE source <> 'attributes'""")
def itm_consolidation(spark, sf):
    text = lambda c: F.col(c).cast("string")
    k = F.col("p_size") % 3
    products = b.table(spark, sf, "part").select(F.lit("product").alias("source"), F.when(F.col("p_partkey") % 7 == 0, " ").otherwise(text("p_partkey")).alias("code"), text("p_partkey").alias("record"), F.when(k == 0, F.col("p_type")).when(k == 1, "[]").otherwise("not_provided").alias("material"))
    attributes = b.table(spark, sf, "lineitem").select(F.lit("attributes").alias("source"), text("l_partkey").alias("code"), text("l_orderkey").alias("record"), F.when(F.col("l_quantity") > 25, F.col("l_returnflag")).otherwise("").alias("material"))
    others = b.table(spark, sf, "supplier").select(F.lit("registry").alias("source"), text("s_suppkey").alias("code"), F.lit("").alias("record"), F.lit("[]").alias("material"))
    return op.consolidated(products.unionByName(attributes).unionByName(others), "source", "code", "record", "product", "attributes", ["material"])


@query("itm_axis_folding", """WITH r AS (SELECT CASE WHEN regexp_matches(p_brand, '^Brand#1[0-9]') THEN 'Brand#1' WHEN regexp_matches(p_brand, '^Brand#2[0-9]') THEN 'Brand#2' WHEN regexp_matches(p_brand, '^Brand#[0-9]') THEN 'Brand#' END || '/' || p_size AS axis, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS material, p_retailprice AS weight FROM part WHERE p_name IS NOT NULL),
a AS (SELECT axis, string_agg(DISTINCT material, ';' ORDER BY material) AS material, median(weight) AS weight, count(*) AS n, count(DISTINCT material) AS kinds FROM r WHERE axis IS NOT NULL GROUP BY 1)
SELECT axis, material, CASE WHEN kinds = 1 THEN round(weight, 5) END AS weight, n, CASE WHEN kinds = 1 THEN 'mapped' WHEN kinds > 1 THEN 'conflict' ELSE 'unmapped' END AS status FROM a""")
def itm_folding(spark, sf):
    p = b.table(spark, sf, "part").where("p_name is not null").withColumn("material", F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")))
    axis = F.concat(so.longest_prefix(F.col("p_brand"), ["Brand#", "Brand#1", "Brand#2"]), F.lit("/"), F.col("p_size").cast("string"))
    return op.folded_axis(p, axis, "material", "p_retailprice").withColumn("weight", F.round("weight", 5))
