"""Queries on decisions from several sources. Both engines make the inputs by the same expressions."""

from __future__ import annotations

from provisio.operators import resolution as op
from provisio.plans import bindings as b
from provisio.registry import query

WORK = """wp AS (SELECT CAST(p_partkey AS BIGINT) AS rep_id, CAST(p_partkey % 10 AS INTEGER) AS k, CAST(p_partkey AS BIGINT) AS q, p_name, p_type, p_size, p_brand FROM {part}),
wl AS (SELECT rep_id, k, q, p_type, p_size, p_name AS name, CASE WHEN k <= 2 THEN 'SYRINGE' WHEN k = 3 THEN 'WASTE_BOX' ELSE '' END AS family, CASE WHEN k = 1 THEN '' WHEN k <= 3 THEN 'SUB_A' ELSE '' END AS subtype, CASE WHEN k = 3 AND q % 4 = 1 THEN 'BIG' WHEN k <= 3 THEN p_size || 'mL' ELSE '' END AS specification, CASE WHEN k <= 3 THEN 'EA' ELSE '' END AS unit,
  CASE WHEN k = 2 OR k BETWEEN 4 AND 7 THEN 'MED_ORAL' WHEN k <= 3 THEN 'MED_SUPPLY' WHEN k = 8 THEN '' ELSE 'UNCLASSIFIED' END AS "group", CASE WHEN q % 7 = 0 THEN 'candidate_conflict' ELSE 'candidate_consistent' END AS candidate_status, CASE WHEN k >= 4 AND q % 13 <> 0 THEN 'tablet' ELSE '' END AS dosage_form, p_size || 'mg; 10 MG' AS strength, CASE WHEN q % 17 = 0 THEN 'odd' ELSE 'tab' END AS pack_unit FROM wp),
sg AS (SELECT rep_id, CASE WHEN k >= 7 THEN 'UNSPECIFIED_ITEM' ELSE 'DRUG_' || p_type END AS suggested_family, 'name_literal' AS basis, CASE WHEN k BETWEEN 4 AND 6 THEN 'see https://records.example/view?itemSeq=' || q || ' there' ELSE '' END AS note FROM wl WHERE k >= 4),
fr AS (SELECT q AS seq, CASE WHEN q % 3 = 0 THEN 'other name' ELSE upper(name) || ' (note) 30T' END AS official_name, 'https://records.example/' || q AS official_url, CASE WHEN q % 11 = 0 THEN 'X' ELSE 'X;DRUG_' || p_type END AS families, CASE WHEN k = 5 THEN '10mg' ELSE '5mg;10mg;' || p_size || ' mg' END AS strengths FROM wl WHERE k IN (4, 5))"""
CLASSIFIED = """jo AS (SELECT wl.*, coalesce(suggested_family, '') AS sf, coalesce(basis, '') AS basis, CASE WHEN k BETWEEN 4 AND 6 THEN CAST(q AS VARCHAR) ELSE '' END AS seq, official_name, families, strengths FROM wl LEFT JOIN sg USING (rep_id) LEFT JOIN fr ON fr.seq = wl.q AND k BETWEEN 4 AND 6),
ch AS (SELECT *, CASE WHEN family <> '' THEN family WHEN sf = 'UNSPECIFIED_ITEM' THEN '' ELSE sf END AS chosen_family, family = '' AND sf NOT IN ('', 'UNSPECIFIED_ITEM') AND dosage_form <> '' AS drug FROM jo),
cd AS (SELECT *, CASE WHEN drug THEN 'ORAL_TABLET' ELSE subtype END AS chosen_subtype, CASE WHEN drug THEN strength ELSE specification END AS chosen_specification, CASE WHEN drug THEN CASE pack_unit WHEN 'tab' THEN 'TABLET' ELSE '' END ELSE unit END AS chosen_unit FROM ch),
cf AS (SELECT *, candidate_status = 'candidate_conflict' OR "group" = '' AS conflict, chosen_subtype <> '' AND chosen_specification <> '' AND chosen_unit <> '' AS complete, coalesce(official_name <> 'other name', FALSE) AS name_ok, coalesce(contains(families, 'DRUG_'), FALSE) AS family_ok, coalesce(drug AND (k = 4 OR p_size = 10), FALSE) AND official_name IS NOT NULL AS strength_ok FROM cd),
cs AS (SELECT *, CASE WHEN name_ok AND family_ok AND strength_ok AND complete AND NOT conflict AND "group" = 'MED_ORAL' THEN 'approved_item' WHEN chosen_family IN ('SYRINGE', 'WASTE_BOX') AND "group" = 'MED_SUPPLY' AND specification LIKE '%mL' AND NOT candidate_status = 'candidate_conflict' AND complete THEN 'approved_family' WHEN conflict THEN 'conflict'
  WHEN chosen_family = '' AND "group" NOT IN ('', 'UNCLASSIFIED') THEN 'group_only' WHEN chosen_family = '' THEN 'unresolved' WHEN complete THEN 'candidate_complete' ELSE 'candidate_family' END AS state FROM cf)"""
OUT = """SELECT rep_id, state, CASE state WHEN 'approved_item' THEN 'APPROVE_ITEM' WHEN 'approved_family' THEN 'APPROVE_FAMILY' ELSE '' END AS action, CASE state WHEN 'approved_item' THEN 1.0 WHEN 'approved_family' THEN 0.97 ELSE 0.6 END AS confidence,
  CASE state WHEN 'approved_item' THEN 'official_name_family_and_strengths' WHEN 'approved_family' THEN 'family_specification_and_unit_fit_the_rule' WHEN 'conflict' THEN 'group_or_family_conflict' WHEN 'group_only' THEN 'only_the_group_is_known' WHEN 'unresolved' THEN 'family_not_identified'
    ELSE array_to_string(list_filter([CASE WHEN seq = '' THEN 'no_official_record' END, CASE WHEN seq <> '' AND NOT name_ok THEN 'name_differs' END, CASE WHEN seq <> '' AND NOT family_ok THEN 'family_not_verified' END, CASE WHEN seq <> '' AND NOT strength_ok THEN 'strength_not_verified' END, CASE WHEN NOT complete THEN 'details_missing' END], lambda x: x IS NOT NULL), ';') END AS reason,
  chosen_family, chosen_subtype, chosen_specification, chosen_unit, CASE WHEN family <> '' THEN 'local_rule' ELSE 'suggestion:' || basis END AS classification_basis, CASE state WHEN 'approved_item' THEN seq WHEN 'approved_family' THEN 'EV-1::' || chosen_family ELSE '' END AS evidence_record FROM cs"""


def made(spark, sf, name, extra=""):
    quoted = WORK.replace('"group"', "`group`") + extra
    return spark.sql(f"WITH {quoted} SELECT * FROM {name}", part=b.table(spark, sf, "part"))


@query("cls_representatives", "WITH " + WORK.replace("{part}", "part") + f", {CLASSIFIED} {OUT}")
def cls_representatives(spark, sf):
    rules = spark.createDataFrame([("SYRINGE", "MED_SUPPLY", r"^\d+(\.\d+)?mL$", "EV-1"), ("WASTE_BOX", "MED_SUPPLY", r"^\d+(\.\d+)?mL$", "EV-1")], "rule_family string, rule_group string, pattern string, evidence_id string")
    return op.classified(made(spark, sf, "wl").drop("k", "q", "p_type", "p_size"), made(spark, sf, "sg"), made(spark, sf, "fr"), rules)


# Rules are rows: level, field, value, codes, basis, confidence, blocks, promotes.
RULES = [
    (1, "family", "Brand#1", "ROCK_SALT", "family_override", 0.99, False, False), (2, "family", "Brand#2", "", "sentinel", 0.0, True, False), (3, "cluster", "PROMO", "PHARMA_API;PAPER", "cluster_default", 0.9, False, False), (3, "cluster", "SMALL", "LATEX", "cluster_default", 0.9, False, False),
    (3, "cluster", "LARGE", "PHARMA_API;{family};GLASS", "cluster_default", 0.9, False, False), (4, "family", "*", "{family}", "family_as_ingredient", 0.6, False, False), (5, "area", "*", "GROUP_{area}", "group_fallback", 0.3, False, False),
    (1, "family", "Brand#7", "", "skip", 0.0, True, True), (2, "family", "Brand#9", "SPECIAL;EXTRA", "override", 0.9, False, True), (3, "family", "*", "{family}", "default", 0.5, False, True),
]
RULE_TYPES = "level int, field string, value string, codes string, basis string, confidence double, blocks boolean, promotes boolean"
CODE_ROWS = "cr AS (SELECT CAST(p_partkey AS BIGINT) AS rep_id, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 6 = 1 THEN ' ' ELSE p_brand END AS family, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE p_type END AS cluster, CASE WHEN p_partkey % 5 = 4 THEN '' ELSE 'A' || CAST(p_partkey % 3 AS INTEGER) END AS area FROM {part})"


@query("mat_rule_table_codes", "WITH " + CODE_ROWS.replace("{part}", "part") + """, x AS (SELECT *, trim(coalesce(family, '')) AS f FROM cr),
y AS (SELECT *, CASE WHEN f = 'Brand#1' THEN 'family_override' WHEN f = 'Brand#2' THEN 'blocked' WHEN cluster IN ('PROMO', 'SMALL', 'LARGE') THEN 'cluster_default' WHEN f <> '' THEN 'family_as_ingredient' WHEN area <> '' THEN 'group_fallback' ELSE 'unmapped' END AS mapping_basis FROM x),
z AS (SELECT *, f NOT IN ('', 'Brand#7') AND cluster IN ('PROMO', 'LARGE') AND mapping_basis = 'cluster_default' AS promoted, CASE f WHEN 'Brand#9' THEN 'SPECIAL;EXTRA' ELSE f END AS special FROM y)
SELECT rep_id, family, cluster, area, CASE mapping_basis WHEN 'family_override' THEN 'ROCK_SALT' WHEN 'cluster_default' THEN CASE cluster WHEN 'SMALL' THEN 'LATEX' WHEN 'PROMO' THEN CASE WHEN promoted THEN special ELSE 'PHARMA_API' END || ';PAPER' ELSE CASE WHEN promoted AND f <> 'Brand#9' THEN f WHEN promoted THEN special || ';' || f WHEN f <> '' THEN 'PHARMA_API;' || f ELSE 'PHARMA_API' END || ';GLASS' END
  WHEN 'family_as_ingredient' THEN f WHEN 'group_fallback' THEN 'GROUP_' || area ELSE '' END AS material_codes, mapping_basis, CASE mapping_basis WHEN 'family_override' THEN 1 WHEN 'cluster_default' THEN 3 WHEN 'family_as_ingredient' THEN 4 WHEN 'group_fallback' THEN 5 END AS mapping_level,
  CASE mapping_basis WHEN 'family_override' THEN 0.99 WHEN 'cluster_default' THEN 0.9 WHEN 'family_as_ingredient' THEN 0.6 WHEN 'group_fallback' THEN 0.3 ELSE 0.0 END AS mapping_confidence, promoted FROM z""")
def mat_rules(spark, sf):
    rows = spark.sql(f"WITH {CODE_ROWS} SELECT * FROM cr", part=b.table(spark, sf, "part"))
    return op.resolved_codes(rows, "rep_id", ["family", "cluster", "area"], spark.createDataFrame(RULES, RULE_TYPES), ["PHARMA_API"])


GATED = """tx AS (SELECT DISTINCT p_brand AS family, p_type AS subtype, CASE WHEN p_brand = 'Brand#3' AND p_partkey % 2 = 0 THEN 'G_OTHER' ELSE 'G_' || p_type END AS "group" FROM {part} WHERE p_brand <> 'Brand#4'),
st AS (SELECT CAST(p_partkey AS BIGINT) AS l_partkey, p_brand AS family, p_type AS subtype FROM {part} WHERE p_partkey % 4 = 0),
bu AS (SELECT CAST(p_partkey AS BIGINT) AS l_partkey, CASE WHEN p_partkey % 8 = 0 THEN 'Brand#4' ELSE p_brand END AS family, p_type AS subtype FROM {part} WHERE p_partkey % 9 <> 5 UNION ALL SELECT CAST(p_partkey AS BIGINT), 'Brand#6', p_type FROM {part} WHERE p_partkey % 25 = 3)"""
GATED_SQL = GATED.replace("{part}", "part") + """, s1 AS (SELECT *, 0 AS s FROM st UNION ALL SELECT *, 1 FROM bu), e AS (SELECT l_partkey, s, min((family, subtype)) AS v, max((family, subtype)) AS w FROM s1 GROUP BY 1, 2),
m AS (SELECT l_partkey, bool_or(v <> w) AS twice, arg_min(v, s) AS x, min(s) = 0 AS is_strict FROM e GROUP BY 1), g AS (SELECT family, subtype, count(DISTINCT "group") AS n, min("group") AS "group" FROM tx GROUP BY 1, 2),
h AS (SELECT l_partkey, x[1] AS family, x[2] AS subtype, is_strict, twice, coalesce(n, 0) AS n, "group" FROM m LEFT JOIN g ON g.family = x[1] AND g.subtype = x[2]), ok AS (SELECT * FROM h WHERE NOT twice AND n = 1)"""


def gated(spark, sf):
    one = lambda name: spark.sql(f"WITH {GATED.replace(chr(34) + 'group' + chr(34), '`group`')} SELECT * FROM {name}", part=b.table(spark, sf, "part"))
    return op.reconciled(one("st"), one("bu"), "l_partkey", ["family", "subtype"], one("tx"), b.table(spark, sf, "lineitem").select("l_partkey"), strict=False)


@query("cls_gated_mapping", f"WITH {GATED_SQL} SELECT l_orderkey, l_linenumber, l_partkey, family, subtype, \"group\", is_strict FROM lineitem JOIN ok USING (l_partkey)")
def cls_gated(spark, sf):
    mapping, _ = gated(spark, sf)
    return op.attached(b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), mapping, "l_partkey")


@query("cls_gated_failures", f"WITH {GATED_SQL}, bad AS (SELECT CASE WHEN twice THEN 'doubled_key' WHEN n = 0 THEN 'unknown_taxonomy' ELSE 'ambiguous_taxonomy' END AS kind, CAST(l_partkey AS VARCHAR) AS k FROM h WHERE twice OR n <> 1 UNION ALL SELECT DISTINCT 'unmatched_fact', CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM ok)) SELECT kind, count(*) AS n, array_to_string(list_sort(list(k))[1:3], ';') AS examples FROM bad GROUP BY 1")
def cls_failures(spark, sf):
    return gated(spark, sf)[1]
