"""Queries on supply policy, ingredients and exposure candidates. Both engines make the inputs by the same expressions."""

from __future__ import annotations

from provisio.operators import exposure as op
from provisio.plans import bindings as b
from provisio.registry import query

# Representatives are brand and name, local items the pairs of part and supplier. Some keys are blank, null, repeated or ambiguous.
WORK = """pa AS (SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_brand || '/' || p_name AS rep, p_type FROM {part}),
li AS (SELECT DISTINCT CAST(l_partkey AS BIGINT) AS l_partkey, CAST(l_suppkey AS BIGINT) AS l_suppkey FROM {lineitem}),
lp AS (SELECT l_partkey || '-' || l_suppkey AS local_item_key, l_partkey + l_suppkey AS k, l_suppkey, rep, p_type FROM li JOIN pa ON l_partkey = p_partkey),
cl AS (SELECT local_item_key, p_type AS item_family_id, CASE l_suppkey % 5 WHEN 0 THEN ' Approved ' WHEN 1 THEN 'pending' WHEN 2 THEN NULL ELSE 'approved' END AS review_status FROM lp),
al AS (SELECT local_item_key, CASE WHEN k % 13 <> 5 THEN rep END AS representative_item_id FROM lp UNION ALL SELECT local_item_key, 'another' FROM lp WHERE k % 11 = 3 UNION ALL SELECT local_item_key, rep FROM lp WHERE k % 11 = 4),
rq AS (SELECT rep AS representative_item_id, min(p_partkey) AS q, min(p_type) AS t FROM pa GROUP BY rep),
it AS (SELECT representative_item_id, CASE q % 3 WHEN 0 THEN t WHEN 1 THEN ' ' END AS selected_family_id, CASE q % 6 WHEN 0 THEN 'LATEX; STEEL;LATEX;' WHEN 1 THEN 'PAPER' WHEN 2 THEN '' WHEN 3 THEN 'STEEL;GLASS' WHEN 4 THEN 'LATEX' END AS raw_material_meta_codes, CASE WHEN q % 4 = 0 THEN 'APPROVED' WHEN q % 4 = 1 THEN 'needs_review' END AS material_review_status,
  'name_rule' AS material_confidence, 'tier_3' AS material_evidence_tier, CASE WHEN q % 2 = 0 THEN 'rule' END AS raw_material_evidence, CASE q % 8 WHEN 0 THEN 'OIL; PORT' WHEN 1 THEN 'FLU;STRIKE' WHEN 2 THEN 'CRUDE' WHEN 3 THEN 'PORT;ODD' WHEN 4 THEN 'ODD;OLD' WHEN 5 THEN ' ; ' WHEN 6 THEN 'PORT' END AS supply_codes,
  CASE WHEN q % 9 < 2 THEN 'yes' ELSE 'no' END AS shortage, CASE WHEN q % 9 = 0 THEN 'TRUE' END AS single_source, CASE WHEN q % 18 < 9 THEN 'approved' ELSE 'pending' END AS override_status, CASE q % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'WATCH' WHEN 3 THEN ' ' END AS stored_level FROM rq),
ev AS (SELECT representative_item_id, 'STEEL' AS raw_material_meta_code, 'registry' AS evidence_source, ' ' AS evidence_field, 'https://records.example/' || q AS evidence_url, CASE WHEN q % 5 = 1 THEN 'pending' ELSE 'approved' END AS identity_review_status, 'Approved' AS material_review_status FROM rq WHERE q % 2 = 1),
fa AS (SELECT CASE CAST(s_suppkey % 4 AS INTEGER) WHEN 0 THEN 'LATEX' WHEN 1 THEN 'STEEL' WHEN 2 THEN 'PAPER' ELSE 'NONE' END AS raw_material_meta_code, CASE WHEN s_suppkey % 4 = 2 THEN ' ' ELSE 'F' || CAST(s_nationkey AS INTEGER) END AS market_factor_id FROM {supplier})"""
LEVELS = [("NORMAL", 1.25, 1.0), ("WATCH", 1.5, 1.125), ("WARNING", 1.75, 1.25), ("CRITICAL", 2.25, 1.5)]
RULES = [("OIL", "OIL", "supply", "WARNING"), ("CRUDE", "OIL", "supply", "WARNING"), ("PORT", "PORT", "supply", "WATCH"), ("FLU", "FLU", "demand", "CRITICAL"), ("STRIKE", None, "event", None)]
RULE_TYPES = "code string, canonical string, axis string, level string"
POLICY = """ru(code, canonical, axis, r) AS (VALUES ('OIL', 'OIL', 'supply', 2), ('CRUDE', 'OIL', 'supply', 2), ('PORT', 'PORT', 'supply', 1), ('FLU', 'FLU', 'demand', 3), ('STRIKE', NULL, 'event', NULL)),
lv(r, supply_level, supply_z, lead_time_multiplier) AS (VALUES (0, 'NORMAL', 1.25::DOUBLE, 1.0::DOUBLE), (1, 'WATCH', 1.5, 1.125), (2, 'WARNING', 1.75, 1.25), (3, 'CRITICAL', 2.25, 1.5)),
lg AS (SELECT DISTINCT representative_item_id, trim(c) AS code FROM (SELECT representative_item_id, unnest(string_split(supply_codes, ';')) AS c FROM it) WHERE trim(c) <> ''),
ag AS (SELECT representative_item_id, count(*) AS n, count(axis) AS known, count(*) FILTER (axis = 'supply') AS sup, max(r) FILTER (axis = 'supply') AS r, string_agg(DISTINCT canonical, ';' ORDER BY canonical) AS cc, string_agg(DISTINCT code, ';' ORDER BY code) FILTER (axis <> 'supply') AS ic, string_agg(DISTINCT code, ';' ORDER BY code) FILTER (axis IS NULL) AS uc FROM lg LEFT JOIN ru USING (code) GROUP BY 1),
po AS (SELECT it.*, lv.supply_level, supply_z, lead_time_multiplier, CASE WHEN crit THEN 'approved_critical_override' WHEN n IS NULL THEN 'default_missing_code' WHEN known = 0 THEN 'default_unmapped_code' WHEN ic IS NOT NULL AND sup = 0 THEN 'non_supply_axis_only' ELSE 'meta_code' END AS level_source,
  coalesce(cc, '') AS canonical_codes, coalesce(ic, '') AS ignored_codes, coalesce(uc, '') AS unmapped_codes, n IS NULL OR uc IS NOT NULL AS policy_needs_review, coalesce(CASE upper(trim(stored_level)) WHEN 'LOW' THEN 'NORMAL' WHEN 'HIGH' THEN 'WARNING' ELSE upper(trim(stored_level)) END NOT IN ('', lv.supply_level), FALSE) AS level_mismatch
  FROM (SELECT *, shortage = 'yes' AND coalesce(single_source = 'TRUE', FALSE) AND override_status = 'approved' AS crit FROM it) it LEFT JOIN ag USING (representative_item_id) JOIN lv ON lv.r = CASE WHEN crit THEN 3 ELSE coalesce(ag.r, 0) END)"""
FOUND = """ok AS (SELECT local_item_key, item_family_id FROM cl WHERE lower(trim(review_status)) = 'approved'), ra AS (SELECT local_item_key, min(representative_item_id) AS representative_item_id FROM al GROUP BY 1 HAVING count(DISTINCT representative_item_id) = 1),
cs AS (SELECT representative_item_id, raw_material_meta_code, concat_ws(' | ', nullif(trim(evidence_source), ''), nullif(trim(evidence_field), ''), nullif(trim(evidence_url), '')) AS ref FROM ev WHERE identity_review_status = 'approved'), fs AS (SELECT raw_material_meta_code, string_agg(DISTINCT market_factor_id, ';' ORDER BY market_factor_id) AS fids, count(DISTINCT market_factor_id) AS fn FROM fa WHERE trim(market_factor_id) <> '' GROUP BY 1),
ml AS (SELECT DISTINCT * FROM (SELECT * EXCLUDE (raw_material_meta_codes, crit), trim(unnest(string_split(raw_material_meta_codes, ';'))) AS raw_material_meta_code FROM po) WHERE raw_material_meta_code <> ''),
fo AS (SELECT local_item_key, representative_item_id, item_family_id, selected_family_id, raw_material_meta_code, CASE WHEN ref IS NULL THEN material_review_status ELSE 'approved' END AS material_review_status, CASE WHEN ref IS NULL THEN material_confidence ELSE 'verified' END AS material_confidence, CASE WHEN ref IS NULL THEN material_evidence_tier ELSE 'official_product_material' END AS material_evidence_tier,
  coalesce(ref, raw_material_evidence, '') AS material_evidence_reference, ref IS NOT NULL AS official_claim, coalesce(fids, '') AS market_factor_ids, coalesce(fn, 0) AS market_factor_count, supply_level, supply_z, lead_time_multiplier, level_source, canonical_codes, ignored_codes, unmapped_codes, policy_needs_review, coalesce(trim(selected_family_id) <> '' AND selected_family_id <> item_family_id, FALSE) AS family_conflict
  FROM ok JOIN ra USING (local_item_key) JOIN ml USING (representative_item_id) LEFT JOIN cs USING (representative_item_id, raw_material_meta_code) LEFT JOIN fs USING (raw_material_meta_code)),
fx AS (SELECT *, coalesce(lower(material_review_status) = 'approved', FALSE) AND NOT family_conflict AND market_factor_count > 0 AS operational_risk_eligible, CASE WHEN policy_needs_review THEN 'blocked_supply_policy_review' WHEN family_conflict THEN 'blocked_family_conflict' WHEN market_factor_count > 0 THEN 'high' ELSE 'normal' END AS review_priority FROM fo)"""


def sql(*more: str) -> str:
    return "WITH " + ", ".join([WORK.format(part="part", lineitem="lineitem", supplier="supplier"), *more[:-1]]) + " " + more[-1]


def made(spark, sf, name):
    return spark.sql(f"WITH {WORK} SELECT * FROM {name}", **{t: b.table(spark, sf, t) for t in ("part", "lineitem", "supplier")})


def items(spark, sf):
    return op.supply_policy(made(spark, sf, "it"), "supply_codes", spark.createDataFrame(RULES, RULE_TYPES), LEVELS, ["shortage", "single_source"], "override_status", "stored_level")


def found(spark, sf):
    return op.candidates(made(spark, sf, "cl"), made(spark, sf, "al"), items(spark, sf), made(spark, sf, "ev"), made(spark, sf, "fa"))


@query("rsk_supply_policy", sql(POLICY, "SELECT * EXCLUDE (crit) FROM po"))
def supply_policy(spark, sf):
    return items(spark, sf)


@query("mat_exposed_materials", sql(POLICY, FOUND, "SELECT * FROM fx"))
def exposed(spark, sf):
    return found(spark, sf)


@query("mat_exposure_report", sql(POLICY, FOUND, """SELECT (SELECT count(*) FROM ok) AS approved_classifications, count(*) AS candidate_count, count(DISTINCT local_item_key) AS candidate_items, count(*) FILTER (official_claim) AS official_claims, count(*) FILTER (market_factor_count > 0) AS factor_covered,
  count(*) FILTER (lower(material_review_status) = 'approved') AS approved_materials, count(*) FILTER (family_conflict) AS family_conflicts, count(*) FILTER (policy_needs_review) AS policy_reviews, count(DISTINCT local_item_key) FILTER (policy_needs_review) AS policy_review_items, count(*) FILTER (unmapped_codes <> '') AS unmapped,
  count(DISTINCT local_item_key) FILTER (unmapped_codes <> '') AS unmapped_items, count(*) FILTER (operational_risk_eligible) AS eligible, CASE WHEN count(*) FILTER (operational_risk_eligible) = 0 THEN 'material_candidates_require_review' ELSE '' END AS blocked_reason FROM fx"""))  # fmt: skip
def report(spark, sf):
    return op.candidate_report(made(spark, sf, "cl"), found(spark, sf))


DRUGS = """dr AS (SELECT CAST(p_partkey AS BIGINT) AS drug_code, CASE CAST(p_partkey % 10 AS INTEGER) WHEN 3 THEN '' WHEN 4 THEN NULL ELSE p_name END AS ingredient_code, CASE WHEN p_partkey % 7 = 5 THEN NULL ELSE p_partkey % 7 = 0 END AS several, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN '' END AS usage_division, CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS drug_kind FROM {part}),
gr AS (SELECT CAST(p_partkey AS BIGINT) AS drug_code, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'G' || p_size END AS item_group FROM {part} WHERE p_partkey % 8 <> 7)"""


@query("mat_fallback_groups", "WITH " + DRUGS.format(part="part") + """, sz AS (SELECT ingredient_code, count(*) AS n FROM dr WHERE several = FALSE AND ingredient_code <> '' GROUP BY 1), x AS (SELECT dr.*, item_group, coalesce(n >= 3 AND several = FALSE, FALSE) AS one, coalesce(usage_division, '') AS u, coalesce(drug_kind, '') AS k FROM dr LEFT JOIN sz USING (ingredient_code) LEFT JOIN gr USING (drug_code))
SELECT drug_code, ingredient_code, usage_division, drug_kind, CASE WHEN one THEN 1 WHEN u <> '' OR k <> '' THEN 2 WHEN coalesce(item_group, '') <> '' THEN 3 ELSE 0 END AS tier, CASE WHEN one THEN 'ING:' || ingredient_code WHEN u <> '' OR k <> '' THEN 'USE:' || u || '/' || k WHEN coalesce(item_group, '') <> '' THEN 'GRP:' || item_group ELSE 'UNASSIGNED' END AS group_id FROM x""")  # fmt: skip
def fallback_groups(spark, sf):
    rows = {n: spark.sql(f"WITH {DRUGS} SELECT * FROM {n}", part=b.table(spark, sf, "part")) for n in ("dr", "gr")}
    return op.fallback_groups(rows["dr"], rows["gr"], 3).drop("several")


ATTACH = """ai AS (SELECT CAST(p_partkey AS BIGINT) AS representative_item_id, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS ingredient_ids, p_name AS ingredient_names FROM {part}),
en AS (SELECT CAST(p_partkey AS BIGINT) AS representative_item_id, CASE WHEN p_partkey % 6 = 0 THEN ' ' ELSE ' A_' || p_size END AS ingredient_code, p_brand AS ingredient_name, CASE WHEN p_partkey % 4 = 0 THEN 'pending' ELSE 'Approved' END AS review_status FROM {part} WHERE p_partkey % 5 <> 1)"""


@query("mat_attached_ingredients", "WITH " + ATTACH.format(part="part") + """, x AS (SELECT ai.*, trim(ingredient_code) AS c, ingredient_name FROM ai LEFT JOIN en ON en.representative_item_id = ai.representative_item_id AND review_status = 'Approved' AND trim(ingredient_code) <> '')
SELECT representative_item_id, coalesce(c, ingredient_ids) AS ingredient_ids, CASE WHEN c IS NULL THEN ingredient_names ELSE ingredient_name END AS ingredient_names, CASE WHEN c IS NULL THEN '' ELSE 'approved_ingredient_dataset' END AS ingredient_source, CASE WHEN c IS NULL THEN '' ELSE 'verified_ingredient_ready' END AS material_match_readiness FROM x""")  # fmt: skip
def attached(spark, sf):
    rows = {n: spark.sql(f"WITH {ATTACH} SELECT * FROM {n}", part=b.table(spark, sf, "part")) for n in ("ai", "en")}
    return op.attached_ingredients(rows["ai"], rows["en"])


NAMED = "nm AS (SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CASE WHEN p_partkey % 10 = 9 THEN NULL ELSE upper(p_name) END AS name, CASE p_type WHEN 'STANDARD' THEN NULL ELSE p_type END AS material_code, CASE WHEN p_partkey % 11 < 2 THEN p_partkey % 11 = 0 END AS has_ingredient FROM {part})"


@query("mat_medical_steps", "WITH " + NAMED.format(part="part") + """, x AS (SELECT *, CASE WHEN has_ingredient THEN 'ingredient' WHEN material_code = 'PROMO' THEN 'hard_code' WHEN material_code = 'SMALL' AND NOT regexp_matches(coalesce(name, ''), 'GEAR|BOLT') THEN 'guard_without_word'
  WHEN (material_code IS NULL OR material_code = 'LARGE') AND regexp_matches(coalesce(name, ''), 'RING|PLATE|WIDGET') AND NOT regexp_matches(name, 'GEAR|BOLT') THEN 'promotional_word' ELSE 'default' END AS medical_step FROM nm) SELECT p_partkey, name, material_code, medical_step, medical_step IN ('ingredient', 'default') AS is_medical FROM x""")  # fmt: skip
def medical_steps(spark, sf):
    rows = spark.sql(f"WITH {NAMED} SELECT * FROM nm", part=b.table(spark, sf, "part"))
    classes = spark.createDataFrame([("PROMO", "hard"), ("SMALL", "guard"), ("LARGE", "open")], "code string, kind string")
    return op.medical(rows, classes, "gear|bolt", "ring|plate|widget").drop("has_ingredient")
