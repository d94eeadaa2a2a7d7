"""Queries on name rules, attributes, dictionaries and mapping contracts, over part names with made endings."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio.operators import catalog as op
from provisio.plans import bindings as b
from provisio.registry import query

ENDINGS = [
    "", " #mL", " (rental) frame", " [promo] gift", " waste bag 20L", " waste cardboard box", " waste rigid drum 40L", " waste bag and cardboard box", " tablet #mg", " capsule #mg", " injection #mg/@mL", " cream 0.#%", " syrup @mL", " gauze #x@cm",
    " gauze #×@ cm sterile", " needle #G adult", " needle #G child", " needle @G", " container <=#L", " container >1,000mL", " syringe 3mL 23G #mg", " (Aspirin 100mg)", " (Vitamin C) #mg tablet", " fuel diesel", " x10ea", " 10x10cm 5mg 25G", " Acme Co., Ltd. #mg", " Beta Inc 12ea",
]


def named(spark, sf):
    """Distinct names with their code and status."""
    ending = F.element_at(F.array(*(F.lit(e) for e in ENDINGS)), (F.col("p_partkey") % len(ENDINGS) + 1).cast("int"))
    text = F.replace(F.replace(ending, F.lit("#"), F.col("p_size").cast("string")), F.lit("@"), (F.col("p_size") + 5).cast("string"))
    status = F.when(F.col("p_partkey") % 7 == 0, "draft").otherwise("Approved")
    return b.table(spark, sf, "part").select("p_partkey", F.concat("p_name", text).alias("name"), "p_name", "p_type", "p_brand", "p_size", status.alias("status"))


NAMED = f"""nm AS (SELECT p_partkey, p_name || replace(replace(([{', '.join(f"'{e}'" for e in ENDINGS)}])[p_partkey % {len(ENDINGS)} + 1], '#', CAST(p_size AS VARCHAR)), '@', CAST(p_size + 5 AS VARCHAR)) AS name, p_name, p_type, p_brand, p_size, CASE WHEN p_partkey % 7 = 0 THEN 'draft' ELSE 'Approved' END AS status FROM part)"""
GROUP_SQL = f"""oc AS (SELECT *, {op.rules_sql('name', op.OPERATIONAL, 'none')} AS operational_class, {op.rules_sql('name', op.GROUPS, 'OTHER')} AS g0 FROM nm),
og AS (SELECT *, CASE operational_class WHEN 'promo' THEN 'NON_MEDICAL' WHEN 'rental' THEN 'ASSET' ELSE g0 END AS item_group FROM oc)"""
FORM_SQL = f"""fm AS (SELECT *, CASE item_group {' '.join(f"WHEN '{g}' THEN {op.rules_sql('name', r, '')}" for g, r in op.FORMS.items())} ELSE '' END AS dosage_form,
  CASE WHEN regexp_matches(name, '(?i)waste') AND {' + '.join(f"CAST(regexp_matches(name, '(?i){p}') AS INTEGER)" for p, _ in op.WASTE)} = 1 THEN 'WASTE_' || {op.rules_sql('name', op.WASTE, '')} ELSE '' END AS waste_subtype FROM og)"""


@query("itm_operational_class", f"WITH {NAMED}, {GROUP_SQL} SELECT p_partkey, name, operational_class, item_group FROM og")
def itm_operational(spark, sf):
    return op.operational(named(spark, sf), "name").select("p_partkey", "name", "operational_class", "item_group")


def formed(spark, sf):
    return op.dosage_form(op.operational(named(spark, sf), "name"), "name", "item_group")


@query("itm_dosage_form_subtype", f"WITH {NAMED}, {GROUP_SQL}, {FORM_SQL} SELECT p_partkey, name, dosage_form, waste_subtype FROM fm")
def itm_form(spark, sf):
    return formed(spark, sf).select("p_partkey", "name", "dosage_form", "waste_subtype")


@query("itm_material_from_subtype", f"""WITH {NAMED}, {GROUP_SQL}, {FORM_SQL} SELECT p_partkey, waste_subtype, CASE waste_subtype {' '.join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in op.MATERIALS.items())} ELSE '' END AS material, CASE waste_subtype {' '.join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in op.MATERIALS.items())} ELSE '' END AS evidence FROM fm""")
def itm_material(spark, sf):
    return op.material_of(formed(spark, sf), "waste_subtype").select("p_partkey", "waste_subtype", "material", "evidence")


T = r"regexp_replace(lower(name), '(\d),(\d{3})', '\1\2', 'g')"


@query("itm_family_specification", rf"""WITH {NAMED}, f AS (SELECT DISTINCT name, {op.rules_sql('name', op.FAMILIES, 'OTHER')} AS family, {T} AS t FROM nm),
x AS (SELECT *, regexp_extract(t, '(\d+(\.\d+)?)\s*(m?l)\b', 1) AS v, regexp_extract(t, '(\d+(\.\d+)?)\s*(m?l)\b', 3) AS u, regexp_extract(t, '(<=|>)\s*\d', 1) AS s, regexp_extract(t, '(\d+)\s*[x×]\s*(\d+)', 1) AS w, regexp_extract(t, '(\d+)\s*[x×]\s*(\d+)', 2) AS h, regexp_extract(t, '\b(\d+)\s*g\b', 1) AS g FROM f)
SELECT name, family, CASE WHEN family = 'CONTAINER' AND v <> '' THEN CASE s WHEN '<=' THEN 'LE_' WHEN '>' THEN 'GT_' ELSE '' END || v || upper(u) WHEN family = 'GAUZE' AND w <> '' THEN w || 'X' || h
  WHEN family IN ('NEEDLE', 'SYRINGE') AND g <> '' THEN g || 'G' || CASE WHEN contains(t, 'adult') THEN '_ADULT' WHEN contains(t, 'child') THEN '_CHILD' ELSE '' END ELSE '' END AS specification,
  array_to_string(regexp_extract_all(regexp_replace(name, '(?i)\b\d+\s*G\b', ' ', 'g'), '(?i)(\d+(?:\.\d+)?\s*(?:mg|mcg|iu|%))', 1), ';') AS strengths FROM x""")
def itm_family_spec(spark, sf):
    rows = named(spark, sf).select("name").distinct().withColumn("family", op.first_rule(F.col("name"), op.FAMILIES, "OTHER"))
    return op.family_specification(rows, "name", "family").select("name", "family", "specification", "strengths")


def _attribute_sql() -> str:
    steps = ["a0 AS (SELECT DISTINCT name, name AS rest FROM nm)"]
    for k, (a, p) in enumerate(op.ATTRIBUTES):
        steps.append(f"a{k + 1} AS (SELECT * EXCLUDE rest, trim(regexp_extract(rest, '(?i){p}', 0)) AS {a}, regexp_replace(rest, '(?i){p}', ' ', 'g') AS rest FROM a{k})")
    n = " + ".join(f"CAST({a} <> '' AS INTEGER)" for a, _ in op.ATTRIBUTES)
    steps.append(f"az AS (SELECT * EXCLUDE rest, trim(regexp_replace(rest, '\\s+', ' ', 'g')) AS leftover, {n} AS attribute_count FROM a{len(op.ATTRIBUTES)})")
    return ", ".join(steps)


@query("itm_name_attributes", f"WITH {NAMED}, {_attribute_sql()} SELECT *, CASE WHEN leftover = '' THEN 'NO_NAME' WHEN attribute_count = 0 THEN 'NAME_ONLY' WHEN attribute_count >= 2 THEN 'READY' ELSE 'PARTIAL' END AS readiness FROM az")
def itm_attributes(spark, sf):
    return op.attributes(named(spark, sf).select("name").distinct(), "name")


@query("itm_official_rules", f"""WITH {NAMED}, c AS (SELECT *, 'X' || p_partkey || ';' || CASE WHEN p_partkey % 3 = 0 THEN 'KD' ELSE 'ZZ' END || p_size || ';KN9' AS codes FROM nm)
SELECT p_partkey, {op.rules_sql('name', op.OFFICIAL, '')} AS standard_item, CASE {' '.join(f"WHEN contains(lower(name), '{k}') THEN '{v}'" for k, v in op.SUFFIXES.items())} ELSE '' END AS dosage_suffix,
  coalesce(list_filter(string_split(codes, ';'), lambda x: starts_with(x, 'KD') OR starts_with(x, 'KN'))[1], '') AS national_code, trim(regexp_extract(name, '\\(([^()]*)\\)', 1)) AS literal_ingredient FROM c""")
def itm_official(spark, sf):
    codes = F.concat_ws(";", F.concat(F.lit("X"), F.col("p_partkey").cast("string")), F.concat(F.when(F.col("p_partkey") % 3 == 0, "KD").otherwise("ZZ"), F.col("p_size").cast("string")), F.lit("KN9"))
    return op.official(named(spark, sf).withColumn("codes", codes), "name", "codes", ["KD", "KN"]).select("p_partkey", "standard_item", "dosage_suffix", "national_code", "literal_ingredient")


BASE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({}), '\([^()]*\)', ' ', 'g'), '\b(co\.,?\s*ltd\.?|inc\.?|corp\.?)', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("itm_attribute_dictionary", f"WITH {NAMED}, d AS (SELECT {BASE.format('name')} AS alias, p_brand AS ident FROM nm WHERE lower(status) = 'approved') SELECT alias, min(ident) AS ident, count(*) AS rows FROM d WHERE alias <> '' GROUP BY 1 HAVING min(ident) = max(ident)")
def itm_dictionary(spark, sf):
    return op.dictionary(named(spark, sf), "name", "p_brand", "status")


INGREDIENT = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' (' || p_size || 'mg)' WHEN 1 THEN replace(p_name, 'a', 'á') || ' (salt)' WHEN 2 THEN p_size || '-' || p_name ELSE p_name END"


@query("mat_ingredient_names", rf"""WITH n AS (SELECT DISTINCT {INGREDIENT} AS name FROM part), x AS (SELECT name, trim(regexp_replace(name, '\s*\([^()]*\)\s*$', '')) AS ingredient, regexp_extract(name, '\(([^()]*[0-9][^()]*)\)\s*$', 1) AS strength FROM n),
c AS (SELECT *, regexp_replace(upper(regexp_replace(strip_accents(ingredient), '[^A-Za-z0-9]+', '_', 'g')), '^_+|_+$', '', 'g') AS code FROM x) SELECT name, ingredient, strength, CASE WHEN regexp_matches(code, '^[0-9]') THEN 'N_' || code ELSE code END AS meta_code FROM c""")
def mat_names(spark, sf):
    return op.ingredient(b.table(spark, sf, "part").select(F.expr(INGREDIENT).alias("name")).distinct(), "name")


MAPPING = """mp AS (SELECT p_brand || '::' || p_type || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '::' || p_size END AS stock_item_key, split_part(p_name, ' ', 1) AS material, CASE WHEN p_partkey % 4 = 0 THEN 'draft' ELSE ' Approved' END AS review_status,
  CASE p_partkey % 6 WHEN 0 THEN 'made_of' WHEN 1 THEN 'packed_in' WHEN 2 THEN 'rumour' ELSE 'made_of' END AS relation, p_size / 45.0 AS weight, (p_partkey % 11) / 10.0 AS confidence, p_partkey FROM part)"""


def mapping(spark, sf):
    return spark.sql(f"WITH {MAPPING.replace('FROM part)', 'FROM {part})')} SELECT * FROM mp".replace("p_size / 45.0", "cast(p_size / 45.0D as double)").replace("/ 10.0", "/ 10.0D"), part=b.table(spark, sf, "part"))


KEY_SHAPE = "size(split(stock_item_key, '::')) < 3"


@query("mat_approved_mapping", f"""WITH {MAPPING}, a AS (SELECT *, count(*) OVER (PARTITION BY stock_item_key, material) AS n FROM mp WHERE lower(trim(review_status)) = 'approved') SELECT p_partkey, stock_item_key, material FROM a WHERE n = 1 AND relation IN ('made_of', 'packed_in') AND len(string_split(stock_item_key, '::')) >= 3 AND weight > 0 AND weight <= 1 AND confidence BETWEEN 0 AND 1""")
def mat_load(spark, sf):
    rules = [(~F.col("relation").isin("made_of", "packed_in"), "relation"), (F.expr(KEY_SHAPE), "key_shape"), *op.weight_rules(weight=(0.0, 1.0, False), confidence=(0.0, 1.0, True))]
    return op.approved_load(mapping(spark, sf), "review_status", ["stock_item_key", "material"], rules, strict=False).select("p_partkey", "stock_item_key", "material")


@query("mat_mapping_problems", f"""WITH {MAPPING}, a AS (SELECT *, count(*) OVER (PARTITION BY stock_item_key, material) AS n FROM mp), p AS (SELECT p_partkey, concat_ws(';', CASE WHEN relation NOT IN ('made_of', 'packed_in') THEN 'relation' END, CASE WHEN len(string_split(stock_item_key, '::')) < 3 THEN 'key_shape' END, CASE WHEN NOT (weight > 0 AND weight <= 1) THEN 'weight_range' END, CASE WHEN n > 1 THEN 'duplicate_key' END) AS problems FROM a) SELECT problems, count(*) AS rows FROM p GROUP BY 1""")
def mat_problems(spark, sf):
    rules = [(~F.col("relation").isin("made_of", "packed_in"), "relation"), (F.expr(KEY_SHAPE), "key_shape"), *op.weight_rules(weight=(0.0, 1.0, False))]
    return op.checked(mapping(spark, sf), ["stock_item_key", "material"], rules).groupBy("problems").agg(F.count("*").alias("rows"))


@query("com_factor_mapping_load", """WITH m AS (SELECT p_partkey, p_type AS raw_material, p_brand AS factor, p_size / 50.0 AS transmission_weight, (p_partkey % 200) AS lag_days, CASE WHEN p_partkey % 3 = 0 THEN 'approved' ELSE 'pending' END AS review_status FROM part), a AS (SELECT *, count(*) OVER (PARTITION BY raw_material, factor, lag_days) AS n FROM m WHERE review_status = 'approved')
SELECT p_partkey, raw_material, factor, lag_days FROM a WHERE n = 1 AND transmission_weight BETWEEN 0 AND 1 AND lag_days BETWEEN 0 AND 180""")
def com_load(spark, sf):
    m = b.table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("raw_material"), F.col("p_brand").alias("factor"), (F.col("p_size") / 50.0).alias("transmission_weight"), (F.col("p_partkey") % 200).alias("lag_days"), F.when(F.col("p_partkey") % 3 == 0, "approved").otherwise("pending").alias("review_status"))
    return op.approved_load(m, "review_status", ["raw_material", "factor", "lag_days"], op.weight_rules(transmission_weight=(0.0, 1.0, True), lag_days=(0, 180, True)), strict=False).select("p_partkey", "raw_material", "factor", "lag_days")


HS = """hm AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE lpad(CAST(p_partkey % 50 AS VARCHAR), 10, '70') END AS hs_code, CASE WHEN p_partkey % 8 = 0 THEN p_name ELSE 'leaf ' || (p_partkey % 50) END AS hs_name, p_size / 48.0 AS weight, DATE '2024-01-01' + CAST(p_size AS INTEGER) AS valid_from, DATE '2024-02-01' AS valid_to FROM part),
lf AS (SELECT DISTINCT lpad(CAST(p_partkey % 50 AS VARCHAR), 10, '70') AS leaf, 'leaf ' || (p_partkey % 50) AS leaf_name FROM part WHERE p_partkey % 50 < 45)"""


@query("trd_material_hs_contract", f"""WITH {HS} SELECT p_partkey, concat_ws(';', CASE WHEN NOT regexp_full_match(hs_code, '[0-9]{{10}}') THEN 'digits' END, CASE WHEN NOT (weight >= 0 AND weight <= 1) THEN 'weight_range' END, CASE WHEN valid_from > valid_to THEN 'dates' END, CASE WHEN leaf IS NULL THEN 'no_leaf' END, CASE WHEN leaf IS NOT NULL AND leaf_name <> hs_name THEN 'leaf_name' END) AS problems FROM hm LEFT JOIN lf ON leaf = hs_code""")
def trd_contract(spark, sf):
    p = b.table(spark, sf, "part")
    k = F.lpad((F.col("p_partkey") % 50).cast("string"), 10, "70")
    leaf_name = F.concat(F.lit("leaf "), (F.col("p_partkey") % 50).cast("string"))
    m = p.select("p_partkey", F.when(F.col("p_partkey") % 9 == 0, F.col("p_partkey").cast("string")).otherwise(k).alias("hs_code"), F.when(F.col("p_partkey") % 8 == 0, F.col("p_name")).otherwise(leaf_name).alias("hs_name"), (F.col("p_size") / 48.0).alias("weight"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size").cast("int")).alias("valid_from"), F.lit("2024-02-01").cast("date").alias("valid_to"))
    leaves = p.where("p_partkey % 50 < 45").select(k.alias("leaf"), leaf_name.alias("leaf_name")).distinct()
    j = m.join(leaves, F.col("hs_code") == F.col("leaf"), "left")
    rules = [(~F.col("hs_code").rlike("^[0-9]{10}$"), "digits"), *op.weight_rules(weight=(0.0, 1.0, True)), (F.col("valid_from") > F.col("valid_to"), "dates"), (F.col("leaf").isNull(), "no_leaf"), (F.coalesce(F.col("leaf_name") != F.col("hs_name"), F.lit(False)), "leaf_name")]
    return op.checked(j, ["p_partkey"], rules).select("p_partkey", "problems")


@query("mat_output_contract", """WITH l AS (SELECT CASE WHEN p_partkey % 100 = 1 THEN 0 ELSE p_partkey END AS id, p_type || ';' || split_part(p_name, ' ', 1) AS codes FROM part), o AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 50 <> 3), g AS (SELECT DISTINCT p_type AS code FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part WHERE p_size > 45),
u AS (SELECT DISTINCT unnest(string_split(codes, ';')) AS code FROM l),
r AS (SELECT (SELECT count(*) FROM l) AS rows, (SELECT count(*) - count(DISTINCT id) FROM l) AS duplicate_ids, 0 AS blank_ids, (SELECT count(*) FROM l WHERE codes = 'NONE') AS sentinels, (SELECT count(*) FROM u ANTI JOIN g USING (code)) AS unknown_codes, (SELECT count(*) FROM (SELECT DISTINCT id FROM l) a ANTI JOIN o USING (id)) AS missing_in_weights, (SELECT count(*) FROM o ANTI JOIN l USING (id)) AS only_in_weights)
SELECT *, CASE WHEN duplicate_ids + blank_ids + sentinels + unknown_codes + missing_in_weights + only_in_weights = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM r""")
def mat_contract(spark, sf):
    p = b.table(spark, sf, "part")
    first = F.element_at(F.split("p_name", " "), 1)
    lead = p.select(F.when(F.col("p_partkey") % 100 == 1, 0).otherwise(F.col("p_partkey")).alias("id"), F.concat_ws(";", "p_type", first).alias("codes"))
    glossary = p.select(F.col("p_type").alias("code")).union(p.where("p_size > 45").select(first))
    return op.output_contract({"items": lead, "weights": p.where("p_partkey % 50 <> 3").select(F.col("p_partkey").alias("id"))}, "id", "codes", glossary, "code", "NONE")
