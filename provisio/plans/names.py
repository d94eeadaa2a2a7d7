"""Queries on item names: attributes as claimed spans. Names are made of known parts, and the SQL tells the parts without parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio.operators import aliases as al
from provisio.operators import claims as cl
from provisio.plans import bindings as b
from provisio.registry import query

# The twelve kinds of made names, by p_partkey % 12; s is p_size, t the type in lower case.
MADE = """mn AS (SELECT p_partkey, p_name AS n, p_size AS s, lower(p_type) AS t, p_brand AS m, p_partkey % 12 AS k FROM {part}),
nm AS (SELECT *, CASE k WHEN 0 THEN n || ' syringe(' || s || 'cc/' || (14 + s % 20) || 'gX' || (s + 5) || 'mm/' || (2 * s) || 'ea)' WHEN 1 THEN n || ' inj' || s || 'G' WHEN 2 THEN n || ' syrup(' || t || ' acid salt)_(' || s || '.50g/500mL)(Acme Pharm co., ltd)-' || (s + 100) || '(1)ml/bottle'
  WHEN 3 THEN n || ' gauze ' || s || 'g' WHEN 4 THEN n || ' gauze 10cm*' || s || 'cm ' || s || 'sheet' WHEN 5 THEN n || ' cream (' || m || ' Co., Ltd.)-' || s || 'G(1ea)' WHEN 6 THEN n || ' tab (' || t || ' acid)_(6.940mg/1tab)-' || s || 'tab' WHEN 7 THEN n || ' susp-' || s || 'ml/sachet'
  WHEN 8 THEN n || ' tab ' || s || ' mg(odd hydrochloride)-1tab' WHEN 9 THEN n WHEN 10 THEN n || ' tube ' || s || 'fr (odd [deep (' || t || ')] thing) (with note)' ELSE n || ' 0.90% ' || t || ' ACID 1,00' || (s % 10) || ' ml' END AS name,
  CASE k WHEN 0 THEN 'needle' WHEN 5 THEN 'topical' WHEN 3 THEN 'supply' WHEN 4 THEN 'supply' WHEN 10 THEN 'supply' WHEN 9 THEN '' ELSE 'medication' END AS context FROM mn)"""
TOLD = """SELECT DISTINCT name, context,
  n || CASE k WHEN 0 THEN ' syringe' WHEN 1 THEN ' inj' WHEN 2 THEN ' syrup' WHEN 3 THEN ' gauze' WHEN 4 THEN ' gauze' WHEN 5 THEN ' cream' WHEN 6 THEN ' tab' WHEN 7 THEN ' susp' WHEN 8 THEN ' tab' WHEN 9 THEN '' WHEN 10 THEN ' tube odd deep ' || t || ' thing with note' ELSE ' ' || t || ' ACID' END AS base_name,
  CASE k WHEN 2 THEN s || '.5g/500mL' WHEN 6 THEN '6.94mg/1TABLET' WHEN 11 THEN '0.9%' ELSE '' END AS concentrations, CASE k WHEN 1 THEN s || 'g' WHEN 2 THEN s || '.5g' WHEN 6 THEN '6.94mg' WHEN 8 THEN s || 'mg' ELSE '' END AS active_strengths,
  CASE WHEN k IN (3, 5) THEN s || 'g' ELSE '' END AS net_weight, CASE k WHEN 0 THEN s || 'mL' WHEN 2 THEN (s + 100) || 'mL' WHEN 7 THEN s || 'mL' WHEN 11 THEN '100' || (s % 10) || 'mL' ELSE '' END AS capacity, CASE k WHEN 0 THEN 'instrument_capacity' WHEN 2 THEN 'container_volume' WHEN 7 THEN 'container_volume' WHEN 11 THEN 'container_volume' ELSE '' END AS capacity_role,
  CASE k WHEN 0 THEN (14 + s % 20) || 'G' WHEN 10 THEN s || 'Fr' ELSE '' END AS gauge, CASE k WHEN 0 THEN (s + 5) || 'mm' ELSE '' END AS needle_length, CASE k WHEN 4 THEN '10cm x ' || s || 'cm' ELSE '' END AS dimensions,
  CASE k WHEN 0 THEN CAST(2 * s AS VARCHAR) WHEN 4 THEN CAST(s AS VARCHAR) WHEN 5 THEN '1' WHEN 6 THEN CAST(s AS VARCHAR) WHEN 2 THEN '1' WHEN 7 THEN '1' WHEN 8 THEN '1' ELSE '' END AS pack_quantity, CASE k WHEN 0 THEN 'EA' WHEN 2 THEN 'BOTTLE' WHEN 4 THEN 'SHEET' WHEN 5 THEN 'EA' WHEN 6 THEN 'TABLET' WHEN 7 THEN 'SACHET' WHEN 8 THEN 'TABLET' ELSE '' END AS pack_unit,
  CASE k WHEN 2 THEN upper(t) || '_SALT' WHEN 6 THEN upper(t) WHEN 11 THEN upper(t) WHEN 8 THEN 'UNMAPPED::ODDHYDROCHLORIDE' ELSE '' END AS ingredients, CASE WHEN k IN (2, 6, 11) THEN 'dictionary' WHEN k = 8 THEN 'unmapped' ELSE '' END AS ingredient_source,
  CASE k WHEN 2 THEN 'Acme Pharm' WHEN 5 THEN m ELSE '' END AS manufacturer, CASE k WHEN 10 THEN 'with note' ELSE '' END AS notes, CASE k WHEN 10 THEN 'odd [deep (' || t || ')] thing' ELSE '' END AS unresolved,
  CASE WHEN k = 9 THEN 'unclassified_item_group' WHEN k IN (1, 5, 7) THEN 'medication_ingredient_unresolved' WHEN k = 8 THEN 'ingredient_requires_verification' WHEN k = 10 THEN 'unresolved_parenthetical_tokens' ELSE '' END AS reasons,
  CASE WHEN k IN (2, 5, 6, 11) THEN 0.9 WHEN k = 9 THEN 0.55 WHEN k = 10 THEN 0.7 ELSE 0.75 END AS confidence, CASE WHEN k IN (2, 5, 6, 11) THEN 'verified' WHEN k IN (1, 7, 8, 9, 10) THEN 'needs_match' ELSE 'parsed' END AS status FROM nm"""


def made_names(spark, sf):
    sql = MADE.replace("p_partkey % 12", "cast(p_partkey % 12 as int)")
    return spark.sql(f"WITH {sql} SELECT * FROM nm", part=b.table(spark, sf, "part"))


def dictionaries(spark, sf):
    """Aliases, of which one is the beginning of the other, and makers."""
    p = b.table(spark, sf, "part")
    t = p.select(F.lower("p_type").alias("t")).distinct()
    alias = t.select(F.concat("t", F.lit(" acid")).alias("alias"), F.upper("t").alias("canonical")).unionByName(t.select(F.concat("t", F.lit(" Acid salt")).alias("alias"), F.concat(F.upper("t"), F.lit("_SALT")).alias("canonical")))
    return alias, p.select(F.concat(F.upper("p_brand"), F.lit(" co.,ltd")).alias("maker")).distinct()


@query("itm_claimed_attributes", "WITH " + MADE.replace("{part}", "part") + ", x AS (" + TOLD + ") SELECT *, " + " || '|' || ".join(f"CASE WHEN {c} <> '' THEN {c} ELSE '-' END" for c in ("context", "capacity", "gauge", "needle_length", "dimensions", "pack_quantity", "pack_unit")) + " AS variant_key FROM x")
def itm_claimed(spark, sf):
    """Only distinct names are parsed."""
    return cl.parsed(made_names(spark, sf).select("name", "context").distinct(), *dictionaries(spark, sf)).drop("tokens")


# Made raw names: what stands before and behind a part's name, the beginning of its code, and what its record says. # is p_size; a missing column is blank.
CASES = [
    dict(before="1) [visit] (free) ", after=" syringe 3ml 23g #ea - rental (branch office)", product=" syringe 3ml 23g #ea", tags="visit;free;rental;branch", klass="RENTAL_PROGRAM", family="DISPOSABLE_SYRINGE", subtype="WITH_NEEDLE", unit="EA", group="MED_SUPPLY", method="family:DISPOSABLE_SYRINGE", confidence=0.95, pack="#", pack_unit="ea", spec="3ML", material="PP;PE"),
    dict(before="[promo] ", after=" gauze 10cm x 5 sterile", product=" gauze 10cm x 5 sterile", tags="promo", klass="PROMOTIONAL_USE", family="MEDICAL_GAUZE", subtype="STERILE", unit="SHEET", intrinsic="MED_SUPPLY", group="PROMO", method="operational:promo", confidence=0.99, spec="10CMX5", material="COTTON"),
    dict(before="", after=" wheelchair (rental)", product=" wheelchair", tags="rental", klass="RENTAL_PROGRAM", intrinsic="UNCLASSIFIED", group="RENTAL", method="operational:rental_asset", confidence=0.98),
    dict(before="", after=" tablet #mg (salt) 30tab", product=" tablet #mg (salt) 30tab", group="MED_ORAL", method="dosage_form:oral", confidence=0.86, form="tablet", strengths="#mg", pack="30", pack_unit="tab", details="salt"),
    dict(before="", after=" tablet case", code="USE", product=" tablet case", group="UNCLASSIFIED", method="no_rule", confidence=0.0),
    dict(before="", after=" culture badge", product=" culture badge", group="UNCLASSIFIED", method="no_rule", confidence=0.0),
    dict(before="", after=" culture media #mg", product=" culture media #mg", group="LAB_REAGENT", method="pattern:culture_media", confidence=0.90, strengths="#mg"),
    dict(before="(*free) 3: ", after=" herb extract", code="omd", product=" herb extract", tags="free", group="KM_EXTRACT", method="pattern:km_extract", confidence=0.90),
    dict(before="", after=" herb extract", product=" herb extract", group="KM_HERB", method="pattern:km_herb", confidence=0.88),
    dict(before="", after=" odd thing", code="OOM", product=" odd thing", group="UNCLASSIFIED", method="code_hint:unresolved", confidence=0.20),
    dict(before="", after=" waste drum #L", product=" waste drum #L", family="MEDICAL_WASTE_CONTAINER", subtype="RIGID_DRUM", unit="EA", group="MED_SUPPLY", method="family:MEDICAL_WASTE_CONTAINER", confidence=0.95, spec="#L"),
    dict(before="", after=" diesel syringe", product=" diesel syringe", group="FUEL", method="pattern:fuel", confidence=0.98),
    dict(before="", after=" inj", product=" inj", group="MED_INJECT", method="dosage_form:injection_suffix", confidence=0.82, form="injection"),
    dict(before="", after=" ice cream", product=" ice cream", group="UNCLASSIFIED", method="no_rule", confidence=0.0),
    dict(before="", after=" cream 0.5% 2 bottle", product=" cream 0.5% 2 bottle", group="MED_TOPICAL", method="dosage_form:topical", confidence=0.86, form="cream", strengths="0.5%", pack="2", pack_unit="bottle"),
]


def _case(column, default="''", quoted=True):
    """A CASE over the kinds of made names; text columns may hold #."""
    text = lambda v: "replace('" + v + "', '#', concat('', p_size))" if quoted else str(v)
    return "CASE k " + " ".join(f"WHEN {i} THEN {text(c[column])}" for i, c in enumerate(CASES) if column in c) + f" ELSE {default} END"


RAW = f"""pk AS (SELECT p_partkey, p_name, p_size, CAST(p_partkey % {len(CASES)} AS INTEGER) AS k FROM {{part}}),
rn AS (SELECT *, {_case('before')} || p_name || '  ' || ltrim({_case('after')}) AS raw, {_case('code')} || concat('', p_partkey) AS code FROM pk)"""


def _record_sql():
    cols = {"operational_tags": _case("tags"), "operational_class": _case("klass", "'GENERAL'"), "family_id": _case("family"), "subtype_id": _case("subtype"), "standard_unit": _case("unit"), "intrinsic_group": f"coalesce(nullif({_case('intrinsic')}, ''), {_case('group')})", "group_id": _case("group"), "classification_method": _case("method"), "classification_confidence": _case("confidence", "0.0", False), "dosage_form": _case("form"), "strengths": _case("strengths"), "pack_quantity": _case("pack"), "pack_unit": _case("pack_unit"), "specification": _case("spec"), "material": _case("material"), "details": _case("details")}
    return f"SELECT raw, code, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS cleaned_name, p_name || {_case('product')} AS product_name, " + ", ".join(f"{v} AS {k}" for k, v in cols.items()) + " FROM rn"


@query("itm_alias_records", f"""WITH {RAW.replace('{part}', 'part')}, li AS (SELECT l_partkey, l_suppkey AS institution_id, count(*) AS occurrences, sum(l_quantity) AS usage, min(CAST(l_shipdate AS DATE)) AS first_date, max(CAST(l_shipdate AS DATE)) AS last_date FROM lineitem GROUP BY 1, 2),
re AS ({_record_sql()}) SELECT institution_id, re.*, CASE WHEN intrinsic_group IN ('FUEL', 'UNCLASSIFIED') THEN 'f' ELSE 't' END AS forecastable_default, CASE WHEN group_id IN ('FUEL', 'UNCLASSIFIED', 'PROMO', 'RENTAL') THEN 'f' ELSE 't' END AS forecastable, CASE WHEN family_id <> '' THEN 'family_candidate' WHEN intrinsic_group <> 'UNCLASSIFIED' THEN 'group_candidate' ELSE 'unresolved' END AS status,
  occurrences, usage, first_date, last_date FROM rn JOIN re USING (raw, code) JOIN li ON l_partkey = p_partkey""")
def itm_records(spark, sf):
    """Names are parsed once each; counts of their use are joined to them."""
    named = spark.sql(f"WITH {RAW} SELECT p_partkey, raw, code FROM rn", part=b.table(spark, sf, "part"))
    li = b.table(spark, sf, "lineitem").select("l_partkey", F.col("l_suppkey").alias("institution_id"), "l_quantity", F.col("l_shipdate").cast("date").alias("date"))
    used = li.groupBy("l_partkey", "institution_id").agg(F.count("*").alias("occurrences"), F.sum("l_quantity").alias("usage"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    record = al.records(named.select("raw", "code").distinct(), None).drop("family_name")
    return used.join(named, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey").join(record, ["raw", "code"])
