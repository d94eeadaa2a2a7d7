"""Decisions from several sources: representative items, material codes by rule tables, and reconciled mappings with gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provisio.functions import flags, ladder, split_codes
from provisio.operators.items import match_key

# ---- representative classification

# What a dosage form and a pack unit stand for, and groups whose items are approved one by one.
FORMS = {"tablet": "ORAL_TABLET", "capsule": "ORAL_CAPSULE", "syrup": "ORAL_LIQUID", "injection": "INJECTION", "ointment": "TOPICAL"}
PACK_UNITS = {"tab": "TABLET", "cap": "CAPSULE", "bottle": "BOTTLE", "vial": "VIAL", "ea": "EA"}
DRUG_GROUPS = ("MED_ORAL", "MED_INJECT", "MED_TOPICAL", "KM_EXTRACT")
NO_FAMILY = ("", "UNSPECIFIED_ITEM")
NO_GROUP = ("", "UNCLASSIFIED")


def core_name(c: Column) -> Column:
    """A name's key without bracketed parts and the pack at its end."""
    return match_key(F.regexp_replace(c, r"(?i)[\s_-]*\d+\s*(?:t|ea|tab|tablets|cap|vial|bottle)\s*$", ""), brackets=True)


def contains_all(have: Column, wanted: Column) -> Column:
    """Whether a ;-joined list has all the codes of another that has at least one."""
    wanted = F.transform(split_codes(wanted), lambda x: match_key(x))
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, F.transform(split_codes(have), lambda x: match_key(x)))) == 0)


def one_row_each(df: DataFrame, key: str, name: str) -> None:
    """Raises where a key that must be unique isn't, with an example."""
    twice = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{name}: {key} {twice[0][0]} stands in {twice[0]['count']} rows")


def classified(worklist: DataFrame, suggestions: DataFrame, official: DataFrame, rules: DataFrame) -> DataFrame:
    """One decision for each representative of the worklist (rep_id, name, family, subtype, specification, unit, group, candidate_status, dosage_form, strength, pack_unit).

    suggestions (rep_id, suggested_family, basis, note) may name a family where the worklist has none, and an official record in the note (itemSeq=...). official (seq, official_name, official_url, families, strengths), lists ;-joined.
    rules (rule_family, rule_group, pattern, evidence_id): families that are approved when group, specification and unit fit. States, from the last that holds: unresolved, group_only, conflict, candidate_family, candidate_complete,
    approved_family, approved_item. A conflict is never complete and never an approved item. The item is approved when the official record has its name, its family and all of its strengths.
    """
    for df, key, name in ((suggestions, "rep_id", "suggestions"), (official, "seq", "official"), (rules, "rule_family", "rules")):
        one_row_each(df, key, name)
    c = F.col
    blank = lambda x: F.coalesce(F.trim(c(x)), F.lit(""))
    texts = ["name", "family", "subtype", "specification", "unit", "group", "candidate_status", "dosage_form", "strength", "pack_unit"]
    rows = worklist.select("rep_id", *(blank(t).alias(t) for t in texts)).join(suggestions.select("rep_id", *(blank(t).alias(t) for t in ("suggested_family", "basis", "note"))), "rep_id", "left").fillna("", ["suggested_family", "basis", "note"])
    own = c("family") != ""
    chosen = F.when(own, c("family")).when(c("suggested_family").isin(*NO_FAMILY), "").otherwise(c("suggested_family"))
    drug = ~own & (chosen != "") & c("dosage_form").isin(*FORMS)
    look = lambda x, values: ladder([(x == k, v) for k, v in values.items()], "")
    rows = rows.withColumns({
        "chosen_family": chosen, "chosen_subtype": F.when(drug, look(c("dosage_form"), FORMS)).otherwise(c("subtype")), "chosen_specification": F.when(drug, c("strength")).otherwise(c("specification")), "chosen_unit": F.when(drug, look(c("pack_unit"), PACK_UNITS)).otherwise(c("unit")),
        "seq": F.regexp_extract("note", r"itemSeq=(\d+)", 1), "classification_basis": F.when(own, "local_rule").otherwise(F.concat(F.lit("suggestion:"), c("basis"))),
    })
    record = official.select(c("seq").cast("string").alias("seq"), *(blank(t).alias(t) for t in ("official_name", "official_url", "families", "strengths")))
    rows = rows.join(record, "seq", "left").join(rules, c("chosen_family") == c("rule_family"), "left")
    conflict, unresolved = (c("candidate_status") == "candidate_conflict") | (c("group") == ""), c("chosen_family") == ""
    complete = (c("chosen_subtype") != "") & (c("chosen_specification") != "") & (c("chosen_unit") != "")
    name_ok = F.coalesce((core_name(c("official_name")) != "") & (core_name(c("official_name")) == core_name(c("name"))), F.lit(False))
    family_ok, strength_ok = F.coalesce(F.array_contains(split_codes(c("families")), c("chosen_family")), F.lit(False)), F.coalesce(contains_all(c("strengths"), c("chosen_specification")), F.lit(False))
    fits = own & F.coalesce((c("rule_group") == c("group")) & F.regexp_like(c("chosen_specification"), c("pattern")), F.lit(False)) & (c("candidate_status") == "candidate_consistent") & (c("chosen_unit") == "EA")
    is_item, is_family = name_ok & family_ok & strength_ok & complete & ~conflict & c("group").isin(*DRUG_GROUPS), fits & complete
    state = ladder([(is_item, "approved_item"), (is_family, "approved_family"), (conflict, "conflict"), (unresolved & ~c("group").isin(*NO_GROUP), "group_only"), (unresolved, "unresolved"), (complete, "candidate_complete")], "candidate_family")
    wrong = flags([(c("seq") == "", "no_official_record"), ((c("seq") != "") & ~name_ok, "name_differs"), ((c("seq") != "") & ~family_ok, "family_not_verified"), ((c("seq") != "") & ~strength_ok, "strength_not_verified"), (~complete, "details_missing")])
    out = rows.withColumn("state", state)
    reason = ladder([
        (c("state") == "approved_item", "official_name_family_and_strengths"), (c("state") == "approved_family", "family_specification_and_unit_fit_the_rule"), (c("state") == "conflict", "group_or_family_conflict"),
        (c("state") == "group_only", "only_the_group_is_known"), (c("state") == "unresolved", "family_not_identified"),
    ], F.array_join(wrong, ";"))
    by_state = lambda values, other: ladder([(c("state") == k, v) for k, v in values.items()], other)
    return out.select(
        "rep_id", "state", by_state({"approved_item": "APPROVE_ITEM", "approved_family": "APPROVE_FAMILY"}, "").alias("action"), by_state({"approved_item": 1.0, "approved_family": 0.97}, 0.6).alias("confidence"), reason.alias("reason"), "chosen_family", "chosen_subtype", "chosen_specification", "chosen_unit", "classification_basis",
        by_state({"approved_item": c("seq"), "approved_family": F.concat_ws("::", "evidence_id", "chosen_family")}, "").alias("evidence_record"),
    )


# ---- material codes by rules that are data


def resolved_codes(rows: DataFrame, key: str, fields: Sequence[str], rules: DataFrame, generic: Sequence[str] = ()) -> DataFrame:
    """rows with codes, basis, level and confidence by a rule table (level, field, value, codes, basis, confidence, blocks, promotes).

    A rule fits a row whose field has its value ('*' fits any that is not blank); the one of the lowest level counts, then the smallest codes. codes are ;-joined and may hold {name of a field}, which the row fills in. A rule that blocks leaves the row
    unmapped, whatever rules of higher levels say. Of rules that promote, the first puts its codes in the place of generic codes of the result, unless it blocks. All rules meet the distinct values of the fields in one equality join on (field, value);
    rows take what their values found, also where they share a key.
    """
    filled = lambda f: F.coalesce(F.trim(F.col(f)), F.lit(""))
    said = F.array(*(F.struct(F.lit(f).alias("field"), v.alias("value")) for f in fields for v in (filled(f), F.when(filled(f) != "", "*"))))
    rows_said = rows.withColumn("__said", F.struct(*(filled(f).alias(f) for f in fields)))
    kinds = rows_said.select("__said").distinct().select("__said", *(F.col("__said")[f].alias(f) for f in fields))
    long = kinds.select("__said", F.explode(F.filter(said, lambda x: F.coalesce(x["value"], F.lit("")) != "")).alias("x")).select("__said", "x.*")
    met = long.join(rules, ["field", "value"])
    best = lambda keep: F.min(F.when(keep, F.struct("level", "codes", "basis", "confidence", "blocks")))
    found = met.groupBy("__said").agg(best(~F.col("promotes")).alias("r"), best(F.col("promotes")).alias("p"))
    out = rows_said.join(found, "__said", "left")

    def told(codes: Column) -> Column:
        for f in fields:
            codes = F.replace(codes, F.lit(f"{{{f}}}"), filled(f))
        return split_codes(codes)

    usable = F.col("r").isNotNull() & ~F.coalesce(F.col("r.blocks"), F.lit(False))
    codes = F.when(usable, told(F.col("r.codes"))).otherwise(F.array().cast("array<string>"))
    special = F.when(F.col("p").isNotNull() & ~F.coalesce(F.col("p.blocks"), F.lit(False)), told(F.col("p.codes")))
    is_generic = lambda x: x.isin(*generic) if generic else F.lit(False)
    promotable = F.exists(codes, is_generic) & special.isNotNull()
    promoted = F.array_distinct(F.flatten(F.transform(codes, lambda x: F.when(is_generic(x), special).otherwise(F.array(x)))))
    return out.select(
        *rows.columns, F.array_join(F.when(promotable, promoted).otherwise(codes), ";").alias("material_codes"), F.when(usable, F.col("r.basis")).when(F.col("r").isNotNull(), F.lit("blocked")).otherwise("unmapped").alias("mapping_basis"),
        F.when(usable, F.col("r.level")).alias("mapping_level"), F.when(usable, F.col("r.confidence")).otherwise(0.0).alias("mapping_confidence"), promotable.alias("promoted"),
    )


# ---- mappings of two sources behind gates


def reconciled(strict_rows: DataFrame, bulk_rows: DataFrame, key: str, columns: Sequence[str], taxonomy: DataFrame, facts: DataFrame, strict: bool = True, examples: int = 3) -> tuple[DataFrame, DataFrame]:
    """(mapping, failures). Two sources (key, columns with family and subtype) become one in which strict rows win; taxonomy (family, subtype, group) must give each exactly one group, and every row of facts must meet a mapping.

    failures: kind, n, examples (the smallest keys). With strict any failure raises and names them; else keys that fail are left out: those doubled in one source with different columns, and those without one group.
    """
    c = F.col
    both = strict_rows.select(key, *columns, F.lit(0).alias("__s")).unionByName(bulk_rows.select(key, *columns, F.lit(1).alias("__s"))).where(c(key).isNotNull())
    values = F.struct(*columns)
    each = both.groupBy(key, "__s").agg(F.min(values).alias("v"), F.max(values).alias("w"))
    twice = each.groupBy(key).agg(F.max(~c("v").eqNullSafe(c("w"))).alias("twice"), F.min(F.struct("__s", "v")).alias("x"))
    groups = taxonomy.groupBy("family", "subtype").agg(F.count_distinct("group").alias("__groups"), F.min("group").alias("group"))
    merged = twice.select(key, "twice", *(c(f"x.v.{n}").alias(n) for n in columns), (c("x.__s") == 0).alias("is_strict")).join(groups, ["family", "subtype"], "left")
    kind = ladder([(c("twice"), "doubled_key"), (F.coalesce(c("__groups"), F.lit(0)) == 0, "unknown_taxonomy"), (c("__groups") > 1, "ambiguous_taxonomy")], None)
    merged = merged.withColumn("__kind", kind)
    good = merged.where("__kind is null").select(key, *columns, "group", "is_strict")
    bad = merged.where("__kind is not null").select(c("__kind").alias("kind"), c(key).cast("string").alias("k"))
    unmet = facts.select(key).distinct().join(good.select(key), key, "left_anti").select(F.lit("unmatched_fact").alias("kind"), c(key).cast("string").alias("k"))
    every = bad.unionByName(unmet)
    few = every.withColumn("__r", F.row_number().over(W.partitionBy("kind").orderBy("k"))).where(c("__r") <= examples).groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("k")), ";").alias("examples"))
    failures = every.groupBy("kind").agg(F.count("*").alias("n")).join(few, "kind")
    if strict and (found := failures.orderBy("kind").collect()):
        raise ValueError("; ".join(f"{r.kind}: {r.n}, such as {r.examples}" for r in found))
    return good, failures


def attached(facts: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """facts with their mapping, many to one; a key that the mapping has twice raises, so no fact is doubled."""
    one_row_each(mapping, key, "mapping")
    return facts.join(mapping, key)
