"""Supply policy, ingredients, groups and exposure candidates: every state is met, and each decision has its expected value."""

from __future__ import annotations

import pytest

from provisio.registry import QUERIES  # isort: skip  (plans are imported through it)
from provisio.operators import exposure as op
from provisio.plans import exposure as pl

SF = "/root/testdata/sf0.01"


def policy(spark, codes, **more):
    names = ["codes", "a", "b", "st", "old"]
    row = {"codes": codes, "a": "no", "b": "yes", "st": "approved", "old": None} | more
    rules = spark.createDataFrame(pl.RULES, pl.RULE_TYPES)
    return op.supply_policy(spark.createDataFrame([tuple(row[n] for n in names)], ", ".join(f"{n} string" for n in names)), "codes", rules, pl.LEVELS, ["a", "b"], "st", "old").first()


@pytest.mark.parametrize(("codes", "more", "level", "source", "review"), [
    ("PORT", {}, "WATCH", "meta_code", False),
    ("PORT; OIL;PORT", {}, "WARNING", "meta_code", False),
    ("FLU", {}, "NORMAL", "non_supply_axis_only", False),
    ("FLU;STRIKE;PORT", {}, "WATCH", "meta_code", False),
    ("ODD", {}, "NORMAL", "default_unmapped_code", True),
    ("ODD;FLU", {}, "NORMAL", "non_supply_axis_only", True),
    (" ;", {}, "NORMAL", "default_missing_code", True),
    (None, {}, "NORMAL", "default_missing_code", True),
    ("PORT", {"a": "True"}, "CRITICAL", "approved_critical_override", False),
    ("PORT", {"a": "True", "st": "pending"}, "WATCH", "meta_code", False),
    ("PORT", {"a": "True", "st": None}, "WATCH", "meta_code", False),
])
def test_policy_levels(spark, codes, more, level, source, review):
    r = policy(spark, codes, **more)
    assert (r.supply_level, r.level_source, r.policy_needs_review) == (level, source, review)
    assert (r.supply_z, r.lead_time_multiplier) == {n: (z, m) for n, z, m in pl.LEVELS}[level]


def test_policy_notes_codes_and_compares_levels(spark):
    r = policy(spark, "STRIKE;CRUDE;FLU;ODD;OIL", old="high")
    assert (r.canonical_codes, r.ignored_codes, r.unmapped_codes, r.level_mismatch) == ("FLU;OIL", "FLU;STRIKE", "ODD", False)
    assert [policy(spark, "PORT", old=v).level_mismatch for v in ("low", " ", "watch", "MEDIUM")] == [True, False, False, True]
    twice = spark.createDataFrame([*pl.RULES, pl.RULES[0]], pl.RULE_TYPES)
    with pytest.raises(ValueError, match="rule code is not unique"):
        op.supply_policy(spark.createDataFrame([("x",)], "codes string"), "codes", twice, pl.LEVELS)


def inputs(spark, **more):
    made = {
        "classified": ([("l1", "F", " APPROVED"), ("l2", "F", "pending"), ("l3", "F", "approved"), ("l4", "F", "approved")], "local_item_key string, item_family_id string, review_status string"),
        "alias": ([("l1", "r1"), ("l1", "r1"), ("l2", "r1"), ("l3", "r1"), ("l3", "r2"), ("l4", None)], "local_item_key string, representative_item_id string"),
        "items": ([("r1", " ", "A;B; A", "needs_review", "low", "t3", None, "PORT")], "representative_item_id string, selected_family_id string, raw_material_meta_codes string, material_review_status string, material_confidence string, material_evidence_tier string, raw_material_evidence string, codes string"),
        "claims": ([("r1", "A", "src", "", "u", "approved", "Approved"), ("r1", "B", "src", "f", "u", "pending", "approved")], "representative_item_id string, raw_material_meta_code string, evidence_source string, evidence_field string, evidence_url string, identity_review_status string, material_review_status string"),
        "factors": ([("A", "f2"), ("A", "f1"), ("A", "f2"), ("A", " "), ("B", "")], "raw_material_meta_code string, market_factor_id string"),
    } | more
    df = {k: spark.createDataFrame(*v) for k, v in made.items()}
    df["items"] = op.supply_policy(df["items"], "codes", spark.createDataFrame(pl.RULES, pl.RULE_TYPES), pl.LEVELS)
    return df


def test_candidates_of_single_representatives(spark):
    df = inputs(spark)
    got = {r.raw_material_meta_code: r for r in op.candidates(**df).collect()}
    assert set(got) == {"A", "B"} and {r.local_item_key for r in got.values()} == {"l1"}  # l2 is pending, l3 ambiguous, l4 unknown
    a, b = got["A"], got["B"]
    assert (a.material_review_status, a.material_confidence, a.material_evidence_reference, a.market_factor_ids, a.market_factor_count) == ("approved", "verified", "src | u", "f1;f2", 2)
    assert a.operational_risk_eligible and a.review_priority == "high" and not a.family_conflict
    assert (b.material_review_status, b.official_claim, b.market_factor_count, b.operational_risk_eligible, b.review_priority) == ("needs_review", False, 0, False, "normal")
    r = op.candidate_report(df["classified"], op.candidates(**df)).first()
    assert (r.approved_classifications, r.candidate_count, r.candidate_items, r.official_claims, r.eligible, r.blocked_reason) == (3, 2, 1, 1, 1, "")


@pytest.mark.parametrize(("family", "codes", "priority"), [("G", "PORT", "blocked_family_conflict"), ("G", "ODD", "blocked_supply_policy_review"), ("F", "ODD", "blocked_supply_policy_review"), ("F", "PORT", "high")])
def test_what_blocks_a_candidate(spark, family, codes, priority):
    df = inputs(spark)
    one = df["items"].select("representative_item_id").first()[0]
    rows = spark.createDataFrame([(one, family, "A", "approved", "low", "t", "e", codes)], "representative_item_id string, selected_family_id string, raw_material_meta_codes string, material_review_status string, material_confidence string, material_evidence_tier string, raw_material_evidence string, codes string")
    df["items"] = op.supply_policy(rows, "codes", spark.createDataFrame(pl.RULES, pl.RULE_TYPES), pl.LEVELS)
    r = op.candidates(**df).first()
    assert r.review_priority == priority and r.operational_risk_eligible == (family == "F")


def test_report_of_nothing_names_the_reason(spark):
    df = inputs(spark, factors=([], "raw_material_meta_code string, market_factor_id string"))
    found = op.candidates(**df)
    reason = lambda c, f: op.candidate_report(c, f).first().blocked_reason
    assert reason(df["classified"], found) == "material_candidates_require_review"
    assert reason(df["classified"], found.where("false")) == "no_material_candidates_for_approved_classifications"
    assert reason(df["classified"].where("false"), found.where("false")) == "no_approved_classification"


def test_keys_that_repeat_are_errors(spark):
    df = inputs(spark)
    for name, message in (("classified", "local_item_key"), ("items", "representative_item_id"), ("claims", "claim")):
        with pytest.raises(ValueError, match=f"{message} is not unique"):
            op.candidates(**(df | {name: df[name].unionByName(df[name])}))


def test_groups_fall_back_in_three_steps(spark):
    rows = [(1, "A", False, "u", "k"), (2, "A", False, "", None), (3, "A", True, None, "k"), (4, "B", False, None, ""), (5, None, False, "", ""), (6, "A", None, "u", None)]
    master = spark.createDataFrame(rows, "drug_code long, ingredient_code string, several boolean, usage_division string, drug_kind string")
    groups = spark.createDataFrame([(2, "g2"), (4, "g4"), (5, "")], "drug_code long, item_group string")
    got = {r.drug_code: (r.tier, r.group_id) for r in op.fallback_groups(master, groups, 2).collect()}
    assert got == {1: (1, "ING:A"), 2: (1, "ING:A"), 3: (2, "USE:/k"), 4: (3, "GRP:g4"), 5: (0, "UNASSIGNED"), 6: (2, "USE:u/")}
    assert {r.tier for r in op.fallback_groups(master, groups, 3).where("drug_code = 1").collect()} == {2}


def test_approved_ingredients_overwrite(spark):
    items = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "representative_item_id long, ingredient_names string")
    e = spark.createDataFrame([(1, "C1", "one", "approved"), (2, "C2", "two", "pending"), (3, "", "three", "approved")], "representative_item_id long, ingredient_code string, ingredient_name string, review_status string")
    got = {r.representative_item_id: (r.ingredient_ids, r.ingredient_names, r.ingredient_source != "") for r in op.attached_ingredients(items, e).collect()}
    assert got == {1: ("C1", "one", True), 2: ("", "y", False), 3: ("", "z", False)}
    with pytest.raises(ValueError, match="not unique"):
        op.attached_ingredients(items, e.unionByName(e))


@pytest.mark.parametrize(("code", "name", "evidence", "is_medical", "step"), [
    ("H", "gauze", True, True, "ingredient"), ("H", "gauze", None, False, "hard_code"), ("G", "Sterile GAUZE bag", False, True, "default"), ("G", "bag", None, False, "guard_without_word"), ("G", None, None, False, "guard_without_word"),
    (None, "Mug", None, False, "promotional_word"), ("O", "mug with gauze", None, True, "default"), ("X", "mug", None, True, "default"), (None, None, None, True, "default"),
])
def test_medical_steps(spark, code, name, evidence, is_medical, step):
    classes = spark.createDataFrame([("H", "hard"), ("G", "guard"), ("O", "open")], "code string, kind string")
    r = op.medical(spark.createDataFrame([(code, name, evidence)], "material_code string, name string, has_ingredient boolean"), classes, "gauze", "mug|bag").first()
    assert (r.is_medical, r.medical_step) == (is_medical, step)


def test_every_state_occurs_in_the_tables(spark):
    policies = pl.items(spark, SF)
    assert {r[0] for r in policies.select("level_source").distinct().collect()} == {"meta_code", "non_supply_axis_only", "default_missing_code", "default_unmapped_code", "approved_critical_override"}
    assert {r[0] for r in policies.select("supply_level").distinct().collect()} == {n for n, _, _ in pl.LEVELS}
    assert {r[0] for r in pl.found(spark, SF).select("review_priority").distinct().collect()} == set(op.PRIORITIES)
    r = QUERIES["mat_exposure_report"](spark, SF).first()
    assert r.candidate_count > r.candidate_items > r.policy_review_items > 0 < r.eligible < r.approved_materials
    assert {r.tier for r in QUERIES["mat_fallback_groups"](spark, SF).select("tier").distinct().collect()} == {0, 1, 2, 3}
    assert {r[0] for r in QUERIES["mat_medical_steps"](spark, SF).select("medical_step").distinct().collect()} == {"ingredient", "hard_code", "guard_without_word", "promotional_word", "default"}


def test_no_pairing_without_keys(spark):
    plan = pl.found(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
