"""Decisions from several sources: every state with its reason, rules as rows, gates with examples."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from provisio.registry import QUERIES  # isort: skip  (plans are imported through it)
from provisio.operators import resolution as op
from provisio.plans import resolution as pl

WORK = "rep_id long, name string, family string, subtype string, specification string, unit string, `group` string, candidate_status string, dosage_form string, strength string, pack_unit string"


def decided(spark, work, suggestion=("", "", ""), official=None):
    rules = spark.createDataFrame([("SYRINGE", "MED_SUPPLY", r"^\d+mL$", "EV")], "rule_family string, rule_group string, pattern string, evidence_id string")
    row = {"name": "Nova tab 30T", "candidate_status": "candidate_consistent", "group": "MED_ORAL"} | work
    names = [c.split()[0].strip("`") for c in WORK.split(", ")][1:]
    records = spark.createDataFrame([official] if official else [], "seq long, official_name string, official_url string, families string, strengths string")
    got = op.classified(spark.createDataFrame([(1, *(row.get(n) for n in names))], WORK), spark.createDataFrame([(1, *suggestion)], "rep_id long, suggested_family string, basis string, note string"), records, rules).collect()
    assert len(got) == 1
    return got[0]


DRUG = {"dosage_form": "tablet", "strength": "5mg; 1 g", "pack_unit": "tab"}
SAID = ("AMLO", "name", "itemSeq=77&x")
RECORD = (77, "NOVA TAB (amlodipine) 100ea", "u", "X;AMLO", "1g;5 MG;9mg")


@pytest.mark.parametrize(("work", "suggestion", "official", "state", "reason"), [
    (DRUG, SAID, RECORD, "approved_item", "official_name_family_and_strengths"),
    (DRUG, SAID, (*RECORD[:4], "5mg"), "candidate_complete", "strength_not_verified"),
    (DRUG, SAID, (77, "Nova cap", "u", "AML", "1g;5mg"), "candidate_complete", "name_differs;family_not_verified"),
    (DRUG, SAID, None, "candidate_complete", "name_differs;family_not_verified;strength_not_verified"),
    (DRUG | {"candidate_status": "candidate_conflict"}, SAID, RECORD, "conflict", "group_or_family_conflict"),
    (DRUG | {"group": None}, SAID, RECORD, "conflict", "group_or_family_conflict"),
    (DRUG | {"pack_unit": "odd"}, SAID, RECORD, "candidate_family", "details_missing"),
    ({"group": "MED_ORAL"}, ("UNSPECIFIED_ITEM", "x", ""), None, "group_only", "only_the_group_is_known"),
    ({"group": "UNCLASSIFIED"}, ("", "", ""), None, "unresolved", "family_not_identified"),
    ({"family": "SYRINGE", "group": "MED_SUPPLY", "subtype": "S", "specification": "5mL", "unit": "EA"}, ("OTHER", "x", ""), None, "approved_family", "family_specification_and_unit_fit_the_rule"),
    ({"family": "SYRINGE", "group": "MED_SUPPLY", "subtype": "S", "specification": "big", "unit": "EA"}, ("OTHER", "x", ""), None, "candidate_complete", "no_official_record"),
])
def test_states_and_reasons(spark, work, suggestion, official, state, reason):
    got = decided(spark, work, suggestion, official)
    assert (got.state, got.reason) == (state, reason)
    assert (got.action != "") == state.startswith("approved") and got.confidence == {"approved_item": 1.0, "approved_family": 0.97}.get(state, 0.6)


def test_every_state_is_met_and_doubled_sources_raise(spark):
    states = {r.state for r in QUERIES["cls_representatives"](spark, "/root/testdata/sf0.01").select("state").distinct().collect()}
    assert states == {"approved_item", "approved_family", "conflict", "group_only", "unresolved", "candidate_complete", "candidate_family"}
    with pytest.raises(ValueError, match="seq 7 stands in 2"):
        op.one_row_each(spark.createDataFrame([(7,), (7,), (8,)], "seq long"), "seq", "official")


def test_a_rule_row_changes_the_result_without_code(spark):
    rows = spark.createDataFrame([(1, "F1", "C1", None), (2, "F2", "C1", "A"), (3, "", "", ""), (4, "F4", None, "A")], "id int, family string, cluster string, area string")
    told = lambda rules: {r.id: (r.material_codes, r.mapping_basis, r.promoted) for r in op.resolved_codes(rows, "id", ["family", "cluster", "area"], spark.createDataFrame(rules, pl.RULE_TYPES), ["GEN"]).collect()}
    rules = [(3, "cluster", "C1", "GEN; {family};BASE;GEN", "cluster", 0.9, False, False), (5, "area", "*", "AREA_{area}", "area", 0.2, False, False)]
    assert told(rules) == {1: ("GEN;F1;BASE", "cluster", False), 2: ("GEN;F2;BASE", "cluster", False), 3: ("", "unmapped", False), 4: ("AREA_A", "area", False)}
    assert told([*rules, (1, "family", "F2", "OWN", "override", 1.0, False, False)])[2] == ("OWN", "override", False)
    assert told([*rules, (1, "family", "F1", "", "sentinel", 0.0, True, False)])[1] == ("", "blocked", False)
    assert told([*rules, (1, "family", "F1", "X;Y", "p", 1.0, False, True), (9, "family", "*", "LATE", "p", 1.0, False, True)]) == {1: ("X;Y;F1;BASE", "cluster", True), 2: ("LATE;F2;BASE", "cluster", True), 3: ("", "unmapped", False), 4: ("AREA_A", "area", False)}
    assert told([*rules, (1, "family", "F1", "", "skip", 0.0, True, True), (9, "family", "*", "LATE", "p", 1.0, False, True)])[1] == ("GEN;F1;BASE", "cluster", False)


def test_gates_in_strict_and_lenient_mode(spark):
    columns = "key long, family string, subtype string"
    strict_rows = spark.createDataFrame([(1, "A", "x"), (2, "A", "y"), (2, "A", "y")], columns)
    bulk = spark.createDataFrame([(1, "B", "x"), (3, "B", "x"), (4, "C", "x"), (5, "D", "x"), (6, "A", "x"), (6, "B", "x"), (None, "A", "x")], columns)
    taxonomy = spark.createDataFrame([("A", "x", "G1"), ("A", "y", "G1"), ("B", "x", "G2"), ("B", "x", "G2"), ("D", "x", "G1"), ("D", "x", "G2")], "family string, subtype string, `group` string")
    facts = spark.createDataFrame([(k, n) for k in (1, 1, 2, 3, 4, 9) for n in "ab"], "key long, n string")
    good, failures = op.reconciled(strict_rows, bulk, "key", ["family", "subtype"], taxonomy, facts, strict=False)
    assert sorted(tuple(r) for r in good.collect()) == [(1, "A", "x", "G1", True), (2, "A", "y", "G1", True), (3, "B", "x", "G2", False)]
    assert {(r["kind"], r.n, r.examples) for r in failures.collect()} == {("doubled_key", 1, "6"), ("unknown_taxonomy", 1, "4"), ("ambiguous_taxonomy", 1, "5"), ("unmatched_fact", 2, "4;9")}
    with pytest.raises(ValueError, match="ambiguous_taxonomy: 1, such as 5; doubled_key: 1, such as 6; unknown_taxonomy: 1, such as 4; unmatched_fact: 2, such as 4;9"):
        op.reconciled(strict_rows, bulk, "key", ["family", "subtype"], taxonomy, facts)
    ok, none = op.reconciled(strict_rows, bulk.where("key in (1, 3)"), "key", ["family", "subtype"], taxonomy, facts.where("key <= 3"))
    assert none.count() == 0 and op.attached(facts.where("key <= 3"), ok, "key").count() == 8
    with pytest.raises(ValueError, match="stands in 2"):
        op.attached(facts, ok.unionByName(ok), "key")
    assert ok.where(F.col("key") == 1).first()["family"] == "A"
