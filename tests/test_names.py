"""Item names: claims that don't depend on the extractors' order, wrappers to the last layer, rules as rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from provisio.operators import aliases as al
from provisio.operators import claims as cl

DICTIONARY = [("amlodipine", "AML"), ("Amlodipine Besylate", "AMLB"), ("sodium chloride", "NACL"), ("sodium", "NA"), ("sodium", "NA2"), ("", "NONE"), (None, "NULL")]
NAMES = {
    "syringe(3cc/23g*24mm/100ea)": ("needle", {"base_name": "syringe", "capacity": "3mL", "capacity_role": "instrument_capacity", "gauge": "23G", "needle_length": "24mm", "pack_quantity": "100", "pack_unit": "EA", "active_strengths": ""}),
    "syringe(3cc/23gX24mm/100ea)": ("needle", {"base_name": "syringe", "gauge": "23G", "needle_length": "24mm"}),
    "ceftriaxone inj 1G": ("medication", {"gauge": "", "active_strengths": "1g", "base_name": "ceftriaxone inj"}),
    "gauze 23g": ("supply", {"gauge": "", "active_strengths": "", "net_weight": "23g"}),
    "syrup(sodium chloride)_(3g/500mL)(Nelson Pharm(co., ltd))-500(1)mL/bottle": ("medication", {"base_name": "syrup", "ingredients": "NACL", "manufacturer": "Nelson Pharm", "concentrations": "3g/500mL", "capacity": "500mL", "pack_quantity": "1", "pack_unit": "BOTTLE", "unresolved": "", "status": "verified"}),
    "gauze 10cm*10cm 10sheet": ("supply", {"base_name": "gauze", "dimensions": "10cm x 10cm", "pack_quantity": "10", "pack_unit": "SHEET"}),
    "cream(ACME works inc)-10G(1EA)": ("topical", {"net_weight": "10g", "active_strengths": "", "pack_quantity": "1", "pack_unit": "EA", "manufacturer": "ACME works"}),
    "cream-50g/ea": ("topical", {"net_weight": "50g", "pack_quantity": "1", "pack_unit": "EA", "base_name": "cream"}),
    "cream(sodium)(0.2g/20g)-20g/ea": ("topical", {"base_name": "cream", "ingredients": "NA", "concentrations": "0.2g/20g", "active_strengths": "0.2g", "net_weight": "20g"}),
    "nova tab(amlodipine besylate)_(6.944mg/1tab)-30tab": ("medication", {"concentrations": "6.944mg/1TABLET", "active_strengths": "6.944mg", "base_name": "nova tab", "pack_quantity": "30", "pack_unit": "TABLET", "ingredients": "AMLB"}),
    "susp-15mL/sachet": ("medication", {"capacity": "15mL", "pack_quantity": "1", "pack_unit": "SACHET"}),
    "tab 500mg(metformin hydrochloride)-1tab": ("medication", {"base_name": "tab", "manufacturer": "", "ingredients": "UNMAPPED::METFORMINHYDROCHLORIDE", "reasons": "ingredient_requires_verification"}),
    "amlodipine 5mg": ("medication", {"base_name": "amlodipine", "ingredients": "AML", "active_strengths": "5mg"}),
    "amlodipined 5mg": ("medication", {"ingredients": "", "reasons": "medication_ingredient_unresolved"}),
    "pump [deep (very (deep)) note] (thing)": ("supply", {"unresolved": "thing", "notes": "deep (very (deep)) note", "status": "needs_match"}),
    "((": ("supply", {"base_name": "(("}), "": ("", {"base_name": "", "reasons": "unclassified_item_group"}), "1,000.50 ml 日本": ("supply", {"capacity": "1000.5mL", "base_name": "日本"}),
}


@pytest.fixture(scope="module")
def parsed(spark):
    names = spark.createDataFrame([(n, c) for n, (c, _) in NAMES.items()] + [(None, "supply"), ("no context", None)], "name string, context string")
    makers = spark.createDataFrame([("Acme Works Co., Ltd.",), (None,), ("  ",)], "maker string")
    return {r.name: r for r in cl.parsed(names, spark.createDataFrame(DICTIONARY, "alias string, canonical string"), makers).collect()}


@pytest.mark.parametrize("name", list(NAMES))
def test_attributes(parsed, name):
    got = parsed[name].asDict()
    assert {k: got[k] for k in NAMES[name][1]} == NAMES[name][1]


def test_nulls_and_that_claims_never_overlap(parsed):
    assert None not in parsed and parsed["no context"].reasons == "unclassified_item_group" and len(parsed) == len(NAMES) + 1
    for r in parsed.values():
        assert all(a.end <= b.start for a, b in zip(r.tokens, r.tokens[1:])) and all(0 <= t.start < t.end <= len(r.name) for t in r.tokens)


def test_the_order_of_extractors_changes_nothing(spark):
    rng, rows = random.Random(3), []
    claims = [(rng.choice([10, 20, 30]), 0, a, a + n, rng.choice("xyz"), f"v{k}", "s", 0) for k, (a, n) in enumerate((rng.randrange(30), rng.randint(1, 8)) for _ in range(14))]
    claims = [(p, a - b, a, b, *rest) for p, _, a, b, *rest in claims]
    for k in range(30):
        rows.append((k, rng.sample(claims, len(claims))))
    kind = "array<struct<priority:int,shorter:int,start:int,end:int,kind:string,value:string,source:string,score:int>>"
    got = {tuple(tuple(c) for c in r.kept) for r in spark.createDataFrame(rows, f"k int, c {kind}").select(cl.scheduled(F.col("c")).alias("kept")).collect()}
    want = []
    for c in sorted(claims):
        if all(c[3] <= k[2] or k[3] <= c[2] for k in want):
            want.append(c)
    assert got == {tuple(sorted(want, key=lambda c: c[2]))}


def test_brackets_at_any_depth(spark):
    texts = {"a(b)[c]": ["b", "c"], "((x)y)z": ["(x)y"], "(a]b)": ["a]b"], "[(])": [], ")(": [], "": [], "(a(b(c(d))))e()": ["a(b(c(d)))", ""]}
    got = {r.t: [p.inside for p in r.b] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", cl.brackets(F.col("t")).alias("b")).collect()}
    assert got == texts


def test_wrappers_to_the_last_layer_and_tags(spark):
    names = {
        "1) [visit] (free) 2-1: (*rental unit) bolt - paid (branch office)": "bolt", "(promo)": "(promo)", "bolt free rental paid visit rehab": "bolt", "bolt": "bolt", "": "", "a. b. c. bolt": "bolt", "freedom bolt": "freedom bolt",
        "[visit] [visit] [visit] [visit] [visit] [visit] [visit] nut": "nut",
    }
    rows = spark.createDataFrame([(n,) for n in names] + [(None,)], "n string").select("n", al.stripped(F.col("n")).alias("s"), al.tags(F.col("n")).alias("t")).collect()
    assert {r.n: r.s for r in rows if r.n is not None} == names
    found = {r.n: r.t for r in rows}
    assert found["bolt free rental paid visit rehab"] == ["visit", "rehab", "free", "paid", "rental"] and found["freedom bolt"] == [] and len(al.TAGS) == 11


def test_records(spark):
    rows = [("gauze 5x5 cm", "M1"), ("diesel", None), (None, "OOM1"), ("Ｈｅｒｂ　root", "x"), ("gift bed rental", ""), ("bed rental", ""), ("office mask", "z"), ("(salt) (visit) tablet 10mg 5 box 3tab", "use2")]
    got = {r.raw: r for r in al.records(spark.createDataFrame(rows, "raw string, code string")).collect()}
    assert (got["gauze 5x5 cm"].family_id, got["gauze 5x5 cm"].specification, got["gauze 5x5 cm"].status, got["gauze 5x5 cm"].forecastable) == ("MEDICAL_GAUZE", "5X5", "family_candidate", "t")
    assert (got["diesel"].group_id, got["diesel"].forecastable) == ("FUEL", "f")
    assert (got[None].cleaned_name, got[None].classification_method, got[None].classification_confidence) == ("", "code_hint:unresolved", 0.2)
    assert (got["Ｈｅｒｂ　root"].cleaned_name, got["Ｈｅｒｂ　root"].group_id) == ("Herb root", "KM_HERB")
    assert (got["gift bed rental"].group_id, got["bed rental"].group_id, got["bed rental"].intrinsic_group) == ("PROMO", "RENTAL", "UNCLASSIFIED")
    assert got["office mask"].group_id == "UNCLASSIFIED"
    tablet = got["(salt) (visit) tablet 10mg 5 box 3tab"]
    assert (tablet.dosage_form, tablet.pack_quantity, tablet.pack_unit, tablet.details, tablet.strengths) == ("tablet", "3", "tab", "salt", "10mg")
