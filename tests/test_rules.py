"""Loads, hand-offs, weights and record rules on small fixtures; trained models against baselines."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from provisio.operators import catalog, handoff, ordered, signals
from provisio.registry import QUERIES  # before the plans, which register there

from provisio.plans import analysis as lt  # isort: skip
from provisio.plans import forecast as fo  # isort: skip

SF = "/root/testdata/sf0.001"


def test_exact_quantiles_equal_percentile(spark):
    df = spark.createDataFrame([("a", float(k * k % 17)) for k in range(40)] + [("b", 5.0), ("c", None), (None, 1.0), (None, 2.0)], "g string, v double").repartition(7)
    want = {r.g: (r.lo, r.hi) for r in df.where("v is not null").groupBy("g").agg(F.percentile("v", F.lit(0.1)).alias("lo"), F.percentile("v", F.lit(0.95)).alias("hi")).collect()}
    got = {r.g: (r.lo, r.hi) for r in ordered.quantiles(df, ["g"], "v", {"lo": 0.1, "hi": 0.95}).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
    whole = ordered.quantiles(df, [], "v", {"mid": 0.5}).first()
    assert whole.mid == df.agg(F.percentile("v", F.lit(0.5))).first()[0]
    assert [r.n for r in ordered.higher_quantiles(df, [], "v", 0.9).collect()] == [43]


def test_weights_keep_their_floor():
    assert signals.floored([1, 1, 1, 1]) == [0.25] * 4
    got = signals.floored([10, 0.001, 5, 0.0])
    assert sum(got) == pytest.approx(1) and got[1] == got[3] == 0.03 and got[0] == pytest.approx(2 * got[2])
    for raw in ([1, 2, 3, 0.1, 0.05, 40], [5.0, 5.0, 1e-9], [3, 1]):
        got, total = signals.floored(raw, 0.1), sum(raw)
        free = [k for k, w in enumerate(got) if w > 0.1 + 1e-12]
        assert abs(sum(got) - 1) < 1e-12 and min(got) >= 0.1 - 1e-12 and len({round(got[k] / raw[k] * total, 9) for k in free}) <= 1
    assert signals.floored([0, 0]) == [0.5, 0.5]


def test_cascade_order_and_negation(spark):
    texts = ["Aning, oument!", "oument only", "tible oument", "tible", None, "a baning b", "therha thoned"]
    got = signals.cascaded(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "text").orderBy("k").collect()
    assert [r.branch for r in got] == ["disease", "resin", "none", "none", "none", "none", "factory"]
    assert [r.negated for r in got] == [False, False, True, False, False, False, False]
    assert [r.severity for r in got] == [0.7, 0.4, 0.0, 0.0, 0.0, 0.0, 0.7]


def test_items_meet_by_the_first_tier(spark):
    a = spark.createDataFrame([(1, "supply_decrease", ["oument"], None, "M1"), (2, "demand_increase", ["aning"], "D1", None), (3, "conflict", ["therha"], None, None), (4, "none", ["oument"], None, "M1")], "article_id int, event_type string, cues array<string>, demand_code string, material_code string")
    i = spark.createDataFrame([("A", "oument", "M1", "D1", 0.2), ("A", "x", "M1", "D0", 0.9), ("B", "y", "M1", "D1", 0.4)], "item string, term string, material_code string, demand_code string, weight double")
    got = sorted(tuple(r) for r in signals.matched_items(a, i).collect())
    assert got == [(1, "A", "term", 0.2), (1, "B", "material", 0.4), (2, "A", "demand", 0.2), (2, "B", "demand", 0.4), (3, "SUPPLY_WIDE", "wide", 0.5)]


def test_every_record_rule_is_broken_somewhere(spark):
    found = {r.issue for r in QUERIES["rsk_issue_table"](spark, "/root/testdata/sf0.01").collect()}
    assert found >= {r for r, _, _ in signals.RULES} - {"SR010", "SR021"} and {"SR013"} <= found
    gate = QUERIES["rsk_release_gate"](spark, "/root/testdata/sf0.01").first()
    assert gate.rows == gate["pass"] + gate.review + gate.block and "SR014" in gate.dataset_issues


def test_name_rules(spark):
    names = ["waste bag 20L", "waste bag and cardboard box", "needle 18G adult", "container <=5L", "container >1,000mL", "gauze 10x20cm", "syringe 3mL 23G 5mg", "rental waste bag"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    rows = catalog.dosage_form(catalog.operational(df, "name"), "name", "item_group")
    rows = catalog.material_of(catalog.family_specification(rows.withColumn("family", catalog.first_rule(F.col("name"), catalog.FAMILIES, "OTHER")), "name", "family"), "waste_subtype")
    got = {r.name: r for r in rows.collect()}
    assert [got[n].specification for n in names] == ["20L", "", "18G_ADULT", "LE_5L", "GT_1000ML", "10X20", "23G", ""]
    assert got["waste bag 20L"].waste_subtype == "WASTE_BAG" and got["waste bag 20L"].material == "POLYETHYLENE" and got["waste bag and cardboard box"].waste_subtype == ""
    assert got["syringe 3mL 23G 5mg"].strengths == "5mg" and got["rental waste bag"].item_group == "ASSET" and got["rental waste bag"].operational_class == "rental"
    a = catalog.attributes(spark.createDataFrame([("Aspirin (salt) 10mg/5mL 23G x10ea Acme Co., Ltd.",), ("12mg",), ("plain",)], "name string"), "name").collect()
    assert (a[0].ingredient, a[0].concentration, a[0].gauge, a[0].strength, a[0].pack, a[0].leftover, a[0].readiness) == ("(salt)", "10mg/5mL", "23G", "", "x10ea", "Aspirin", "READY")
    assert [r.readiness for r in a[1:]] == ["NO_NAME", "NAME_ONLY"]
    i = catalog.ingredient(spark.createDataFrame([("Ácido fólico (5 mg)",), ("5-HT (salt)",)], "name string"), "name").collect()
    assert [(r.ingredient, r.strength, r.meta_code) for r in i] == [("Ácido fólico", "5 mg", "ACIDO_FOLICO"), ("5-HT", "", "N_5_HT")]


def test_loads_fail_loudly(spark, tmp_path):
    m = spark.createDataFrame([("k", "m", "approved", 0.5), ("k", "n", "approved", 1.5), ("z", "m", "draft", 9.0)], "key string, material string, status string, weight double")
    rules = catalog.weight_rules(weight=(0.0, 1.0, False))
    assert [tuple(r)[:2] for r in catalog.approved_load(m, "status", ["key", "material"], rules, strict=False).select("key", "material").collect()] == [("k", "m")]
    with pytest.raises(ValueError, match="weight_range"):
        catalog.approved_load(m, "status", ["key", "material"], rules)
    h = spark.createDataFrame([(1, 2.0, True, False, "A"), (2, float("nan"), True, False, "A"), (3, -1.0, True, False, "A"), (4, 1.0, False, False, "A"), (5, 1.0, True, False, "A")], "k int, v double, load_eligible boolean, needs_review boolean, demand_class string")
    t = spark.createDataFrame([(1, "x"), (2, "y")], "k int, t string")
    assert [tuple(r) for r in handoff.update_frame(h, t, "k", "t", "v", ["A"], strict=False).collect()] == [("x", 2.0, "A")]
    with pytest.raises(ValueError, match="no target for 5"):
        handoff.update_frame(h, t, "k", "t", "v", ["A"])
    with pytest.raises(ValueError, match="code"):
        handoff.registry(spark.createDataFrame([("abc", "approved", "p")], "code string, status string, provider string"), "code", "status")
    (tmp_path / "a.csv").write_bytes("이름,값\n정,1\n".encode("euc-kr"))
    (tmp_path / "b.csv").write_bytes("﻿이름,값\n정,1\n".encode())
    (tmp_path / "c.csv").write_bytes(b"PK\x03\x04 zipped")
    for name in ("a.csv", "b.csv"):
        assert [tuple(r) for r in handoff.official_csv(spark, str(tmp_path / name), ["이름"], 1).collect()] == [("정", "1")]
    for name, say in (("a.csv", "2 are wanted"), ("c.csv", "zip")):
        with pytest.raises(ValueError, match=say):
            handoff.official_csv(spark, str(tmp_path / name), ["이름"], 2)


def wape(rows, p):
    return sum(abs(r[p] - r.target_next_month) for r in rows) / sum(abs(r.target_next_month) for r in rows)


def test_trained_models(spark):
    """Non-negative predictions for exactly the validation rows, none of them in the fit, and better than the worst baseline."""
    want = {(r.year_month, r.institution_code, r.item_code): r for r in fo.labelled(spark, SF).where("split = 'validation'").collect()}
    worst = max(wape(list(want.values()), p) for p in fo.PREDS)
    frames = {n: QUERIES[n](spark, SF).collect() for n in ("for_boosted_trees", "for_tweedie", "for_batch_scoring")}
    for n, rows in frames.items():
        assert sorted((r.year_month, r.institution_code, r.item_code) for r in rows) == sorted(want)
        for p in (c for c in rows[0].asDict() if c.endswith("_pred")):
            assert all(r[p] >= 0 for r in rows) and wape(rows, p) < worst, (n, p)
    grid = QUERIES["for_hyper_grid"](spark, SF).collect()
    assert sum(r.selected for r in grid) == 1 and min(grid, key=lambda r: (r.wape, r.depth)).selected and {r.folds for r in grid} == {2}


def test_long_lead_classifier(spark):
    rows = QUERIES["lt_long_lead_classifier"](spark, "/root/testdata/sf0.01").collect()
    held = lt.leads(spark, "/root/testdata/sf0.01").where("receipt >= '1999-01-01'").count()
    assert len(rows) == held and all(0 <= r.p_long <= 1 for r in rows)
    score = sorted((r.p_long, r.label) for r in rows)
    below = pairs = ties = 0
    seen = {}
    for p, y in score:  # AUC by counting pairs
        seen.setdefault(p, [0, 0])[int(y)] += 1
    zeros = 0
    for n0, n1 in seen.values():
        below += n1 * zeros
        ties += n1 * n0
        zeros += n0
    pairs = zeros * sum(n1 for _, n1 in seen.values())
    assert pairs and 0.45 < (below + ties / 2) / pairs < 1.0
