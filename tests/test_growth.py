"""Results that must not hang on the order of rows, and steps that must not be made again for each reader."""

from __future__ import annotations

import datetime as dt

import pytest

from provisio import registry
from provisio.operators import analysis, items, resolution
from provisio.plans import calibration, risk, signals

SF = "/root/testdata/sf0.001"


def test_equal_sums_tie_whatever_the_order_of_addition(spark):
    rows = [(2, 0.1), (2, 0.2), (2, 0.3), (1, 0.3), (1, 0.2), (1, 0.1)]  # as doubles 0.6000000000000001 and 0.6
    got = analysis.abc(spark.createDataFrame(rows, "k int, v double").coalesce(1), "k", "v").orderBy("rank").collect()
    assert [(r.k, r.v, r.share, r.rank, r.abc) for r in got] == [(1, 0.6, 0.5, 1, "A"), (2, 0.6, 1.0, 2, "C")]


@pytest.mark.parametrize("made", [risk.trade, risk.totals, signals.ten, calibration.calibration_rows])
def test_trade_reads_stored_flows_only(spark, made):
    assert not [f for f in made(spark, SF).inputFiles() if "lineitem" in f]


def test_flows_are_summed_by_month_code_and_country(spark):
    cols = "month date, hs_code string, country_code string, import_value double, import_weight double, export_value double, export_weight double"
    day = dt.date(2024, 1, 1)
    raw = spark.createDataFrame([(day, "a", "1", 10.0, 2.0, 1.0, 1.0), (day, "a", "1", 5.0, 1.0, 0.0, 0.0), (day, "a", "2", 5.0, 2.0, 0.0, None), (day, "b", None, 1.0, 1.0, 0.0, 0.0)], cols)
    summed = risk.op.country_flows(raw)
    assert summed.count() == 3
    get = lambda f: sorted((r.hs_code, r.top1, r.suppliers, r.coverage, t.import_weight, t.export_weight) for r in risk.op.concentration(f, risk.op.trade_totals(f)).collect() for t in risk.op.trade_totals(f).collect() if t.hs_code == r.hs_code)
    assert get(summed) == get(raw) == [("a", 0.75, 2, 1.0, 5.0, 1.0), ("b", 1.0, 1, 1.0, 1.0, 0.0)]


def test_overlap_counts_an_item_once_however_many_codes_and_rows_it_has(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (1, ["b", "c"]), (2, ["a", "b"]), (3, ["b", "a"]), (4, ["z"])], "item int, codes array<string>")
    owners = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "a"), ("y", "c"), ("w", "q")], "owner string, code string")
    assert {r.owner: r.n for r in items.code_overlap(rows, "item", owners, "owner").collect()} == {"x": 3, "y": 1}


def test_rules_meet_values_not_keys(spark):
    rows = spark.createDataFrame([(1, "A"), (1, "B"), (2, " "), (3, None)], "id int, family string")
    rules = spark.createDataFrame([(1, "family", "A", "X", "own", 0.9, False, False), (2, "family", "*", "{family}", "any", 0.5, False, False)], "level int, field string, value string, codes string, basis string, confidence double, blocks boolean, promotes boolean")
    got = resolution.resolved_codes(rows, "id", ["family"], rules).collect()
    assert sorted((r.id, r.family or "", r.material_codes, r.mapping_basis) for r in got) == [(1, "A", "X", "own"), (1, "B", "B", "any"), (2, " ", "", "unmapped"), (3, "", "", "unmapped")]


@pytest.mark.parametrize("name", ["cls_local_rollup", "lt_split_half", "lt_long_lead_classifier", "for_hyper_grid"])
def test_what_is_read_often_is_written_once(spark, name):
    assert not [f for f in registry.QUERIES[name](spark, SF).inputFiles() if "lineitem" in f]
