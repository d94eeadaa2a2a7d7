"""Small fixtures with expected values, and contracts that must fail."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from provisio import sources as src
from provisio.functions import geometric_mean, read_year_month, safe_divide, split_codes
from provisio.operators import analysis, contracts, features, inventory, ledger
from provisio.operators import items as it


def test_ledger_month(spark):
    cols = "institution_code string, department string, item_code string, item_name string, closing_date string, opening_stock string, closing_stock string, unit_price string, purchase_in_qty string, transfer_in_qty string, return_in_qty string, transfer_out_qty string, consumption_qty string, return_out_qty string, disposal_qty string, auto_disposal_adjustment_qty string, correction_out_qty string"
    raw = [("A", "d", "i", "x \n y", day, o, c, "", "0", "0", "0", "0", q, "0", "0", "0", "0") for day, o, c, q in (("20240101", "10", "8", "2"), ("20240131", "8", "5", "3"), ("20240229", "5", "4", "1"), ("bad", "1", "1", "1"))]
    rows = ledger.flagged(ledger.normalized(spark.createDataFrame(raw, cols)).withColumn("k", F.lit(1)))
    got = {r.year_month: r for r in ledger.derived(ledger.monthly(rows, ["year_month", "institution_code", "department", "item_code"], ["closing_date", "k"])).collect()}
    jan = got[dt.date(2024, 1, 1)]
    assert (jan.month_start_stock, jan.month_end_stock, jan.consumption_qty, jan.outbound_squared_sum, jan.average_stock, jan.balance_violation_count) == (10, 5, 5, 13, 6.5, 0)
    assert len(got) == 2 and jan.item_name == "x y"


def test_missing_month_resets_history(spark):
    months = [(dt.date(2024, 1, 1), 5.0), (dt.date(2024, 2, 1), 7.0), (dt.date(2024, 4, 1), 9.0), (dt.date(2024, 5, 1), -1.0)]
    df = spark.createDataFrame([("a", m, q) for m, q in months], "item_code string, year_month date, consumption_qty double")
    t = features.target(features.rolling(features.segments(features.demand(df), ["item_code"]), ["item_code"]), ["item_code"])
    got = [(r.segment, r.history_months, r.rolling_mean_3, r.target_next_month) for r in t.orderBy("year_month").collect()]
    assert got == [(1, 1, 5.0, 7.0), (1, 2, 6.0, None), (2, 1, 9.0, None), (2, 2, 9.0, None)]


def test_spells(spark):
    d = [("a", dt.date(2024, 1, 1), 10.0, 0.0), ("a", dt.date(2024, 1, 11), 0.0, 5.0), ("a", dt.date(2024, 1, 21), 5.0, 0.0)]
    r = inventory.spells(spark.createDataFrame(d, "item_code string, closing_date date, closing_stock double, consumption_qty double"), ["item_code"], "2024-01-30").first()
    assert (r.total_days, r.zero_days, r.held_days) == (30, 10, 20)
    assert r.zero_ratio == pytest.approx(1 / 3) and r.naive_rate == pytest.approx(5 / 30) and r.available_rate == pytest.approx(5 / 20)


def test_scalars(spark):
    r = spark.range(1).select(safe_divide(F.lit(1.0), F.lit(0.0)).alias("a"), read_year_month(F.lit(202402)).alias("b"), split_codes(F.lit("x; y;;x")).alias("c"), geometric_mean([F.lit(2.0), F.lit(8.0)]).alias("d"), geometric_mean([F.lit(0.0), F.lit(8.0)]).alias("e"), it.clean_name(F.lit("Ａ　b\n c")).alias("f")).first()
    assert (r.a, r.b, r.c, r.e, r.f) == (0.0, dt.date(2024, 2, 1), ["x", "y"], 0.0, "A b c") and r.d == pytest.approx(4.0)


def test_contracts_fail(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, " ")], "k int, v string")
    with pytest.raises(ValueError, match="not unique"):
        contracts.unique(df, ["k"])
    with pytest.raises(ValueError, match="blank"):
        contracts.filled(df, ["v"])
    with pytest.raises(ValueError, match="missing columns"):
        contracts.required(df, ["x"])
    with pytest.raises(ValueError, match="no mapping"):
        contracts.mapped(df, spark.createDataFrame([(1, "x")], "k int, w string"), "k", "w")
    with pytest.raises(ValueError, match="not unique"):
        contracts.joined(df, df.withColumnRenamed("v", "w"), ["k"])


def test_guarded_write(spark):
    path = src.new_path(spark, "guard")
    df = spark.range(3)
    src.guarded_write(df, path)
    with pytest.raises(ValueError, match="no rows"):
        src.guarded_write(df.where("id > 9"), path)
    assert spark.read.parquet(path).count() == 3


def test_signal_gate(spark):
    df = spark.createDataFrame([("train", 0.0), ("train", 1.0), ("test", 1.0)], "s string, news_risk double")
    found = features.coverage(df, ["news_risk"], F.col("s"))
    features.enforce_coverage(found, ["news_risk"], 0.5)
    with pytest.raises(ValueError, match="coverage"):
        features.enforce_coverage(found, ["news_risk"], 0.9)


def test_average_rank(spark):
    got = [r.rank_share for r in analysis.average_rank(spark.createDataFrame([(1,), (2,), (2,), (3,)], "v int"), "v").orderBy("v").collect()]
    assert got == [0.25, 0.625, 0.625, 1.0]
