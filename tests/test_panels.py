"""Requests from JSON lines, their lead times, and price panels."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from provisio.registry import QUERIES  # isort: skip  (plans are imported through it)
from provisio.operators import handoff
from provisio.operators import panels as op
from provisio.sources import requests as rq

SF = "/root/testdata/sf0.01"


def landed(spark, folder, lines):
    (folder / "a.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines), encoding="utf-8")
    return {r.no: r for r in rq.read(spark, str(folder), "no", "got", "due", ["kind", "absent"]).collect()}


def test_requests_are_read_whatever_a_line_holds(spark, tmp_path):
    got = landed(spark, tmp_path, [
        {"no": "1", "got": "2024-01-05", "due": "2024-02-04", "kind": "x", "more": {"a": [1]}}, {"no": "1", "got": "20240101", "due": "2024-01-31 10:00:00", "kind": "--"}, {"no": "1", "got": None, "due": "2024-01-02"},
        '{"no": "2", "got": "2024-01', "", "[1, 2]", "words", {"no": "3", "got": "2024/01/01", "due": "--"}, {"no": "4", "got": "2024-01-01", "due": "2023-12-31"}, {"no": "5", "got": "2024-01-01", "due": "2024-12-31"},
        {"no": "6", "got": "2024-01-01", "due": "2025-01-01"}, {"no": " 7 ", "got": "2024-02-30", "due": "2024-03-01"}, {"no": "--", "got": "2024-01-01", "due": "2024-01-01"}, {"got": "2024-01-02", "due": "2024-01-05"},
    ])
    assert set(got) == {"1", "5", None}
    assert (got["1"].receipt, got["1"].lead_days, got["1"].kind, got["1"].absent) == (dt.date(2024, 1, 1), 30, None, None)
    assert got["5"].lead_days == 365 and got[None].lead_days == 0


def test_no_file_of_requests_and_one_request(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("")
    rows = rq.read(spark, str(tmp_path), "no", "got", "due")
    assert rows.count() == 0 and rq.distribution(rows, ["no"]).count() == 0
    one = spark.createDataFrame([("a", 5), ("b", None)], "k string, lead_days int")
    assert [tuple(r) for r in rq.distribution(one, ["k"]).collect()] == [("a", 1, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0, None)]


def test_distribution_equals_that_of_all_rows(spark):
    lead = np.random.default_rng(3).integers(0, 366, 5_000)
    rows = spark.createDataFrame([(int(v),) for v in lead], "lead_days int")
    r = rq.distribution(rows).first()
    assert np.allclose([r.p10, r.p25, r.median, r.p75, r.p90, r.mean_days, r.sd_days], [*np.quantile(lead, [0.1, 0.25, 0.5, 0.75, 0.9]), lead.mean(), lead.std(ddof=1)])
    same = rq.distribution(spark.createDataFrame([(7,)] * 9, "lead_days int")).first()
    assert (same.n, same.median, same.sd_days) == (9, 7.0, 0.0)


def test_unit_values_are_means_of_good_flows(spark):
    rows = [("m1", "a", "10", 1.0), ("m1", "a", "10", 3.0), ("m1", "a", "0", 9.0), ("m1", "a", "-1", 9.0), ("m1", "a", "x", 9.0), ("m1", "a", None, 9.0), ("m1", "a", "NaN", 9.0), ("m1", "a", "Infinity", 9.0), ("m1", "b", "5", 0.0), (None, "a", "5", 1.0), ("m2", None, "5", 1.0), ("m2", "b", "4", 2.0)]
    got = op.unit_values(spark.createDataFrame(rows, "m string, c string, w string, v double"), "m", "c", "w", "v")
    assert {(r.month, r.code): r.price for r in got.collect()} == {("m1", "a"): 200.0, ("m2", "b"): 500.0}
    rows = {r.month: (r.a, r.z) for r in op.wide(got, ["a", "z"]).collect()}
    assert rows == {"m1": (200.0, None), "m2": (None, None)}
    for codes in (["a", "a"], [str(i) for i in range(1001)]):
        with pytest.raises(ValueError, match="codes repeat"):
            op.wide(got, codes)


def test_quotes_without_a_date_factor_or_price_are_left_out(spark):
    rows = [("2024-01-05", "f", "2"), ("2024-01-31", "f", "4"), ("no", "f", "4"), ("2024-01-01", None, "4"), ("2024-01-01", "f", "."), (None, "f", "1"), ("2024-02-01", "g", "-1.5")]
    got = op.quoted_means(spark.createDataFrame(rows, "d string, f string, p string"), "d", "f", "p").collect()
    assert {(r.month, r.code): r.price for r in got} == {("2024-01", "f"): 3.0, ("2024-02", "g"): -1.5}


def test_tables_hold_what_is_left_out(spark):
    read = QUERIES["src_procurement_requests"](spark, SF)
    assert 0 < read.count() < spark.read.parquet(f"{SF}/orders.parquet").count()
    assert read.agg(F.count_if(F.col("kind") == "again")).first()[0] > 0 and read.where("request IS NULL").count() <= 1


@pytest.mark.parametrize(("url", "is_fresh"), [
    ("http://a.example/2019/x/2024/1", True), ("http://a.example/2019/x/1", False), ("http://a.example/2022/x", False), ("http://a.example/2022-05/2023.html", True), ("http://a.example/120223/2022", False),
    ("http://2024.example/2021/", False), ("http://a.example/2021?y=2024", False), ("http://a.example?y=2001", True), ("http://a.example/x", True), ("", True), (None, True), ("/2021/x", True),
])
def test_the_greatest_year_of_a_path_decides(spark, url, is_fresh):
    year = F.lit("2024-06-01").cast("date")
    assert spark.createDataFrame([(url,)], "url string").select(handoff.fresh(F.col("url"), year)).first()[0] == is_fresh


def test_every_part_of_a_table_is_checked_for_its_kind(spark, tmp_path):
    (tmp_path / "part-0.csv").write_text("name,v\na,1\n")
    (tmp_path / "part-1.csv").write_bytes(b"PK\x03\x04 zipped")
    with pytest.raises(ValueError, match="part-1.csv of .* is a zip"):
        handoff.official_csv(spark, str(tmp_path), ["name"], 1)
