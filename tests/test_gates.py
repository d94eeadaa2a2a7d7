"""Gates: every rule has a count and examples, headers are checked file by file, rejects are counted."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from provisio.registry import QUERIES  # isort: skip  (plans are imported through it)
from provisio.operators import gates as op

SF = "/root/testdata/sf0.01"


def test_every_record_rule_is_met_and_strict_loads_name_them(spark):
    got = {r.rule: r for r in QUERIES["itm_record_gates"](spark, SF).collect()}
    assert set(got) == {r for r, _ in op.RECORD_RULES} and len(got) == 18 and all(r.n >= len(r.examples.split(";")) > 0 for r in got.values())
    rows = spark.createDataFrame([(1, 5), (2, -1), (3, None), (4, -7)], "k int, v int")
    with pytest.raises(ValueError, match="negative: 2, such as 2;4"):
        op.gated(rows, "k", [("negative", "v < 0")])
    good, errors = op.gated(rows, "k", [("negative", "v < 0"), ("odd", "v % 2 = 1")], strict=False, examples=1)
    assert [r.k for r in good.collect()] == [3] and {(r.rule, r.n, r.examples) for r in errors.collect()} == {("negative", 2, "2"), ("odd", 1, "1")}
    assert op.gated(rows.where("k = 3"), "k", [("negative", "v < 0")])[0].count() == 1


def test_headers_are_checked_in_each_file(spark, tmp_path):
    old, new = tmp_path / "old.csv", tmp_path / "new.csv"
    old.write_text("﻿key|line\n1|2\n", encoding="utf-8")
    new.write_text('line | key|"vendor|code"\n"4\n5"|3|v\n')
    (tmp_path / "_SUCCESS").write_text("")
    rows = op.scan_by_header(spark, str(tmp_path), ["key", "line"], ["price"]).collect()
    assert {(r["key"], r["line"], r["vendor|code"], r["price"]) for r in rows} == {("1", "2", None, None), ("3", "4\n5", "v", None)}
    for text, say in (("key|line|key\n1|2|3\n", r"doubled columns \['key'\]"), ("line|other\n1|2\n", r"missing columns \['key'\]"), ("\n", "missing columns")):
        new.write_text(text)
        with pytest.raises(ValueError, match=f"new.csv: {say}"):
            op.scan_by_header(spark, str(tmp_path), ["key", "line"])
    with pytest.raises(ValueError, match="no file"):
        op.scan_by_header(spark, str(tmp_path / "none*"), ["key"])
    assert sorted(len(h) for h in op.heads(spark, str(tmp_path), 3).values()) == [1, 3]


def test_ledger_rows_and_counters(spark):
    raw = spark.createDataFrame(
        [("a", "2020-01-01", "10", "5", "2", "13", None), (" a ", "20200102", "1,000", "", "0", "1000.0000001", None), ("", "2020-01-01", "1", "1", "1", "1", None), ("b", "2020-02-30", "1", "1", "1", "1", None), ("b", "2020-02-01", "x", "1", "1", "-4", None), ("c", "2020-02-01", "-1", "1", "1", "0", None), (None, None, None, None, None, None, "ragged|row")],
        "item string, day string, prev string, got string, used string, close string, _bad string",
    )
    rows, counters = op.ledger_rows(raw, "_bad", ["item"], "day", ["prev", "got", "used", "close"], "prev", "close", ["got"], ["used"])
    assert counters.first().asDict() == {"rows": 7, "bad_cols": 1, "bad_key": 1, "bad_date": 1, "kept": 4, "bad_numbers": 1, "neg_closing": 1, "neg_prev": 1, "identity_checked": 3, "identity_bad": 1}
    assert sorted((r["item"], str(r.day), r.prev, r.close) for r in rows.collect() if r["item"] == "a") == [("a", "2020-01-01", 10.0, 13.0), ("a", "2020-01-02", 1000.0, 1000.0000001)]


def test_reference_codes_and_problems(spark):
    rows = [("  3004901000 ", "leaf", "2020-01-01", "9999-12-31"), ("3004", "head", "2020-01-01", "2020-01-01"), ("3004", "head", "2021-01-01", "2021-12-31"), ("30x", "a", "2020-01-01", "2020-01-01"), (None, "a", "2020-01-01", "2020-01-01"), ("31", "a", "x", "2020-01-01"), ("32", "a", "2020-01-02", "2020-01-01"), ("33", None, "2020-01-01", "2020-01-01"), ("34", "a", "2020-01-01", "2020-01-01"), ("34", "b", "2020-01-01", "2020-01-01")]
    good, problems = op.reference_codes(spark.createDataFrame(rows, "code string, name string, valid_from string, valid_to string"))
    assert {(r.code, r.digits, r.is_leaf) for r in good.collect()} == {("3004901000", 10, True), ("3004", 4, False)} and good.count() == 3
    assert {(r.problem, r.n) for r in problems.collect()} == {("bad_code", 2), ("bad_date", 1), ("dates_reversed", 1), ("blank_name", 1), ("doubled_code", 2)}


def test_prepared_signals(spark):
    rows = [("k", "2024-01", 1.0, 1), ("k", "202401", None, 2), ("k", "2024.01", 3.0, 0), ("k", "2024-02-15", 4.0, 0), ("k", "2024-13", 5.0, 9), ("k", None, 5.0, 9), (" ", "2024-01", 5.0, 9), (None, "2024-01", 5.0, 9), ("k", "bad", 5.0, 9)]
    got = op.prepared(spark.createDataFrame(rows, "key string, month string, risk double, n int"), ["key"], "month", {"risk": 0.25, "confidence": 0.5}, [F.col("n")])
    assert sorted((r.key, r.month, r.risk, r.confidence) for r in got.collect()) == [("k", "2024-01", 0.25, 0.5), ("k", "2024-02", 4.0, 0.5)]
