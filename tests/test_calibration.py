"""Fits, candidates and lags against plain numpy, on odd rows too."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from provisio.operators import calibration as op

SCHEMA = "a double, b double, y double, w double, part string"


def lines(x, y, w, alpha):
    mx, my = np.average(x, weights=w), np.average(y, weights=w)
    slope = max(0.0, (w * (x - mx) * (y - my)).sum() / ((w * (x - mx) ** 2).sum() + alpha))
    return my - slope * mx, slope


def made(n=60):
    g = np.random.default_rng(5)
    a, b = g.random(n).round(2), g.random(n).round(1)
    y = np.clip(0.7 * a + 0.1 * b + g.normal(0, 0.05, n), 0, 1).round(3)
    return a, b, y, g.integers(1, 5, n).astype(float), np.where(np.arange(n) < 40, "fit", "held")


def test_candidates_equal_numpy(spark):
    a, b, y, w, part = made()
    rows = [*zip(a.tolist(), b.tolist(), y.tolist(), w.tolist(), part.tolist(), strict=True), (0.5, 0.5, None, 1.0, "fit"), (0.5, 0.5, 0.1, None, "held")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    weights = {"first": {"a": 1.0, "b": 0.0}, "both": {"a": 0.5, "b": 0.5}, "none": {"a": 0.0, "b": 0.0}}
    got = {r.candidate: r for r in op.candidate_metrics(df, weights, F.col("part") == "fit", F.col("part") == "held").collect()}
    fit, held = part == "fit", part == "held"
    for name, ws in {**weights, op.CONSTANT: {"a": 0.0, "b": 0.0}}.items():
        x = ws["a"] * a + ws["b"] * b
        i, s = lines(x[fit], y[fit], w[fit], 0.1)
        assert got[name].weighted_mae == pytest.approx(np.average(np.abs(np.clip(i + s * x[held], 0, 1) - y[held]), weights=w[held]))
        assert got[name].evaluation_rows == held.sum() and got[name].slope == pytest.approx(s)
    ranks = lambda v: np.array([(v < x).sum() + (v == x).sum() / 2 for x in v])
    assert got["first"].spearman == pytest.approx(np.corrcoef(ranks(a[held]), ranks(y[held]))[0, 1])
    assert got["none"].spearman is None and got[op.CONSTANT].spearman is None
    assert op.best_candidate(op.candidate_metrics(df, weights, F.col("part") == "fit", F.col("part") == "held")) == "first"


def test_no_rows_give_no_metrics(spark):
    df = spark.createDataFrame([], SCHEMA)
    m = op.candidate_metrics(df, {"first": {"a": 1.0, "b": 0.0}}, F.col("part") == "fit", F.col("part") == "held")
    assert m.count() == 0 and op.best_candidate(m) is None
    assert op.supervised_shares(df, ["a", "b"], F.col("part") == "fit") == {"a": 0.5, "b": 0.5}


def test_shares_follow_the_slopes(spark):
    a, b, y, w, part = made()
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), y.tolist(), w.tolist(), part.tolist(), strict=True)), SCHEMA)
    slopes = [lines(x, y, w, 1.0)[1] for x in (a, b)]
    got = op.supervised_shares(df, ["a", "b"], F.lit(True))
    assert got["a"] == pytest.approx(slopes[0] / sum(slopes)) and sum(got.values()) == pytest.approx(1)
    assert op.blended({"a": 1.0, "b": 0.0}, {"a": 0.0, "b": 1.0}, 0.3) == {"a": pytest.approx(0.3), "b": pytest.approx(0.7)}


def test_history_weights_equal_numpy(spark):
    g = np.random.default_rng(3)
    x = g.random(90).round(3) * 10
    split = np.repeat(["historical", "train", "validation"], 30)
    y = np.where(split == "historical", 0.2 * x + 4, 1.5 * x + 1) + g.random(90)
    df = spark.createDataFrame([*zip(x.tolist(), y.tolist(), split.tolist(), strict=True), (None, 1.0, "train"), (1.0, None, "validation")], "x double, y double, split string")
    got = {r.weight: r for r in op.history_fit(df, "x", "y", "split", [0.0, 0.5, 1.0]).collect()}
    learn, held = split != "validation", split == "validation"
    for weight, row in got.items():
        i, s = lines(x[learn], y[learn], np.where(split == "historical", weight, 1.0)[learn], 0.0)
        assert row.slope == pytest.approx(s)
        assert row.wape == pytest.approx(100 * np.abs(np.maximum(i + s * x[held], 0) - y[held]).sum() / y[held].sum())
    assert min(got, key=lambda k: got[k].wape) == 0.0


def test_folds_learn_only_from_known_targets(spark):
    months = [f"2000-{m:02d}-01" for m in range(1, 13)]
    rows = [(m, float(k), 2.0 * k if k < 8 else 1000.0) for k, m in enumerate(months)]
    df = spark.createDataFrame(rows, "month string, x double, y double").withColumn("month", F.col("month").cast("date"))
    got = op.fold_fits(df, "month", {"line": "x"}, "y", F.lit(1.0), [("2000-10-01", "2000-12-01")]).orderBy("pred").collect()
    assert [r.pred for r in got] == [pytest.approx(18.0), pytest.approx(20.0)]  # September's target is October's value: not known yet


def test_lags_are_found(spark):
    g = np.random.default_rng(1)
    up = np.exp(np.cumsum(g.normal(0, 0.1, 40)))
    month = [f"{2000 + k // 12}-{k % 12 + 1:02d}-01" for k in range(40)]
    series = lambda name, rows: spark.createDataFrame(rows, f"{name} string, month string, value double").withColumn("month", F.col("month").cast("date"))
    u = series("upstream", [("u", m, float(v)) for m, v in zip(month, up, strict=True)])
    d = series("downstream", [("d", m, float(v)) for m, v in zip(month[3:], up[:-3], strict=True)] + [("short", month[0], 1.0), ("short", month[1], 2.0)])
    pairs = spark.createDataFrame([("u", "d", 1), ("u", "short", 0), ("u", "missing", 0)], "upstream string, downstream string, assumed_lag int")
    rows = op.paired_lags(pairs, u, d).collect()
    assert [(r.downstream, r.best_lag, r.gap, r.n) for r in rows] == [("d", 3, 2, 36)] and rows[0].r == pytest.approx(1.0)
