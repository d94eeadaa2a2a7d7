"""Agreement operators on small fixtures with ties, nulls and empty tables."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from provisio.operators import agreement as op


def test_clusters_against_a_reference(spark):
    aliases = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "C"), (5, "C"), (6, "D"), (7, "E")], "k int, c string")
    reference = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, "y"), (4, "z"), (5, "z"), (6, "x"), (6, "y"), (9, "q"), (7, None)], "k int, r string")
    got = {r.k: (r.status, r.r, r.refs_of_cluster, r.clusters_of_ref, r.reason) for r in op.reference_clusters(aliases, reference, "k", "c", "r").collect()}
    assert got == {
        1: ("matched", "x", 2, 1, "over_merge"), 2: ("matched", "y", 2, 2, "over_merge_and_split"), 3: ("matched", "y", 1, 2, "over_split"), 4: ("matched", "z", 1, 1, ""), 5: ("matched", "z", 1, 1, ""),
        6: ("ambiguous_reference", None, 0, 0, ""), 7: ("missing_reference", None, 0, 0, ""), 9: ("reference_only", "q", 0, 0, ""),
    }


def test_fields_of_two_runs(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "y")], "k int, f string, g string")
    new = spark.createDataFrame([(1, "a", ""), (2, "b", "z"), (4, "c", "y")], "k int, f string, g string")
    got = {r.field: (r.matched, r.evaluated, r.found) for r in op.field_regression(old, new, "k", ["f", "g"]).collect()}
    assert got == {"f": (2, 3, 2), "g": (1, 3, 2), "all": (1, 3, 2)}
    empty = op.field_regression(old.limit(0), new, "k", ["f"]).collect()
    assert [(r.matched, r.evaluated, r.rate) for r in empty] == [(0, 0, None)] * 2


def test_normal_tail(spark):
    zs = [0.0, -0.3, 1.0, 1.959964, -3.2, 6.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(op.two_sided(F.col("z"))).collect()
    assert [r[0] for r in got] == pytest.approx([math.erfc(abs(z) / math.sqrt(2)) for z in zs], abs=2e-7)


def test_partial_correlation_equals_residuals(spark):
    g = np.random.default_rng(2)
    rows = []
    for factor in ("f", "g"):
        x, v = g.random(20), g.random(20)
        rows += [(factor, k, float(x[k]), float(v[k])) for k in range(20)]
    rows += [("few", k, 1.0, float(k)) for k in range(5)]
    got = {r.factor: r for r in op.partial_by_factor(spark.createDataFrame(rows, "factor string, month int, x double, v double"), "factor", "month", "x", "v").collect()}
    assert got.keys() == {"f", "g"}
    for factor, r in got.items():
        x, v = (np.array([row[i] for row in rows if row[0] == factor]) for i in (2, 3))
        a, now, later = x[:-1], v[:-1], v[1:]
        rest = lambda t, now=now: t - np.polyval(np.polyfit(now, t, 1), now)
        assert r.n == 19 and r.partial_r == pytest.approx(np.corrcoef(rest(a), rest(later))[0, 1])
        assert r.bonferroni_p == pytest.approx(min(2 * r.p, 1))


def test_masters_fill_only_blanks(spark):
    rows = [("product", "1", "r", "", "M"), ("product", " ", "2", "[]", "not_provided"), ("product", "3", "r", "own", None), ("attributes", "1", "r", "b", ""), ("attributes", "1", "r", "a", "N"), ("attributes", "1", "r", "a", "N"), ("attributes", None, "2", "c", "P"), ("other", "1", "r", "", "")]
    df = spark.createDataFrame(rows, "source string, code string, record string, m string, n string")
    got = sorted(tuple(r) for r in op.consolidated(df, "source", "code", "record", "product", "attributes", ["m", "n"]).collect())
    assert got == [("other", "1", "r", "", ""), ("product", " ", "2", "c", "P"), ("product", "1", "r", "a;b", "M"), ("product", "3", "r", "own", None)]


def test_axes_with_one_material(spark):
    df = spark.createDataFrame([("a", "m", 1.0), ("a", "m", 4.0), ("a", None, 2.0), ("b", "m", 1.0), ("b", "n", 2.0), ("c", None, None), (None, "m", 1.0)], "x string, m string, w double")
    got = {r.axis: (r.m, r.weight, r.n, r.status) for r in op.folded_axis(df, F.col("x"), "m", "w").collect()}
    assert got == {"a": ("m", 2.0, 3, "mapped"), "b": ("m;n", None, 2, "conflict"), "c": (None, None, 1, "unmapped")}


def test_periods_and_halves(spark):
    gaps = spark.createDataFrame([("a", g, d) for d, g in enumerate([1, 2, 3, 4, 90])] + [("b", g, d) for d, g in enumerate([10, 20, 20, 20, 30])] + [("c", 5, 1)], "k string, gap int, day int")
    got = {r.k: r for r in op.review_periods(gaps, "k", "gap").collect()}
    within, between = np.mean([np.var([1, 2, 3, 4, 90], ddof=1), 50]), np.var([3, 20], ddof=1)
    z, grand = 5 / (5 + within / between), np.median([1, 2, 3, 4, 90, 10, 20, 20, 20, 30, 5])
    assert got.keys() == {"a", "b"} and all(got[k].review_period == pytest.approx(z * m + (1 - z) * grand) for k, m in (("a", 3), ("b", 20)))
    assert {r.k: (r.early, r.late) for r in op.halves(gaps, "k", "gap", "day").collect()} == {"a": (2.0, 47.0), "b": (20.0, 25.0)}
    assert op.spearman(gaps.limit(0), "gap", "day") is None
