"""The report of a run: counts, silence, versions and states."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from provisio.operators import runreport as op


def test_parts_and_states(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.0, "v2"), ("a", 0.0, None, "v1"), (None, -1.0, 0.0, None), ("b", None, 0.0, "v2")], "k string, x double, y double, v string")
    steps = [("t_rows = 0", "none"), ("t_silent <> ''", "review")]
    parts = lambda df: [op.section("t", df, "k", {"up": F.col("x") > 0, "known": F.col("x").isNotNull()}), op.spoken("t", df, ["x", "y"]), op.versions("t", df, "v")]
    r = op.report(parts(rows), steps).first()
    assert (r.t_rows, r.t_items, r.t_up, r.t_known, r.t_silent, r.t_versions, r.run_state) == (4, 2, 1, 3, "y", "v1;v2", "review")
    r = op.report(parts(rows.where("false")), steps).first()
    assert (r.t_rows, r.t_items, r.t_up, r.t_silent, r.t_versions, r.run_state) == (0, 0, 0, "x;y", "", "none")
    assert op.report(parts(rows.withColumn("y", F.lit(2.0))), steps).first().run_state == "released"
    with pytest.raises(ValueError, match="columns of several parts: .'t_versions'"):
        op.report([*parts(rows), op.versions("t", rows, "v")], steps)
