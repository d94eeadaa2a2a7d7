"""Rolling-origin training: no fold learns from what it scores, and the selection is what SQL says of the written predictions."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from provisio.registry import QUERIES  # isort: skip  (plans are imported through it)
from provisio.operators import training as op
from provisio.plans import training as tr

SF = "/root/testdata/sf0.001"


class Constant:
    """Stands for an estimator: Spark's linear regression, which is fast."""

    @staticmethod
    def make():
        from pyspark.ml.regression import LinearRegression

        return LinearRegression(labelCol="y0", weightCol="__weight", regParam=0.1)


COLUMNS = op.Columns(["k", "month"], "month", "y0", ["a", "empty_first"], ["kind"], {"news": ["n1", "n2"], "silent": ["s"]})
FOLDS = [op.Fold("one", "2020-05-01", "2020-07-01"), op.Fold("two", "2020-07-01", "2020-09-01")]


@pytest.fixture(scope="module")
def rows(spark):
    made = [(k, f"2020-{m:02d}-01", float(3 * k + m), float(k), float(m) if m >= 5 else None, "old" if k % 2 else "new", float(m == 1), 0.0, 0.0 if m < 5 else 9.0) for k in range(12) for m in range(1, 10)]
    df = spark.createDataFrame(made, "k int, month string, y0 double, a double, empty_first double, kind string, n1 double, n2 double, s double")
    return df.withColumn("month", F.col("month").cast("date"))


def test_folds_learn_only_from_targets_known_before(rows):
    report = op.checked(op.fold_report(rows, COLUMNS, FOLDS, "2020-02-01", 0.5), FOLDS)
    assert (report["one"]["train_rows"], report["one"]["historical_rows"], report["one"]["validation_rows"], str(report["one"]["learnt_until"])) == (36, 12, 24, "2020-03-01")
    assert (report["two"]["train_rows"], report["two"]["values_empty_first"]) == (60, 12)
    assert op.checked(op.fold_report(rows, COLUMNS, FOLDS, "2020-02-01", 0.0), FOLDS)["one"]["historical_rows"] == 0
    for bad in (op.Fold("late", "2021-01-01", "2021-03-01"), op.Fold("early", "2020-01-01", "2020-02-01")):
        with pytest.raises(ValueError, match="empty"):
            op.checked(op.fold_report(rows, COLUMNS, [bad], "2020-02-01", 1.0), [bad])


def test_a_signal_that_only_validation_rows_have_skips_the_variant(rows):
    variants = [op.Variant("plain", Constant.make), op.Variant("news", Constant.make, ("news",)), op.Variant("silent", Constant.make, ("silent",))]
    predictions, manifest = op.cross_validated(rows, COLUMNS, FOLDS, variants, "2020-02-01")
    told = {(r.model, r.fold): r for r in manifest.collect()}
    assert told["silent", "two"].status == "skipped" and "silent" in told["silent", "two"].reason  # its first fold has no signal
    assert told["plain", "one"].features == 2 and told["plain", "two"].features == 3  # a column without values in the fold is left out
    held = {(r.model, r.fold, r.k, r.month) for r in predictions.collect()}
    want = {(m, f.name, r.k, r.month) for m in ("plain", "news") for f in FOLDS for r in rows.collect() if f.first <= str(r.month) < f.last}
    assert held == want and predictions.where("pred < 0").count() == 0


def test_pooled_errors_and_selection_equal_sql(spark, rows):
    predictions, manifest = op.cross_validated(rows, COLUMNS, FOLDS, [op.Variant("plain", Constant.make), op.Variant("news", Constant.make, ("news",)), op.Variant("silent", Constant.make, ("silent",))], "2020-02-01")
    carried = op.baselines(rows.withColumn("a_pred", F.col("a") * 3), COLUMNS, FOLDS, ["a_pred"])
    got = {r.model: r for r in op.selected(predictions.unionByName(carried), manifest).collect()}
    p = predictions.unionByName(carried).toPandas()  # noqa: F841
    want = duckdb.sql("""WITH m AS (SELECT model, count(*) AS n, 100 * sum(abs(pred - y)) / sum(abs(y)) AS wape FROM p GROUP BY 1), f AS (SELECT fold, model, sum(abs(pred - y)) / sum(abs(y)) AS w FROM p GROUP BY 1, 2),
      w AS (SELECT model, count(*) AS wins FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(100 * w, 6), model) = 1) GROUP BY 1)
      SELECT model, n, wape, coalesce(wins, 0), row_number() OVER (ORDER BY round(wape, 6), model) = 1 FROM m LEFT JOIN w USING (model)""").fetchall()
    assert len(want) == 3
    for model, n, wape, wins, chosen in want:
        assert (got[model].n, got[model].wins, got[model].selected) == (n, wins, chosen) and got[model].wape == pytest.approx(wape)
    assert got["silent"].status == "skipped" and got["silent"].wape is None and not got["silent"].selected and got["a"].status == "baseline"


def test_history_weights(rows):
    got = {r.weight: r for r in op.history_chosen(rows, COLUMNS, FOLDS[0], op.Variant("plain", Constant.make), [0.0, 1.0], "2020-02-01").collect()}
    assert (got[0.0].historical_rows, got[1.0].historical_rows) == (0, 12) and sum(r.selected for r in got.values()) == 1
    with pytest.raises(ValueError, match="no signal"):
        op.history_chosen(rows, COLUMNS, FOLDS[0], op.Variant("silent", Constant.make, ("silent",)), [1.0], "2020-02-01")


def test_registered_trainers(spark):
    got = {r.model: r for r in QUERIES["for_fold_training"](spark, SF).collect()}
    assert set(got) == {v.name for v in tr.VARIANTS} | set(tr.fo.SHORT)
    assert got["boosted_fused"].status == "skipped" and sum(r.selected for r in got.values()) == 1
    n = got["last_month"].n
    assert all(r.n == n for r in got.values() if r.status != "skipped") and sum(r.wins for r in got.values()) == len(tr.FOLDS)
    best = min(r.wape for m, r in got.items() if r.status == "baseline")
    assert min(r.wape for r in got.values() if r.status == "ready") < 1.15 * best
    tuned = QUERIES["for_tuned_parameters"](spark, SF).collect()
    assert len(tuned) == len(tr.GRID) + 1 and sum(r.selected for r in tuned) == 1 and {r.folds for r in tuned} == {2}
    weights = QUERIES["for_history_weight_models"](spark, SF).collect()
    assert [r.weight for r in sorted(weights)] == [0.0, 0.25, 0.5, 1.0] and sum(r.selected for r in weights) == 1
