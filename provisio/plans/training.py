"""Rolling-origin training on the nation x brand series: variants by signal block, a grid of parameters, weights of the history."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from provisio.operators import features as fop
from provisio.operators import training as op
from provisio.plans import features as fea
from provisio.plans import forecast as fo
from provisio.registry import query

FOLDS = [op.Fold(f"F{k + 1}", a, z) for k, (a, z) in enumerate(fo.FOLDS[1:])]
BLOCKS = {"news": ["news_risk"], "commodity": ["commodity_risk"], "fused": ["fused_risk"]}
COLUMNS = op.Columns(fea.IDS, "year_month", "target_next_month", fo.NUMBERS, ["item_code"], BLOCKS)
HISTORY = "1998-01-01"


def boosted(depth: int = 3, trees: int = 4, step: float = 0.3):
    def make():
        from pyspark.ml.regression import GBTRegressor

        return GBTRegressor(labelCol="target_next_month", weightCol="__weight", lossType="absolute", maxIter=trees, maxDepth=depth, stepSize=step, maxBins=64, seed=1)

    return make


def tweedie():
    from pyspark.ml.regression import GeneralizedLinearRegression

    return GeneralizedLinearRegression(labelCol="target_next_month", weightCol="__weight", family="tweedie", variancePower=1.3, linkPower=0.0, maxIter=10, regParam=0.01)


VARIANTS = [op.Variant("boosted", boosted()), op.Variant("boosted_news", boosted(), ("news",)), op.Variant("boosted_commodity", boosted(), ("commodity",)), op.Variant("boosted_all", boosted(), ("news", "commodity")), op.Variant("boosted_fused", boosted(), ("fused",)), op.Variant("tweedie", tweedie)]


def rows(spark, sf):
    """Labelled rows up to the validation's end, with the signals of their months."""
    base = fo.labelled(spark, sf).where("split <> 'test'")
    joined = fop.with_external(base, fea.risk(spark, sf), ["year_month", "stock_item_key"], [c for cols in BLOCKS.values() for c in cols], 0.0)
    return joined.select(*fea.IDS, "target_next_month", *(F.col(c).cast("double").alias(c) for c in (*fo.NUMBERS, *(c for cols in BLOCKS.values() for c in cols))), *fo.PREDS)


_FOLD_SQL = ", ".join(f"('{f.name}', DATE '{f.first}', DATE '{f.last}')" for f in FOLDS)


@query("for_fold_rows", f"""WITH {fo.BASE}, {fea.RISK}, r AS (SELECT b.*, coalesce(news_risk, 0) AS news, coalesce(commodity_risk, 0) AS commodity FROM base b LEFT JOIN risk USING (year_month, stock_item_key) WHERE target_next_month IS NOT NULL AND split <> 'test'),
f AS (SELECT * FROM (VALUES {_FOLD_SQL}) v(name, a, z)), d AS (SELECT name, r.*, (year_month + INTERVAL 1 MONTH)::DATE < a AS train, year_month >= a AND year_month < z AS held FROM r, f)
SELECT name, count(*) FILTER (WHERE train) AS train_rows, count(*) FILTER (WHERE train AND year_month < DATE '{HISTORY}') AS historical_rows, count(*) FILTER (WHERE held) AS validation_rows, max(year_month) FILTER (WHERE train) AS learnt_until, count(*) FILTER (WHERE train AND held) AS overlap,
  count(*) FILTER (WHERE train AND news > 0) AS signal_news, count(*) FILTER (WHERE train AND commodity > 0) AS signal_commodity, 0::BIGINT AS signal_fused, count(rolling_mean_6) FILTER (WHERE train) AS values_rolling_mean_6 FROM d GROUP BY 1""")
def for_fold_rows(spark, sf):
    """What each fold learns from and scores, before anything is trained."""
    report = op.fold_report(rows(spark, sf), COLUMNS, FOLDS, HISTORY, 0.5)
    return report.select("name", "train_rows", "historical_rows", "validation_rows", "learnt_until", "overlap", *(f"signal_{k}" for k in BLOCKS), "values_rolling_mean_6")


@query("for_fold_training")
def for_fold_training(spark, sf):
    """Every variant and baseline over all folds, pooled, with the selected one and the skipped."""
    data = rows(spark, sf)
    predictions, manifest = op.cross_validated(data, COLUMNS, FOLDS, VARIANTS, HISTORY)
    return op.selected(predictions.unionByName(op.baselines(data, COLUMNS, FOLDS, fo.PREDS)), manifest)


GRID = [{"depth": d, "trees": t, "step": s} for d, t, s in product((2, 4), (3,), (0.1, 0.4))]


@query("for_tuned_parameters")
def for_tuned(spark, sf):
    """The parameters in use beside a grid of others, under the same folds."""
    tried = [op.Variant("in_use", boosted()), *(op.Variant("depth={depth} trees={trees} step={step}".format(**g), boosted(**g)) for g in GRID)]
    return op.selected(*op.cross_validated(rows(spark, sf), COLUMNS, FOLDS[:2], tried, HISTORY))


@query("for_history_weight_models")
def for_history_models(spark, sf):
    """The boosted model with each weight of the months before the training window."""
    return op.history_chosen(rows(spark, sf), COLUMNS, FOLDS[-1], VARIANTS[0], [0.0, 0.25, 0.5, 1.0], HISTORY)
