"""Rolling-origin training: every variant of a model is fitted anew for each fold and scored on months it hasn't seen.

A fold learns from rows whose target month lies before the fold's first month, which is checked on the rows. Imputation medians and category
codes are learnt in the fold, columns that the fold has no value of are left out, and a variant whose signal block is all zero
in the fold's training rows is recorded as skipped: validation rows never decide that. Predictions of all folds are written and pooled
before they are judged, so that a fold counts by its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.sources import stored


class Fold(NamedTuple):
    """Months are scored from first to before last; first and last are dates."""

    name: str
    first: str
    last: str


class Variant(NamedTuple):
    """A model: how to make its estimator, and which signal blocks it reads besides the common columns."""

    name: str
    estimator: Callable[[], object]
    blocks: tuple[str, ...] = ()


class Columns(NamedTuple):
    """What the rows are made of. blocks: signal columns by name of the block."""

    ids: Sequence[str]
    month: str
    target: str
    numbers: Sequence[str]
    categories: Sequence[str] = ()
    blocks: Mapping[str, Sequence[str]] = {}

    def of(self, variant: Variant) -> list[str]:
        return [*self.numbers, *(c for b in variant.blocks for c in self.blocks[b])]


def in_training(c: Columns, fold: Fold) -> Column:
    """Rows whose target month is over when the fold begins."""
    return F.add_months(c.month, 1) < F.lit(fold.first).cast("date")


def in_fold(c: Columns, fold: Fold) -> Column:
    return (F.col(c.month) >= F.lit(fold.first).cast("date")) & (F.col(c.month) < F.lit(fold.last).cast("date"))


def fold_report(rows: DataFrame, c: Columns, folds: Sequence[Fold], historical_before: str, historical_weight: float) -> DataFrame:
    """A row per fold, from one pass: training rows, historical ones among them (none at weight 0), rows to score, the last month learnt from, rows in each block that have a signal, and values in each column."""
    dealt = rows.withColumn("fold", F.explode(F.array(*(F.struct(F.lit(f.name).alias("name"), in_training(c, f).alias("train"), in_fold(c, f).alias("held")) for f in folds))))
    old = F.col(c.month) < F.lit(historical_before).cast("date")
    train = F.col("fold.train") & (F.lit(historical_weight > 0) | ~old)
    signal = {b: F.greatest(F.lit(0.0), *(F.abs(F.coalesce(x, F.lit(0.0))) for x in map(F.col, cols))) > 0 for b, cols in c.blocks.items()}
    every = [*c.numbers, *(x for cols in c.blocks.values() for x in cols)]
    return dealt.groupBy("fold.name").agg(
        F.count_if(train).alias("train_rows"), F.count_if(train & old).alias("historical_rows"), F.count_if(F.col("fold.held")).alias("validation_rows"), F.max(F.when(train, F.col(c.month))).alias("learnt_until"), F.count_if(train & F.col("fold.held")).alias("overlap"),
        *(F.count_if(train & s).alias(f"signal_{b}") for b, s in signal.items()), *(F.count(F.when(train, F.col(x))).alias(f"values_{x}") for x in every),
    )


def checked(report: DataFrame, folds: Sequence[Fold]) -> dict[str, dict]:
    """fold_report's rows by fold; an empty fold or one that would learn from what it scores raises."""
    found = {r["name"]: r.asDict() for r in report.collect()}  # as many rows as folds
    for f in folds:
        r = found.get(f.name)
        if r is None or not r["train_rows"] or not r["validation_rows"]:
            raise ValueError(f"fold {f.name} is empty")
        if r["overlap"] or str(r["learnt_until"]) >= f.first:
            raise ValueError(f"fold {f.name} learns from months that it scores")
    return found


def missing(variant: Variant, c: Columns, report: Mapping) -> str | None:
    """Why a variant can't be trained in a fold."""
    unknown = [b for b in variant.blocks if b not in c.blocks]
    if unknown:
        return f"unknown block {unknown[0]}"
    silent = [b for b in variant.blocks if not report[f"signal_{b}"]]
    return f"block {silent[0]} has no signal in training rows" if silent else None


def pipeline(estimator: object, numbers: Sequence[str], categories: Sequence[str]):
    """Medians for missing numbers, codes for categories (unknown ones have a code of their own), and the estimator."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler

    stages = [Imputer(inputCols=list(numbers), outputCols=[f"{n}__i" for n in numbers], strategy="median")]
    stages += [StringIndexer(inputCol=x, outputCol=f"{x}__k", handleInvalid="keep") for x in categories]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=[*(f"{n}__i" for n in numbers), *(f"{x}__k" for x in categories)], outputCol="features"), estimator])


def cross_validated(rows: DataFrame, c: Columns, folds: Sequence[Fold], variants: Sequence[Variant], historical_before: str, historical_weight: float = 0.5) -> tuple[DataFrame | None, DataFrame]:
    """Written predictions (model, fold, ids, y, pred) of all folds, and a row per model and fold: status (ready or skipped), reason, features and rows."""
    rows = stored(rows, "training-rows")
    spark = rows.sparkSession
    report = checked(fold_report(rows, c, folds, historical_before, historical_weight), folds)
    old = F.col(c.month) < F.lit(historical_before).cast("date")
    weighed = rows.withColumn("__weight", F.when(old, historical_weight).otherwise(1.0)).where("__weight > 0")
    out, told = None, []
    for v in variants:
        reasons = [why for f in folds if (why := missing(v, c, report[f.name]))]
        for f in folds:
            r = report[f.name]
            numbers = [] if reasons else [n for n in c.of(v) if r[f"values_{n}"]]
            told.append((v.name, f.name, "skipped" if reasons else "ready", reasons[0] if reasons else None, len(numbers) + len(c.categories) if not reasons else 0, r["train_rows"], r["historical_rows"], r["validation_rows"]))
            if reasons:
                continue
            model = pipeline(v.estimator(), numbers, c.categories).fit(weighed.where(in_training(c, f)))
            scored = model.transform(rows.where(in_fold(c, f))).select(F.lit(v.name).alias("model"), F.lit(f.name).alias("fold"), *c.ids, F.col(c.target).cast("double").alias("y"), F.greatest("prediction", F.lit(0.0)).alias("pred"))
            out = scored if out is None else out.unionByName(scored)
    manifest = spark.createDataFrame(told, "model string, fold string, status string, reason string, features int, train_rows long, historical_rows long, validation_rows long")
    return (stored(out, "fold-predictions") if out is not None else None), manifest


def errors(by: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    y, p = F.col("y"), F.col("pred")
    return lambda df: df.groupBy(*by).agg(F.count("*").alias("n"), (100 * F.try_divide(F.sum(F.abs(p - y)), F.sum(F.abs(y)))).alias("wape"), F.avg(F.abs(p - y)).alias("mae"), (100 * F.try_divide(F.sum(p - y), F.sum(F.abs(y)))).alias("bias_pct"))


def selected(predictions: DataFrame, manifest: DataFrame) -> DataFrame:
    """A row per model: its pooled errors, how many folds it has and how many of them it wins, and whether it is selected (smallest pooled WAPE, then name); skipped models have the reason."""
    pooled = errors(["model"])(predictions)
    by_fold = errors(["fold", "model"])(predictions)
    wins = by_fold.groupBy("fold").agg(F.min_by("model", F.struct(F.round("wape", 6), "model")).alias("model")).groupBy("model").agg(F.count("*").alias("wins"))
    best = pooled.agg(F.min_by("model", F.struct(F.round("wape", 6), "model")).alias("best"))
    listed = manifest.groupBy("model").agg(F.max("status").alias("status"), F.max("reason").alias("reason"), F.count("*").alias("folds"))
    out = listed.join(pooled, "model", "full_outer").join(wins, "model", "left").join(F.broadcast(best), F.lit(True))  # one row
    return out.select("model", F.coalesce("status", F.lit("baseline")).alias("status"), "reason", "folds", "n", "wape", "mae", "bias_pct", F.coalesce("wins", F.lit(0)).alias("wins"), (F.col("model") == F.col("best")).alias("selected"))


def baselines(rows: DataFrame, c: Columns, folds: Sequence[Fold], predictions: Sequence[str]) -> DataFrame:
    """Predictions that the rows carry already, in the form of cross_validated's."""
    dealt = rows.withColumn("fold", F.explode(F.array(*(F.when(in_fold(c, f), F.lit(f.name)) for f in folds)))).where("fold is not null")
    models = F.explode(F.array(*(F.struct(F.lit(p.removesuffix("_pred")).alias("model"), F.col(p).cast("double").alias("pred")) for p in predictions)))
    return dealt.withColumn("m", models).select("m.model", "fold", *c.ids, F.col(c.target).cast("double").alias("y"), F.greatest("m.pred", F.lit(0.0)).alias("pred"))


def history_chosen(rows: DataFrame, c: Columns, fold: Fold, variant: Variant, weights: Sequence[float], historical_before: str) -> DataFrame:
    """The same model with each weight of historical rows (0: without them): weight, historical_rows, n, wape, and the selected one, the smallest WAPE and then the smallest weight."""
    out = None
    for w in weights:
        predictions, manifest = cross_validated(rows, c, [fold], [variant], historical_before, w)
        if predictions is None:
            raise ValueError(manifest.first()["reason"])
        one = errors([])(predictions).join(F.broadcast(manifest.select("historical_rows")), F.lit(True)).select(F.lit(float(w)).alias("weight"), "historical_rows", "n", "wape")  # a row each
        out = one if out is None else out.unionByName(one)
    out = stored(out, "history-weights")
    best = out.agg(F.min_by("weight", F.struct(F.round("wape", 6), "weight")).alias("best"))
    return out.join(F.broadcast(best), F.lit(True)).select("weight", "historical_rows", "n", "wape", (F.col("weight") == F.col("best")).alias("selected"))
