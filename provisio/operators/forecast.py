"""Baseline forecasts, accuracy, demand patterns, ensembles, buffers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provisio.functions import ladder
from provisio.operators.ordered import running
from provisio.sources import stored

BASELINES = {"last_month_pred": "demand_lag_1", "rolling_mean_3_pred": "rolling_mean_3", "rolling_median_3_pred": "rolling_median_3", "rolling_mean_6_pred": "rolling_mean_6", "same_month_last_year_pred": "demand_lag_12", "expanding_mean_pred": "expanding_mean"}
METRICS = ("n", "actual_sum", "pred_sum", "mae", "rmse", "rmsle", "mape", "smape", "wape", "bias", "bias_pct", "zero_rate")


def baselines(df: DataFrame) -> DataFrame:
    """Null falls back to the last month, then 0; never negative."""
    return df.withColumns({p: F.greatest(F.coalesce(F.col(c), F.col("demand_lag_1"), F.lit(0.0)), F.lit(0.0)) for p, c in BASELINES.items()})


def metric_columns(y: Column, p: Column) -> list[Column]:
    """Accuracy over pairs where both are known, in one pass."""
    ok = y.isNotNull() & p.isNotNull()
    y, p = F.when(ok, y), F.when(ok, p)
    e, size = p - y, F.abs(y) + F.abs(p)
    positive = lambda c: F.greatest(c, F.lit(0.0))
    return [
        F.count(y).alias("n"), F.sum(y).alias("actual_sum"), F.sum(p).alias("pred_sum"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sqrt(F.avg(F.when(ok, F.pow(F.log1p(positive(p)) - F.log1p(positive(y)), F.lit(2.0))))).alias("rmsle"), (100 * F.avg(F.when(y != 0, F.abs(e / y)))).alias("mape"),
        (100 * F.avg(F.when(size != 0, 2 * F.abs(e) / size))).alias("smape"), (100 * F.try_divide(F.sum(F.abs(e)), F.sum(F.abs(y)))).alias("wape"), F.avg(e).alias("bias"),
        (100 * F.try_divide(F.sum(e), F.sum(F.abs(y)))).alias("bias_pct"), F.avg(F.when(ok, (y == 0).cast("double"))).alias("zero_rate"),
    ]


def long_predictions(df: DataFrame, preds: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """A row per input row and model; only what metrics need is kept, so the shuffle carries partial sums."""
    return df.select(*keep, F.explode(F.array(*(F.struct(F.lit(p.removesuffix("_pred")).alias("model"), F.col(p).alias("pred")) for p in preds))).alias("x")).select(*keep, "x.*")


def report(df: DataFrame, preds: Sequence[str], actual: str, segments: Sequence[str] = ()) -> DataFrame:
    """Metrics of each model, over all rows and over each segment column's values."""
    long = long_predictions(df, preds, [actual, *segments])
    kinds = F.array(F.struct(F.lit("all").alias("segment"), F.lit("all").alias("value")), *(F.struct(F.lit(s).alias("segment"), F.col(s).cast("string").alias("value")) for s in segments))
    return long.withColumn("s", F.explode(kinds)).groupBy("model", F.col("s.segment").alias("segment"), F.col("s.value").alias("value")).agg(*metric_columns(F.col(actual), F.col("pred")))


def demand_patterns(history: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Smooth, erratic, intermittent or lumpy by interval (1.32) and squared variation (0.49) of non-zero demand."""
    v = F.col(value)
    some = F.when(v > 0, v)
    out = history.groupBy(*key).agg(F.count(v).alias("n"), F.count(some).alias("nonzero"), F.avg(some).alias("mean"), F.stddev_samp(some).alias("std"))
    out = out.withColumns({"adi": F.try_divide("n", "nonzero"), "cv2": F.pow(F.coalesce(F.try_divide("std", "mean"), F.lit(0.0)), F.lit(2.0))})
    a, c = F.col("adi"), F.col("cv2")
    pattern = ladder([(F.col("n") < 3, "insufficient"), (F.col("nonzero") == 0, "all_zero"), ((a < 1.32) & (c < 0.49), "smooth"), ((a >= 1.32) & (c < 0.49), "intermittent"), ((a < 1.32) & (c >= 0.49), "erratic")], "lumpy")
    return out.withColumn("demand_pattern", pattern)


def splits(month: str, validation_from: str, test_from: str, train_from: str) -> Column:
    m = F.col(month)
    return ladder([(m < F.lit(train_from).cast("date"), "historical"), (m < F.lit(validation_from).cast("date"), "train"), (m < F.lit(test_from).cast("date"), "validation")], "test")


def weight_grid(spark: SparkSession, names: Sequence[str], steps: int = 20) -> DataFrame:
    """All weights in multiples of 1 / steps that sum to 1; its size depends on the models, not on data."""
    grid = spark.range(steps + 1).select(F.col("id").alias(names[0]))
    for n in names[1:-1]:
        grid = grid.withColumn(n, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps).cast("long")))).where(sum((F.col(x) for x in grid.columns), F.col(n)) <= steps)
    grid = grid.withColumn(names[-1], F.lit(steps) - sum((F.col(x) for x in grid.columns), F.lit(0)))
    return grid.select(*((F.col(n) / steps).alias(n) for n in names))


def blend_scores(df: DataFrame, names: Sequence[str], actual: str, group: Sequence[str], grid: DataFrame) -> DataFrame:
    """Metrics of every grid point in every group. The grid (231 points for 3 models) travels as one array, and is summed map-side."""
    points = grid.agg(F.collect_list(F.struct(*names)).alias("g"))
    rows = df.join(F.broadcast(points), F.lit(True)).select(*group, actual, *(F.col(n).alias(f"{n}_v") for n in names), F.explode("g").alias("w"))
    pred = F.greatest(sum((F.col(f"w.{n}") * F.col(f"{n}_v") for n in names), F.lit(0.0)), F.lit(0.0))
    y = F.col(actual)
    out = rows.groupBy(*group, *(F.col(f"w.{n}").alias(n) for n in names)).agg(
        F.try_divide(100 * F.sum(F.abs(pred - y)), F.sum(F.abs(y))).alias("wape"), F.abs(F.try_divide(100 * F.sum(pred - y), F.sum(F.abs(y)))).alias("bias_size"), F.sqrt(F.avg((pred - y) * (pred - y))).alias("rmse"))
    return out


def best_blend(scores: DataFrame, names: Sequence[str], group: Sequence[str], digits: int = 6) -> DataFrame:
    """Smallest WAPE, then bias size, then RMSE, then weights."""
    w = W.partitionBy(*group).orderBy(*(F.round(c, digits).asc_nulls_last() for c in ("wape", "bias_size", "rmse")), *(F.desc(n) for n in names))
    return scores.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def apply_weights(df: DataFrame, weights: DataFrame, group: Sequence[str], names: Sequence[str], fallback: Sequence[float], into: str = "ensemble_pred") -> DataFrame:
    """Weighted sum by the group's weights, or the fallback's where a group has none."""
    w = weights.select(*group, *(F.col(n).alias(f"__w_{n}") for n in names))
    pred = sum((F.coalesce(F.col(f"__w_{n}"), F.lit(float(f))) * F.col(n) for n, f in zip(names, fallback, strict=True)), F.lit(0.0))
    return df.join(F.broadcast(w), list(group), "left").withColumn(into, F.greatest(pred, F.lit(0.0))).drop(*(f"__w_{n}" for n in names))


def batch_scored(df: DataFrame, models: dict[str, object]) -> DataFrame:
    """df with <name>_pred of each fitted model, not below 0; the models' own columns go."""
    keep = list(df.columns)
    for name, model in models.items():
        df = model.transform(df).withColumn(f"{name}_pred", F.greatest("prediction", F.lit(0.0))).select(*(keep := [*keep, f"{name}_pred"]))
    return df


def scale_band(c: Column) -> Column:
    """Right-closed bands."""
    return ladder([(c <= b, f"le_{b}") for b in (0, 1, 5, 20, 100, 500)], "gt_500")


def higher_quantile(c: Column, q: float) -> Column:
    """Empirical quantile that takes the higher neighbour; for groups of bounded size."""
    a = F.array_sort(F.collect_list(c))
    return F.element_at(a, F.ceil(F.lit(q) * (F.size(a) - 1)).cast("int") + 1)


def pooled_buffer(errors: DataFrame, value: str, levels: Sequence[Sequence[str]], q: float, least: int = 200) -> DataFrame:
    """errors with a buffer from its finest group of at least `least` rows, else the coarser, else all; never negative.

    errors should be written, as they are read twice. The values of all levels are counted in one pass with grouping sets, and one range partitioning ranks them all.
    """
    every = list(dict.fromkeys(k for level in levels for k in level))
    known = errors.where(F.col(value).isNotNull())
    counts = known.groupBy(*every, value).agg(F.count("*").alias("__n"))  # combined before it is dealt out to the levels
    of_level = F.explode(F.array(*(F.struct(F.lit(k).alias("__level"), *(F.col(x) if x in level else F.lit(None).cast(known.schema[x].dataType).alias(x) for x in every)) for k, level in enumerate(levels))))
    dealt = counts.select(of_level.alias("g"), value, "__n").select("g.*", value, "__n").groupBy("__level", *every, value).agg(F.sum("__n").alias("__n"))
    run = running(dealt, "__n", [F.col(value)], ["__level", *every])
    found = run.where(F.col("__cum") >= F.ceil(F.lit(q) * (F.col("__all") - 1)) + 1).groupBy("__level", *every).agg(F.min(value).alias("buffer"), F.max("__all").alias("n"))
    found = stored(found, "pooled-buffers")
    out, picks = errors, []
    for k, level in enumerate(levels):
        t = found.where(F.col("__level") == k).select(*level, F.col("buffer").alias(f"b{k}"), F.col("n").alias(f"n{k}"))
        out = out.join(t, list(level), "left") if level else out.join(F.broadcast(t), F.lit(True), "left")  # one row
        picks.append(F.when(F.col(f"n{k}") >= least, F.col(f"b{k}")) if level else F.col(f"b{k}"))
    return out.withColumn("buffer", F.greatest(F.coalesce(*picks), F.lit(0.0))).drop(*(c for k in range(len(levels)) for c in (f"b{k}", f"n{k}")))


def service_columns(y: Column, t: Column, level: float) -> list[Column]:
    gap = y - t
    pinball = F.greatest(level * gap, (level - 1) * gap)
    under, over = F.greatest(gap, F.lit(0.0)), F.greatest(-gap, F.lit(0.0))
    return [
        F.avg(pinball).alias("pinball"), F.try_divide(F.sum(pinball), F.sum(y)).alias("pinball_ratio"), F.avg((t >= y).cast("double")).alias("row_service"),
        F.avg(F.when(y > 0, (t >= y).cast("double"))).alias("positive_row_service"), F.try_divide(F.sum(F.least(y, t)), F.sum(y)).alias("fill_rate"), F.sum(under).alias("underage"), F.sum(over).alias("overage"), F.try_divide(F.sum(over), F.sum(under)).alias("over_under_ratio"),
    ]


def metric_delta(before: DataFrame, after: DataFrame, on: Sequence[str], metric: str) -> DataFrame:
    a, c = before.select(*on, F.col(metric).alias("before")), after.select(*on, F.col(metric).alias("after"))
    return a.join(c, list(on)).withColumns({"change": F.col("after") - F.col("before"), "relative_pct": 100 * F.try_divide(F.col("after") - F.col("before"), F.col("before"))})
