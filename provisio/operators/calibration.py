"""Fits whose sufficient statistics are grouped sums: weighted slopes, their evaluation, weights of history, lags between series.

Every fit has one regressor, so five weighted sums per model determine it: they are pre-aggregated map-side, and only a
row per model comes back. Rows with a null regressor, target or weight take no part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provisio.functions import correlation

MOMENTS = ("w", "x", "y", "xx", "xy")
CONSTANT = "constant"


def moments(x: Column, y: Column, w: Column, suffix: str = "") -> list[Column]:
    """The weighted sums that a straight line needs."""
    w = F.when(x.isNotNull() & y.isNotNull(), w)
    return [F.sum(v).alias(f"s{n}{suffix}") for n, v in zip(MOMENTS, (w, w * x, w * y, w * x * x, w * x * y), strict=True)]


def line(sums: Sequence[Column], alpha: float = 0.0) -> tuple[Column, Column]:
    """Intercept and slope from the sums in the order of MOMENTS; alpha shrinks the slope, which is never negative. Null without rows."""
    w, x, y, xx, xy = sums
    slope = F.greatest(F.coalesce(F.try_divide(xy - x * y / w, xx - x * x / w + F.lit(alpha)), F.lit(0.0)), F.lit(0.0))
    return F.when(w > 0, (y - slope * x) / w), F.when(w > 0, slope)


def candidate_metrics(rows: DataFrame, candidates: Mapping[str, Mapping[str, float]], fit: Column, evaluation: Column, alpha: float = 0.1) -> DataFrame:
    """rows (a column per component, y, w). For each candidate's weighted sum of components, and for a constant: a line
    fitted where fit holds, and where evaluation holds the rows, the weighted mean absolute error of the line clipped
    to 0..1, and the rank correlation of score and y (null for the constant or too few rows). No rows give no metrics.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    value = {n: F.round(sum((F.coalesce(F.col(k), F.lit(0.0)) * v for k, v in ws.items()), F.lit(0.0)), 9) for n, ws in candidates.items()}
    flagged = rows.select(fit.alias("fit"), evaluation.alias("evaluation"), "y", "w", *(v.alias(f"score_{n}") for n, v in value.items())).where("y is not null and w is not null")
    scores = F.array(*(F.struct(F.lit(n).alias("candidate"), F.col(f"score_{n}").alias("score")) for n in candidates), F.struct(F.lit(CONSTANT).alias("candidate"), F.lit(0.0).alias("score")))
    long = flagged.select("fit", "evaluation", "y", "w", F.inline(scores))
    a, b = line([F.col(f"s{n}") for n in MOMENTS], alpha)
    fits = long.where("fit").groupBy("candidate").agg(*moments(F.col("score"), F.col("y"), F.col("w"))).select("candidate", a.alias("intercept"), b.alias("slope"))
    error = F.abs(F.col("y") - F.greatest(F.least(F.col("intercept") + F.col("slope") * F.col("score"), F.lit(1.0)), F.lit(0.0)))
    m = long.where("evaluation").join(F.broadcast(fits), "candidate").groupBy("candidate").agg(F.first("slope").alias("slope"), F.count("*").alias("evaluation_rows"), F.try_divide(F.sum(F.col("w") * error), F.sum("w")).alias("weighted_mae"))
    names = list(candidates)
    judged = flagged.where("evaluation").select(*(F.col(f"score_{n}") for n in names), "y")
    found = {}
    if len(judged.head(2)) == 2:
        vectors = VectorAssembler(inputCols=judged.columns, outputCol="v").transform(judged)
        matrix = Correlation.corr(vectors, "v", "spearman").first()[0].toArray()
        found = {n: float(r) for n, r in zip(names, matrix[-1], strict=False) if r == r}
    known = F.create_map(*(x for n, r in found.items() for x in (F.lit(n), F.lit(r)))) if found else F.create_map().cast("map<string,double>")
    return m.withColumn("spearman", known[F.col("candidate")])


def supervised_shares(rows: DataFrame, components: Sequence[str], fit: Column, alpha: float = 1.0) -> dict[str, float]:
    """Each component's own shrunk slope on y, as shares of their sum; equal shares where no slope is positive."""
    ready = rows.where(fit)
    sums = ready.agg(*(s for k in components for s in moments(F.coalesce(F.col(k), F.lit(0.0)), F.col("y"), F.col("w"), f"_{k}")))
    slopes = sums.select(*(F.coalesce(line([F.col(f"s{n}_{k}") for n in MOMENTS], alpha)[1], F.lit(0.0)).alias(k) for k in components)).first().asDict()
    total = sum(slopes.values())
    return {k: slopes[k] / total if total > 0 else 1 / len(components) for k in components}


def best_candidate(metrics: DataFrame, digits: int = 6) -> str | None:
    """The smallest error, then the largest rank correlation, then the name; the constant is only a reference."""
    order = F.struct(F.round("weighted_mae", digits), -F.round(F.coalesce("spearman", F.lit(-1.0)), digits), "candidate")
    return metrics.where((F.col("candidate") != CONSTANT) & F.col("weighted_mae").isNotNull()).agg(F.min_by("candidate", order)).first()[0]


def blended(first: Mapping[str, float], second: Mapping[str, float], share: float) -> dict[str, float]:
    """share of first and the rest of second, summing to 1."""
    mixed = {k: share * first[k] + (1 - share) * second[k] for k in first}
    total = sum(mixed.values())
    return {k: v / total for k, v in mixed.items()}


def history_fit(rows: DataFrame, x: str, y: str, split: str, weights: Sequence[float]) -> DataFrame:
    """weight, slope, wape: for each weight of the historical rows, a line fitted on historical and training rows and its WAPE over validation rows.

    One pass sums both kinds of rows, whatever the number of weights.
    """
    h, t = F.col(split) == "historical", F.col(split) == "train"
    one = F.lit(1.0)
    sums = rows.agg(*moments(F.col(x), F.col(y), F.when(h, one), "_h"), *moments(F.col(x), F.col(y), F.when(t, one), "_t"))
    sums = sums.withColumn("weight", F.explode(F.array(*(F.lit(float(v)) for v in weights))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    a, b = line([F.col("weight") * zero(f"s{n}_h") + zero(f"s{n}_t") for n in MOMENTS])
    fits = sums.select("weight", a.alias("intercept"), b.alias("slope"))
    scored = rows.where(F.col(split) == "validation").where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y).join(F.broadcast(fits), F.lit(True))
    p = F.greatest(F.col("intercept") + F.col("slope") * F.col(x), F.lit(0.0))
    return scored.groupBy("weight").agg(F.first("slope").alias("slope"), (100 * F.try_divide(F.sum(F.abs(p - F.col(y))), F.sum(F.abs(y)))).alias("wape"))


def fold_fits(rows: DataFrame, month: str, regressors: Mapping[str, str], y: str, weight: Column, folds: Sequence[tuple[str, str]]) -> DataFrame:
    """model, fold, y, pred: for each fold (first month, month after the last) and regressor, a line fitted on the months whose
    target was known before the fold, applied to the fold's months. Folds may overlap in what they learn from, never in what they score.
    """
    starts = F.array(*(F.struct(F.lit(k).alias("fold"), F.lit(a).cast("date").alias("from"), F.lit(z).cast("date").alias("till")) for k, (a, z) in enumerate(folds)))
    models = F.array(*(F.struct(F.lit(n).alias("model"), F.col(c).cast("double").alias("x")) for n, c in regressors.items()))
    long = rows.select(month, F.col(y).alias("y"), weight.alias("w"), F.inline(models)).where("x is not null and y is not null")
    dealt = long.select("*", F.inline(starts))
    a, b = line([F.col(f"s{n}") for n in MOMENTS])
    known = F.col(month) < F.add_months("from", -1)  # the target is the month after
    fits = dealt.where(known).groupBy("model", "fold").agg(*moments(F.col("x"), F.col("y"), F.col("w"))).select("model", "fold", a.alias("intercept"), b.alias("slope"))
    held = dealt.where((F.col(month) >= F.col("from")) & (F.col(month) < F.col("till")))
    return held.join(F.broadcast(fits), ["model", "fold"]).select("model", "fold", "y", F.greatest(F.col("intercept") + F.col("slope") * F.col("x"), F.lit(0.0)).alias("pred"))


def monthly_changes(series: DataFrame, key: str) -> DataFrame:
    """series (key, month, value), a row per month: each month's relative change; a series is as long as it has months."""
    before = F.lag("value").over(W.partitionBy(key).orderBy("month"))
    return series.select(key, "month", (F.try_divide(F.col("value"), before) - 1).alias("change")).where("change is not null")


def paired_lags(pairs: DataFrame, up: DataFrame, down: DataFrame, most: int = 6, least: int = 12, digits: int = 6) -> DataFrame:
    """pairs (upstream, downstream, assumed_lag), up (upstream, month, value), down (downstream, month, value): for each pair
    with `least` common months, the lag of 0..most with the largest absolute correlation of changes (the smaller lag on ties),
    its correlation and rows, and how far it lies from the assumed lag.
    """
    u = pairs.join(monthly_changes(up, "upstream"), "upstream").withColumnRenamed("change", "u").withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("month", F.expr("add_months(month, lag)"))
    met = u.join(monthly_changes(down, "downstream").withColumnRenamed("change", "d"), ["downstream", "month"])
    each = met.groupBy("upstream", "downstream", "assumed_lag", "lag").agg(correlation("u", "d").alias("r"), F.count("*").alias("n")).where((F.col("n") >= least) & F.col("r").isNotNull())
    best = each.groupBy("upstream", "downstream", "assumed_lag").agg(F.max_by(F.struct("lag", "r", "n"), F.struct(F.round(F.abs("r"), digits), -F.col("lag"))).alias("b"))
    return best.select("upstream", "downstream", "assumed_lag", F.col("b.lag").alias("best_lag"), F.col("b.r").alias("r"), F.col("b.n").alias("n"), (F.col("b.lag") - F.col("assumed_lag")).alias("gap"))
