"""Forecast queries on the nation x brand series."""

from __future__ import annotations

from pyspark.sql import functions as F

from provisio.operators import forecast as op
from provisio.plans import bindings as b
from provisio.plans import features as fea
from provisio.registry import query
from provisio.sources import stored

IDS, ID = fea.IDS, fea.ID
PREDS = list(op.BASELINES)
SHORT = [p.removesuffix("_pred") for p in PREDS]
BASE = fea.FEAT + ",\nbase AS (SELECT *, " + ", ".join(f"greatest(coalesce({c}, demand_lag_1, 0), 0) AS {p}" for p, c in op.BASELINES.items()) + f", {fea.SPLIT_SQL} AS split FROM feat)"
METRIC_SQL = """count(y) AS n, sum(y) AS actual_sum, sum(p) AS pred_sum, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse, sqrt(avg(power(ln(1 + greatest(p, 0)) - ln(1 + greatest(y, 0)), 2))) AS rmsle,
  100 * avg(abs((p - y) / y)) FILTER (WHERE y <> 0) AS mape, 100 * avg(2 * abs(p - y) / (abs(y) + abs(p))) FILTER (WHERE abs(y) + abs(p) <> 0) AS smape, 100 * sum(abs(p - y)) / nullif(sum(abs(y)), 0) AS wape,
  avg(p - y) AS bias, 100 * sum(p - y) / nullif(sum(abs(y)), 0) AS bias_pct, avg(CAST(y = 0 AS DOUBLE)) AS zero_rate"""
ROUNDED = ", ".join(f"round({m}, 5) AS {m}" if m != "n" else m for m in op.METRICS)
LONG = BASE + ",\nlong AS (" + " UNION ALL ".join(f"SELECT *, '{p.removesuffix('_pred')}' AS model, target_next_month AS y, {p} AS p FROM base WHERE target_next_month IS NOT NULL" for p in PREDS) + ")"
PAT = BASE + """,
pat0 AS (SELECT institution_code, item_code, count(demand) AS n, count(*) FILTER (WHERE demand > 0) AS nonzero, avg(demand) FILTER (WHERE demand > 0) AS mean, stddev_samp(demand) FILTER (WHERE demand > 0) AS std FROM base WHERE year_month < DATE '2000-07-01' GROUP BY 1, 2),
pat1 AS (SELECT *, n / nullif(nonzero, 0)::DOUBLE AS adi, power(coalesce(std / mean, 0), 2) AS cv2 FROM pat0),
pat AS (SELECT *, CASE WHEN n < 3 THEN 'insufficient' WHEN nonzero = 0 THEN 'all_zero' WHEN adi < 1.32 AND cv2 < 0.49 THEN 'smooth' WHEN adi >= 1.32 AND cv2 < 0.49 THEN 'intermittent' WHEN adi < 1.32 AND cv2 >= 0.49 THEN 'erratic' ELSE 'lumpy' END AS demand_pattern FROM pat1)"""


def base(spark, sf):
    return op.baselines(fea.table(spark, sf)).withColumn("split", fea.split())


def labelled(spark, sf):
    return base(spark, sf).where("target_next_month is not null")


def patterns(spark, sf):
    return op.demand_patterns(base(spark, sf).where("year_month < '2000-07-01'"), fea.KEY, "demand")


def kept(spark, sf):
    """The series with predictions and split, written: what needs them more than once reads them here."""
    return stored(base(spark, sf).select(*IDS, "demand", "split", "target_next_month", *PREDS), "forecast-base")


def with_patterns(rows):
    """Rows of kept() with their series' demand pattern."""
    return rows.join(op.demand_patterns(rows.where("year_month < '2000-07-01'"), fea.KEY, "demand").select(*fea.KEY, "demand_pattern"), fea.KEY)


def rounded(df):
    return df.withColumns({m: F.round(m, 5) for m in op.METRICS if m != "n"})


@query("for_baselines", f"WITH {BASE} SELECT {ID}, {', '.join(f'round({p}, 5) AS {p}' for p in PREDS)} FROM base")
def for_baselines(spark, sf):
    return base(spark, sf).select(*IDS, *(F.round(p, 5).alias(p) for p in PREDS))


@query("for_metrics_global", f"WITH {LONG}, m AS (SELECT {METRIC_SQL} FROM long WHERE model = 'rolling_mean_3') SELECT {ROUNDED} FROM m")
def for_metrics(spark, sf):
    return rounded(labelled(spark, sf).agg(*op.metric_columns(F.col("target_next_month"), F.col("rolling_mean_3_pred"))))


@query("for_metrics_by_group", f"WITH {LONG}, m AS (SELECT institution_code, {METRIC_SQL} FROM long WHERE model = 'last_month' GROUP BY 1) SELECT institution_code, {ROUNDED} FROM m")
def for_metrics_group(spark, sf):
    return rounded(labelled(spark, sf).groupBy("institution_code").agg(*op.metric_columns(F.col("target_next_month"), F.col("last_month_pred"))))


@query("for_model_segment_report", f"""WITH {LONG}, s AS (SELECT model, 'all' AS segment, 'all' AS value, y, p FROM long UNION ALL SELECT model, 'split', split, y, p FROM long UNION ALL SELECT model, 'forecast_month', CAST(month(forecast_month) AS VARCHAR), y, p FROM long),
m AS (SELECT model, segment, value, {METRIC_SQL} FROM s GROUP BY 1, 2, 3) SELECT model, segment, value, {ROUNDED} FROM m""")
def for_report(spark, sf):
    rows = labelled(spark, sf).withColumn("forecast_month", F.month("forecast_month"))
    return rounded(op.report(rows, PREDS, "target_next_month", ["split", "forecast_month"]))


@query("for_demand_patterns", f"WITH {PAT} SELECT institution_code, item_code, n, nonzero, round(adi, 5) AS adi, round(cv2, 5) AS cv2, demand_pattern FROM pat")
def for_patterns(spark, sf):
    return patterns(spark, sf).select(*fea.KEY, "n", "nonzero", F.round("adi", 5).alias("adi"), F.round("cv2", 5).alias("cv2"), "demand_pattern")


@query("for_training_window", f"""WITH {BASE} SELECT {ID}, split, CASE WHEN split = 'historical' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM base WHERE split IN ('historical', 'train') AND target_next_month >= 0 AND demand_lag_1 >= 0 AND rolling_mean_3 IS NOT NULL""")
def for_window(spark, sf):
    rows = base(spark, sf).withColumn("split", op.splits("year_month", "2000-07-01", "2001-01-01", "1998-01-01"))
    rows = rows.where("split in ('historical', 'train') and target_next_month >= 0 and demand_lag_1 >= 0 and rolling_mean_3 is not null")
    return rows.select(*IDS, "split", F.when(F.col("split") == "historical", 0.5).otherwise(1.0).alias("weight"))


NAMES = ["last_month_pred", "rolling_mean_6_pred", "expanding_mean_pred"]
GRID = "grid AS (SELECT a / 20.0::DOUBLE AS last_month_pred, c / 20.0::DOUBLE AS rolling_mean_6_pred, (20 - a - c) / 20.0::DOUBLE AS expanding_mean_pred FROM range(21) t(a), range(21) u(c) WHERE a + c <= 20)"


def best(spark, rows, group):
    rows = rows.where("split = 'validation' and target_next_month is not null")
    return op.best_blend(op.blend_scores(rows, NAMES, "target_next_month", group, op.weight_grid(spark, NAMES)), NAMES, group)


def blend_sql(group, rows):
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""sc AS (SELECT {g}{', '.join(f'g.{n}' for n in NAMES)}, target_next_month AS y, greatest({' + '.join(f'g.{n} * r.{n}' for n in NAMES)}, 0) AS p FROM ({rows}) r, grid g),
agg AS (SELECT {g}{', '.join(NAMES)}, 100 * sum(abs(p - y)) / nullif(sum(abs(y)), 0) AS wape, abs(100 * sum(p - y) / nullif(sum(abs(y)), 0)) AS bias_size, sqrt(avg((p - y) * (p - y))) AS rmse FROM sc GROUP BY {g}{', '.join(NAMES)}),
best AS (SELECT * FROM agg QUALIFY row_number() OVER ({part}ORDER BY round(wape, 6), round(bias_size, 6), round(rmse, 6), {', '.join(f'{n} DESC' for n in NAMES)}) = 1)"""


VALID = "SELECT * FROM base WHERE split = 'validation' AND target_next_month IS NOT NULL"


@query("for_weight_grid", f"WITH {BASE}, {GRID}, {blend_sql('', VALID)} SELECT {', '.join(f'round({n}, 6) AS {n}' for n in NAMES)}, round(wape, 4) AS wape, round(bias_size, 4) AS bias_size, round(rmse, 4) AS rmse FROM agg")
def for_grid(spark, sf):
    """Every weighting in steps of a twentieth, with its errors over the validation rows."""
    rows = labelled(spark, sf).where("split = 'validation'")
    scores = op.blend_scores(rows, NAMES, "target_next_month", [], op.weight_grid(spark, NAMES))
    return scores.select(*(F.round(n, 6).alias(n) for n in NAMES), *(F.round(c, 4).alias(c) for c in ("wape", "bias_size", "rmse")))


@query("for_blend_selection", f"WITH {BASE}, {GRID}, {blend_sql('', VALID)} SELECT {', '.join(f'round({n}, 4) AS {n}' for n in NAMES)}, round(wape, 4) AS wape FROM best")
def for_blend(spark, sf):
    return best(spark, base(spark, sf), []).select(*(F.round(n, 4).alias(n) for n in NAMES), F.round("wape", 4).alias("wape"))


@query("for_pattern_blend_applied", f"""WITH {PAT}, {GRID}, {blend_sql('demand_pattern', VALID.replace('FROM base', 'FROM base JOIN (SELECT institution_code, item_code, demand_pattern FROM pat) q USING (institution_code, item_code)'))}
SELECT year_month, institution_code, item_code, round(greatest(coalesce(w.last_month_pred, 1) * r.last_month_pred + coalesce(w.rolling_mean_6_pred, 0) * r.rolling_mean_6_pred + coalesce(w.expanding_mean_pred, 0) * r.expanding_mean_pred, 0), 4) AS ensemble_pred
FROM base r JOIN (SELECT institution_code, item_code, demand_pattern FROM pat) q USING (institution_code, item_code) LEFT JOIN best w USING (demand_pattern) WHERE split = 'test'""")
def for_pattern_blend(spark, sf):
    rows = with_patterns(kept(spark, sf))
    return op.apply_weights(rows.where("split = 'test'"), best(spark, rows, ["demand_pattern"]), ["demand_pattern"], NAMES, [1, 0, 0]).select(*IDS, F.round("ensemble_pred", 4).alias("ensemble_pred"))


@query("for_pattern_router", f"""WITH {PAT}, l AS ({' UNION ALL '.join(f"SELECT demand_pattern, '{p}' AS model, target_next_month AS y, {p} AS p FROM base JOIN (SELECT institution_code, item_code, demand_pattern FROM pat) q USING (institution_code, item_code) WHERE split = 'validation' AND target_next_month IS NOT NULL" for p in PREDS)}),
m AS (SELECT demand_pattern, model, 100 * sum(abs(p - y)) / nullif(sum(abs(y)), 0) AS wape FROM l GROUP BY 1, 2)
SELECT demand_pattern, replace(model, '_pred', '') AS model, round(wape, 4) AS wape FROM m QUALIFY row_number() OVER (PARTITION BY demand_pattern ORDER BY round(wape, 6) NULLS LAST, model) = 1""")
def for_router(spark, sf):
    rows = with_patterns(kept(spark, sf)).where("split = 'validation' and target_next_month is not null")
    long = op.long_predictions(rows, PREDS, ["demand_pattern", "target_next_month"])
    y, p = F.col("target_next_month"), F.col("pred")
    m = long.groupBy("demand_pattern", "model").agg((100 * F.try_divide(F.sum(F.abs(p - y)), F.sum(F.abs(y)))).alias("wape"))
    best_one = F.min_by(F.struct("model", "wape"), F.struct(F.coalesce(F.round("wape", 6), F.lit(1e300)), F.concat("model", F.lit("_pred"))))
    return m.groupBy("demand_pattern").agg(best_one.alias("x")).select("demand_pattern", "x.model", F.round("x.wape", 4).alias("wape"))


@query("for_scale_bands", f"WITH {BASE} SELECT CASE WHEN rolling_mean_3_pred <= 0 THEN 'le_0' WHEN rolling_mean_3_pred <= 1 THEN 'le_1' WHEN rolling_mean_3_pred <= 5 THEN 'le_5' WHEN rolling_mean_3_pred <= 20 THEN 'le_20' WHEN rolling_mean_3_pred <= 100 THEN 'le_100' WHEN rolling_mean_3_pred <= 500 THEN 'le_500' ELSE 'gt_500' END AS band, count(*) AS rows FROM base GROUP BY 1")
def for_bands(spark, sf):
    return base(spark, sf).groupBy(op.scale_band(F.col("rolling_mean_3_pred")).alias("band")).agg(F.count("*").alias("rows"))


@query("for_pooled_buffer", f"""WITH {PAT}, e AS (SELECT b.*, q.demand_pattern, target_next_month - rolling_mean_6_pred AS err FROM base b JOIN (SELECT institution_code, item_code, demand_pattern FROM pat) q USING (institution_code, item_code) WHERE split = 'validation' AND target_next_month IS NOT NULL),
g1 AS (SELECT institution_code, demand_pattern, list_sort(list(round(err, 6))) AS a FROM e GROUP BY 1, 2), g2 AS (SELECT demand_pattern, list_sort(list(round(err, 6))) AS a FROM e GROUP BY 1), g3 AS (SELECT list_sort(list(round(err, 6))) AS a FROM e)
SELECT year_month, institution_code, item_code, round(greatest(coalesce(CASE WHEN len(g1.a) >= 100 THEN g1.a[CAST(ceil(0.9 * (len(g1.a) - 1)) AS INTEGER) + 1] END, CASE WHEN len(g2.a) >= 100 THEN g2.a[CAST(ceil(0.9 * (len(g2.a) - 1)) AS INTEGER) + 1] END, g3.a[CAST(ceil(0.9 * (len(g3.a) - 1)) AS INTEGER) + 1]), 0), 5) AS buffer
FROM e LEFT JOIN g1 USING (institution_code, demand_pattern) LEFT JOIN g2 USING (demand_pattern) CROSS JOIN g3""")
def for_buffer(spark, sf):
    rows = with_patterns(kept(spark, sf)).where("split = 'validation' and target_next_month is not null")
    rows = stored(rows.select(*IDS, "demand_pattern", F.round(F.col("target_next_month") - F.col("rolling_mean_6_pred"), 6).alias("err")), "forecast-errors")
    return op.pooled_buffer(rows, "err", [["institution_code", "demand_pattern"], ["demand_pattern"], []], 0.9, 100).select(*IDS, F.round("buffer", 5).alias("buffer"))


SERVICE = """avg(greatest(0.9 * (y - t), -0.1 * (y - t))) AS pinball, sum(greatest(0.9 * (y - t), -0.1 * (y - t))) / nullif(sum(y), 0) AS pinball_ratio, avg(CAST(t >= y AS DOUBLE)) AS row_service, avg(CAST(t >= y AS DOUBLE)) FILTER (WHERE y > 0) AS positive_row_service,
  sum(least(y, t)) / nullif(sum(y), 0) AS fill_rate, sum(greatest(y - t, 0)) AS underage, sum(greatest(t - y, 0)) AS overage, sum(greatest(t - y, 0)) / nullif(sum(greatest(y - t, 0)), 0) AS over_under_ratio"""
SCOLS = ["pinball", "pinball_ratio", "row_service", "positive_row_service", "fill_rate", "underage", "overage", "over_under_ratio"]


@query("for_service_metrics", f"WITH {BASE}, m AS (SELECT {SERVICE} FROM (SELECT target_next_month AS y, rolling_mean_6_pred * 1.3 AS t FROM base WHERE target_next_month IS NOT NULL)) SELECT {', '.join(f'round({c}, 5) AS {c}' for c in SCOLS)} FROM m")
def for_service(spark, sf):
    m = labelled(spark, sf).agg(*op.service_columns(F.col("target_next_month"), F.col("rolling_mean_6_pred") * 1.3, 0.9))
    return m.select(*(F.round(c, 5).alias(c) for c in SCOLS))


@query("for_strategy_grid", f"""WITH {LONG}, x AS (SELECT model, f, split, y, p * f AS t FROM long, (VALUES (1.0::DOUBLE), (1.2::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE)) v(f) WHERE split IN ('validation', 'test')),
m AS (SELECT model, f, split, {SERVICE} FROM x GROUP BY 1, 2, 3), c AS (SELECT model, f FROM m WHERE split = 'validation' ORDER BY round(pinball, 6), model, f LIMIT 1)
SELECT model, f AS factor, split, round(pinball, 5) AS pinball, round(fill_rate, 5) AS fill_rate FROM m JOIN c USING (model, f)""")
def for_strategies(spark, sf):
    long = op.long_predictions(labelled(spark, sf).where("split in ('validation', 'test')"), PREDS, ["split", "target_next_month"])
    x = long.withColumn("factor", F.explode(F.array(*(F.lit(f) for f in (1.0, 1.2, 1.5, 2.0)))))
    m = x.groupBy("model", "factor", "split").agg(*op.service_columns(F.col("target_next_month"), F.col("pred") * F.col("factor"), 0.9))
    chosen = m.where("split = 'validation'").orderBy(F.round("pinball", 6), "model", "factor").limit(1).select("model", "factor")
    return m.join(F.broadcast(chosen), ["model", "factor"]).select("model", "factor", "split", F.round("pinball", 5).alias("pinball"), F.round("fill_rate", 5).alias("fill_rate"))


@query("for_daily_rate", f"WITH {b.SERIES_FACT} SELECT institution_code, item_code, round(greatest(sum(consumption_qty), 0) / 92, 6) AS daily_rate FROM sfact WHERE year_month >= (SELECT max(year_month) FROM sfact) - INTERVAL 2 MONTH GROUP BY 1, 2")
def for_rate(spark, sf):
    f = fea.fact(spark, sf)
    last = f.agg(F.max("year_month").alias("last"))
    recent = f.join(F.broadcast(last), F.lit(True)).where(F.col("year_month") >= F.add_months("last", -2))
    return recent.groupBy(*fea.KEY).agg(F.round(F.greatest(F.sum("consumption_qty"), F.lit(0.0)) / 92, 6).alias("daily_rate"))


@query("for_metric_delta", f"""WITH {LONG}, m AS (SELECT split, model, 100 * sum(abs(p - y)) / sum(abs(y)) AS wape FROM long GROUP BY 1, 2)
SELECT a.split, round(a.wape, 5) AS before, round(c.wape, 5) AS after, round(c.wape - a.wape, 5) AS change, round(100 * (c.wape - a.wape) / a.wape, 5) AS relative_pct FROM m a JOIN m c ON a.split = c.split AND a.model = 'last_month' AND c.model = 'rolling_mean_6'""")
def for_delta(spark, sf):
    m = op.report(labelled(spark, sf), ["last_month_pred", "rolling_mean_6_pred"], "target_next_month", ["split"]).where("segment = 'split'").withColumnRenamed("value", "split")
    d = op.metric_delta(m.where("model = 'last_month'"), m.where("model = 'rolling_mean_6'"), ["split"], "wape")
    return d.select("split", *(F.round(c, 5).alias(c) for c in ("before", "after", "change", "relative_pct")))


FOLDS = [("1999-01-01", "1999-04-01"), ("1999-07-01", "1999-10-01"), ("2000-01-01", "2000-04-01"), ("2000-07-01", "2000-10-01")]


@query("for_rolling_origin", f"""WITH {LONG}, f AS (SELECT * FROM (VALUES {', '.join(f"(DATE '{a}', DATE '{z}')" for a, z in FOLDS)}) v(a, z)),
m AS (SELECT model, count(*) AS n, sum(abs(p - y)) / sum(abs(y)) * 100 AS wape FROM long JOIN f ON year_month >= a AND year_month < z GROUP BY 1)
SELECT model, n, round(wape, 5) AS wape, row_number() OVER (ORDER BY wape, model) = 1 AS selected FROM m""")
def for_folds(spark, sf):
    """Rolling-origin folds pooled; the model with the smallest WAPE is selected."""
    rows = labelled(spark, sf)
    inside = F.lit(False)
    for a, z in FOLDS:
        inside = inside | ((F.col("year_month") >= a) & (F.col("year_month") < z))
    m = op.report(rows.where(inside), PREDS, "target_next_month").select("model", "n", "wape")
    chosen = m.agg(F.min_by("model", F.struct("wape", "model")).alias("best"))
    return m.join(F.broadcast(chosen), F.lit(True)).select("model", "n", F.round("wape", 5).alias("wape"), (F.col("model") == F.col("best")).alias("selected"))


NUMBERS = ["demand_lag_1", "demand_lag_2", "demand_lag_3", "rolling_mean_3", "rolling_mean_6", "rolling_median_3", "expanding_mean", "forecast_month_of_year"]


def training_rows(spark, sf):
    """Labelled rows with the models' columns and weights."""
    return labelled(spark, sf).select(*IDS, "split", "target_next_month", *(F.col(c).cast("double").alias(c) for c in NUMBERS)).withColumn("weight", F.when(F.col("split") == "historical", 0.5).otherwise(1.0))


def _trained(spark, sf, estimator):
    """Fits on training rows and scores the validation rows; features are imputed with training medians."""
    from provisio.plans.handoff import _pipeline

    rows = training_rows(spark, sf)
    model = _pipeline(estimator).fit(rows.where("split in ('historical', 'train')"))
    return op.batch_scored(rows.where("split = 'validation'"), {"model": model}).select(*IDS, "target_next_month", "model_pred")


@query("for_boosted_trees")
def for_trees(spark, sf):
    from pyspark.ml.regression import GBTRegressor

    return _trained(spark, sf, GBTRegressor(labelCol="target_next_month", weightCol="weight", lossType="absolute", maxIter=8, maxDepth=4, maxBins=64, seed=1))


@query("for_tweedie")
def for_tweedie(spark, sf):
    from pyspark.ml.regression import GeneralizedLinearRegression

    return _trained(spark, sf, GeneralizedLinearRegression(labelCol="target_next_month", weightCol="weight", family="tweedie", variancePower=1.3, linkPower=0.0, maxIter=15))
