"""Queries on trade policy candidates, weights of history, fitted folds and lags between series."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provisio.operators import calibration as op
from provisio.operators import forecast as fop
from provisio.operators import risk as rk
from provisio.operators import signals as sig
from provisio.plans import bindings as b
from provisio.plans import features as fea
from provisio.plans import forecast as fo
from provisio.plans import risk as pr
from provisio.plans import selection as sel
from provisio.plans import signals as ps
from provisio.registry import query
from provisio.sources import new_path

CURRENT = dict(zip(sig.COMPONENTS, (0.2, 0.12, 0.12, 0.1, 0.08, 0.08, 0.12, 0.08, 0.05, 0.05), strict=True))
TEST = VALIDATION = 6
SUPERVISED, KEPT = 0.65, {"current": 0.3}
KEEP = 0.2


def _sums(x: str, y: str = "y", w: str = "w") -> list[str]:
    return [f"sum({w})", f"sum({w} * {x})", f"sum({w} * {y})", f"sum({w} * {x} * {x})", f"sum({w} * {x} * {y})"]


def _slope(sums: list[str], alpha: float) -> str:
    w, x, y, xx, xy = sums
    return f"greatest(coalesce(({xy} - {x} * {y} / {w}) / nullif({xx} - {x} * {x} / {w} + {alpha}, 0), 0.0), 0.0)"


def _line(sums: list[str], alpha: float = 0.0) -> str:
    return f"{_slope(sums, alpha)} AS slope, ({sums[2]} - ({_slope(sums, alpha)}) * {sums[1]}) / {sums[0]} AS intercept"


def _wide(of: str, name: str) -> str:
    return f"SELECT '{name}' AS candidate, " + ", ".join(f"sum({of}) FILTER (WHERE component = '{k}') AS w_{k}" for k in sig.COMPONENTS)


def _metrics(name: str, weights: str, fit: str, evaluation: str) -> str:
    """Common table expressions that give metrics of the candidates in weights."""
    score = "round(" + " + ".join(f"{k} * w_{k}" for k in sig.COMPONENTS) + ", 9)"
    return f"""{name}l AS (SELECT candidate, split, y, w, {score} AS x FROM cal, {weights} UNION ALL SELECT '{op.CONSTANT}', split, y, w, 0.0 FROM cal),
{name}f AS (SELECT candidate, {_line(_sums('x'), 0.1)} FROM {name}l WHERE {fit} GROUP BY 1),
{name}k AS (SELECT candidate, rank() OVER (PARTITION BY candidate ORDER BY x) + (count(*) OVER (PARTITION BY candidate, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY candidate ORDER BY y) + (count(*) OVER (PARTITION BY candidate, y) - 1) / 2.0 AS ry FROM {name}l WHERE {evaluation} AND candidate <> '{op.CONSTANT}'),
{name}s AS (SELECT candidate, corr(rx, ry) AS spearman FROM {name}k GROUP BY 1),
{name} AS (SELECT candidate, first(slope) AS slope, count(*) AS evaluation_rows, sum(w * abs(y - greatest(least(intercept + slope * x, 1), 0))) / sum(w) AS weighted_mae, first(spearman) AS spearman FROM {name}l JOIN {name}f USING (candidate) LEFT JOIN {name}s USING (candidate) WHERE {evaluation} GROUP BY 1)"""


_OWN = ", ".join(f"{_slope(_sums(k), 1.0)} AS {k}" for k in sig.COMPONENTS)
POLICY = f"""{ps.TEN},
mo AS (SELECT month, row_number() OVER (ORDER BY month DESC) AS k FROM (SELECT DISTINCT month FROM tt)),
ou AS (SELECT month, hs_code, least(greatest(lead(-import_value_yoy) OVER (PARTITION BY hs_code ORDER BY month), 0), 1) + 0 * lead(import_value_yoy) OVER (PARTITION BY hs_code ORDER BY month) AS y, sqrt(greatest(suppliers, 1)) AS w FROM ts),
al AS (SELECT ten.*, CASE WHEN k <= {TEST} THEN 'test' WHEN k <= {TEST + VALIDATION} THEN 'validation' ELSE 'train' END AS split FROM ten JOIN mo USING (month)),
cal AS (SELECT month, hs_code, {', '.join(f'round({k}, 9) AS {k}' for k in sig.COMPONENTS)}, round(y, 9) AS y, w, split FROM al JOIN ou USING (month, hs_code) WHERE y IS NOT NULL),
{ps.weights_sql("(SELECT * FROM al WHERE split = 'train')", CURRENT)},
di AS (SELECT component, raw / sum(raw) OVER () AS v FROM dr),
ow AS (SELECT {_OWN} FROM cal WHERE split = 'train'),
ol AS ({' UNION ALL '.join(f"SELECT '{k}' AS component, {k} AS s FROM ow" for k in sig.COMPONENTS)}),
su AS (SELECT component, CASE WHEN sum(s) OVER () > 0 THEN s / sum(s) OVER () ELSE 0.1 END AS v FROM ol),
bl AS (SELECT component, {SUPERVISED} * su.v + {1 - SUPERVISED} * di.v AS v FROM su JOIN di USING (component)),
pri AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in CURRENT.items())}) t(component, v)),
cw AS ({_wide('v', 'current')} FROM pri UNION ALL {_wide('0.1', 'equal')} FROM pri UNION ALL {_wide('v', 'distribution')} FROM di UNION ALL {_wide('v', 'supervised')} FROM bl),
{_metrics('va', 'cw', "split = 'train'", "split = 'validation'")},
ch AS (SELECT candidate FROM va WHERE candidate <> '{op.CONSTANT}' ORDER BY round(weighted_mae, 6), -round(coalesce(spearman, -1), 6), candidate LIMIT 1),
chl AS ({' UNION ALL '.join(f"SELECT candidate, '{k}' AS component, w_{k} AS v FROM cw JOIN ch USING (candidate)" for k in sig.COMPONENTS)}),
fi0 AS (SELECT component, (CASE WHEN chl.candidate = 'current' THEN {KEPT['current']} ELSE {KEEP} END) * pri.v + (CASE WHEN chl.candidate = 'current' THEN {1 - KEPT['current']} ELSE {1 - KEEP} END) * chl.v AS v FROM chl JOIN pri USING (component)),
fi AS (SELECT component, v / sum(v) OVER () AS v FROM fi0)"""
_POLICY_TEST = f"{POLICY}, fw AS ({_wide('v', 'final')} FROM fi UNION ALL {_wide('v', 'current')} FROM pri), {_metrics('te', 'fw', 'split <> ' + chr(39) + 'test' + chr(39), 'split = ' + chr(39) + 'test' + chr(39))}"


def calibration_rows(spark, sf):
    """Components with next month's fall of imports as the outcome, weighted by the root of the suppliers, in chronological splits. Written once, as every candidate reads it."""
    w = W.partitionBy("hs_code").orderBy("month")
    later = F.lead("import_value_yoy").over(w)
    f = pr.flows(spark, sf)
    outcome = pr.trade(spark, sf, f).select("month", "hs_code", F.round(F.when(later.isNotNull(), F.least(F.greatest(-later, F.lit(0.0)), F.lit(1.0))), 9).alias("y"), F.sqrt(F.greatest("suppliers", F.lit(1))).alias("w"))
    parts = rk.chronological(rk.trade_totals(f), "month", TEST, VALIDATION).select("month", "hs_code", "split")
    out = ps.ten(spark, sf, f).join(parts, ["month", "hs_code"]).join(outcome, ["month", "hs_code"], "left").select("month", "hs_code", "split", "y", "w", *(F.round(k, 9).alias(k) for k in sig.COMPONENTS), *(f"{k}_known" for k in sig.COMPONENTS))
    path = new_path(spark, "calibration")
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def candidates(rows):
    train = F.col("split") == "train"
    spread = {r.component: r.share for r in sig.distribution_weights(rows.where(train), CURRENT).collect()}
    own = op.supervised_shares(rows, sig.COMPONENTS, train & F.col("y").isNotNull())
    return {"current": CURRENT, "equal": dict.fromkeys(sig.COMPONENTS, 0.1), "distribution": spread, "supervised": op.blended(own, spread, SUPERVISED)}


def calibrated(rows):
    """The candidates' metrics on validation months, the best one's name and the final weights: the best with a share of the current ones."""
    known = candidates(rows)
    metrics = op.candidate_metrics(rows, known, F.col("split") == "train", F.col("split") == "validation")
    best = op.best_candidate(metrics) or "distribution"
    return metrics, best, op.blended(CURRENT, known[best], KEPT.get(best, KEEP))


def _metric_columns():
    return [F.round(c, 5).alias(c) for c in ("slope", "weighted_mae", "spearman")]


@query("trd_policy_candidates", f"WITH {POLICY} SELECT candidate, round(slope, 5) AS slope, evaluation_rows, round(weighted_mae, 5) AS weighted_mae, round(spearman, 5) AS spearman, candidate IN (SELECT candidate FROM ch) AS selected FROM va")
def trd_policy(spark, sf):
    metrics, best, _ = calibrated(calibration_rows(spark, sf))
    return metrics.select("candidate", "evaluation_rows", *_metric_columns(), (F.col("candidate") == best).alias("selected"))


@query("trd_policy_weights", f"WITH {POLICY} SELECT component, round(pri.v, 5) AS current_weight, round(fi.v, 5) AS final_weight FROM fi JOIN pri USING (component)")
def trd_policy_weights(spark, sf):
    final = calibrated(calibration_rows(spark, sf))[2]
    return spark.createDataFrame([(k, round(CURRENT[k], 5), round(final[k], 5)) for k in sig.COMPONENTS], "component string, current_weight double, final_weight double")


@query("trd_policy_test", f"WITH {_POLICY_TEST} SELECT candidate, round(slope, 5) AS slope, evaluation_rows, round(weighted_mae, 5) AS weighted_mae, round(spearman, 5) AS spearman, round(100 * (weighted_mae - (SELECT weighted_mae FROM te WHERE candidate = 'final')) / nullif(weighted_mae, 0), 4) AS improvement_pct FROM te")
def trd_policy_test(spark, sf):
    """Final and current weights and a constant on the test months, fitted on all months before; how much the final weights improve on each."""
    rows = calibration_rows(spark, sf)
    final = calibrated(rows)[2]
    m = op.candidate_metrics(rows, {"final": final, "current": CURRENT}, F.col("split") != "test", F.col("split") == "test")
    reference = m.where("candidate = 'final'").select(F.col("weighted_mae").alias("final_mae"))
    j = m.join(F.broadcast(reference), F.lit(True))
    return j.select("candidate", "evaluation_rows", *_metric_columns(), F.round(100 * F.try_divide(F.col("weighted_mae") - F.col("final_mae"), F.col("weighted_mae")), 4).alias("improvement_pct"))


def _history(kind: str) -> list[str]:
    return _sums("x", w=f"CASE WHEN split = '{kind}' THEN 1.0::DOUBLE END")


_MIXED = [f"(f * coalesce(h{n}, 0) + coalesce(t{n}, 0))" for n in op.MOMENTS]


@query("for_history_weight_fit", f"""WITH {fo.BASE}, r AS (SELECT split, rolling_mean_6 AS x, target_next_month AS y FROM base WHERE rolling_mean_6 IS NOT NULL AND target_next_month IS NOT NULL),
s AS (SELECT {', '.join(f'{e} AS h{n}' for n, e in zip(op.MOMENTS, _history('historical'), strict=True))}, {', '.join(f'{e} AS t{n}' for n, e in zip(op.MOMENTS, _history('train'), strict=True))} FROM r),
l AS (SELECT f, {_line(_MIXED)} FROM s, (VALUES {', '.join(f'({w}::DOUBLE)' for w in sel.WEIGHTS)}) v(f)),
m AS (SELECT f AS weight, first(slope) AS slope, 100 * sum(abs(greatest(intercept + slope * x, 0) - y)) / sum(abs(y)) AS wape FROM r, l WHERE split = 'validation' GROUP BY 1)
SELECT weight, round(slope, 5) AS slope, round(wape, 5) AS wape, row_number() OVER (ORDER BY round(wape, 6), weight) = 1 AS selected FROM m""")
def for_history_fit(spark, sf):
    """A fitted line for each weight of the historical rows; the smallest WAPE on validation rows, then the smaller weight, is selected."""
    m = op.history_fit(fo.labelled(spark, sf), "rolling_mean_6", "target_next_month", "split", sel.WEIGHTS)
    best = m.agg(F.min_by("weight", F.struct(F.round("wape", 6), "weight")).alias("best"))
    return m.join(F.broadcast(best), F.lit(True)).select("weight", F.round("slope", 5).alias("slope"), F.round("wape", 5).alias("wape"), (F.col("weight") == F.col("best")).alias("selected"))


REGRESSORS = {"fitted_lag": "last_month_pred", "fitted_mean_6": "rolling_mean_6_pred", "fitted_expanding": "expanding_mean_pred", "fitted_unknown_signal": "unknown_signal"}
_KNOWN = {n: c for n, c in REGRESSORS.items() if c != "unknown_signal"}


@query("for_rolling_origin_fit", f"""WITH {fo.BASE}, fd AS (SELECT * FROM (VALUES {', '.join(f"({k}, DATE '{a}', DATE '{z}')" for k, (a, z) in enumerate(fo.FOLDS))}) v(fold, a, z)),
r AS ({' UNION ALL '.join(f"SELECT '{n}' AS model, year_month, {c} AS x, target_next_month AS y, CASE WHEN split = 'historical' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM base WHERE {c} IS NOT NULL AND target_next_month IS NOT NULL" for n, c in _KNOWN.items())}),
l AS (SELECT model, fold, {_line(_sums('x'))} FROM r JOIN fd ON year_month < a - INTERVAL 1 MONTH GROUP BY 1, 2),
p AS (SELECT model, y, greatest(intercept + slope * x, 0) AS p FROM r JOIN fd ON year_month >= a AND year_month < z JOIN l USING (model, fold)
  UNION ALL {' UNION ALL '.join(f"SELECT '{n.removesuffix('_pred')}', target_next_month, {n} FROM base JOIN fd ON year_month >= a AND year_month < z WHERE target_next_month IS NOT NULL" for n in fo.PREDS)}),
m AS (SELECT model, count(*) AS n, 100 * sum(abs(p - y)) / sum(abs(y)) AS wape FROM p GROUP BY 1)
SELECT model, n, round(wape, 5) AS wape, row_number() OVER (ORDER BY round(wape, 6), model) = 1 AS selected, 'scored' AS status FROM m UNION ALL SELECT 'fitted_unknown_signal', 0, NULL, FALSE, 'skipped'""")
def for_fold_fits(spark, sf):
    """Models fitted anew for each rolling-origin fold beside the baselines, pooled over the folds. A model whose column is missing is listed as skipped."""
    rows = fo.labelled(spark, sf)
    ready = {n: c for n, c in REGRESSORS.items() if c in rows.columns}
    weight = F.when(F.col("split") == "historical", 0.5).otherwise(1.0)
    fitted = op.fold_fits(rows, "year_month", ready, "target_next_month", weight, fo.FOLDS).select("model", "y", "pred")
    inside = F.lit(False)
    for a, z in fo.FOLDS:
        inside = inside | ((F.col("year_month") >= a) & (F.col("year_month") < z))
    usual = fop.long_predictions(rows.where(inside), fo.PREDS, ["target_next_month"]).select("model", F.col("target_next_month").alias("y"), "pred")
    m = fitted.unionByName(usual).groupBy("model").agg(F.count("*").alias("n"), (100 * F.try_divide(F.sum(F.abs(F.col("pred") - F.col("y"))), F.sum(F.abs("y")))).alias("wape"))
    best = m.agg(F.min_by("model", F.struct(F.round("wape", 6), "model")).alias("best"))
    out = m.join(F.broadcast(best), F.lit(True)).select("model", "n", F.round("wape", 5).alias("wape"), (F.col("model") == F.col("best")).alias("selected"), F.lit("scored").alias("status"))
    skipped = spark.createDataFrame([(n, 0, None, False, "skipped") for n in REGRESSORS if n not in ready], out.schema)
    return out.unionByName(skipped)


@query("com_lag_pairs", """WITH p AS (SELECT p_brand, p_type, date_trunc('month', CAST(l_shipdate AS DATE))::DATE AS month, l_extendedprice / l_quantity AS price FROM lineitem JOIN part ON l_partkey = p_partkey),
u0 AS (SELECT p_brand AS k, month, avg(price) AS v FROM p GROUP BY 1, 2), d0 AS (SELECT p_type AS k, month, avg(price) AS v FROM p GROUP BY 1, 2),
u AS (SELECT k, month, v / lag(v) OVER (PARTITION BY k ORDER BY month) - 1 AS c FROM u0), d AS (SELECT k, month, v / lag(v) OVER (PARTITION BY k ORDER BY month) - 1 AS c FROM d0),
q AS (SELECT p_brand AS upstream, p_type AS downstream, CAST(min(p_size) % 7 AS INTEGER) AS assumed_lag FROM part GROUP BY 1, 2),
e AS (SELECT upstream, downstream, assumed_lag, CAST(l AS INTEGER) AS lag, corr(u.c, d.c) AS r, count(*) AS n FROM q JOIN u ON u.k = upstream CROSS JOIN range(7) t(l) JOIN d ON d.k = downstream AND d.month = u.month + to_months(CAST(l AS INTEGER)) WHERE u.c IS NOT NULL AND d.c IS NOT NULL GROUP BY ALL HAVING count(*) >= 12),
o AS (SELECT *, row_number() OVER (PARTITION BY upstream, downstream ORDER BY round(abs(r), 6) DESC, lag) AS k FROM e)
SELECT upstream, downstream, assumed_lag, lag AS best_lag, round(r, 5) AS r, n, lag - assumed_lag AS gap FROM o WHERE k = 1""")
def com_pairs(spark, sf):
    """Every brand against every type it has, with the lag that the smallest size stands for as the assumed one."""
    part = b.table(spark, sf, "part")
    li = b.table(spark, sf, "lineitem").select("l_partkey", F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("month"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    rows = li.join(part.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    series = lambda c, name: rows.groupBy(F.col(c).alias(name), "month").agg(F.avg("price").alias("value"))
    pairs = part.groupBy(F.col("p_brand").alias("upstream"), F.col("p_type").alias("downstream")).agg((F.min("p_size") % 7).cast("int").alias("assumed_lag"))
    return op.paired_lags(pairs, series("p_brand", "upstream"), series("p_type", "downstream")).withColumn("r", F.round("r", 5))
