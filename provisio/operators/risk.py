"""Price, trade and news risk, and their fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provisio.operators.ordered import quantiles
from provisio.functions import clip, correlation, flags, geometric_mean, ladder, noisy_or, split_codes

DAY = "unix_date(date)"


def asof_return(days: int, price: str = "price") -> Column:
    """Return against the latest price at least `days` old and at most twice that; else 0. Backward as-of by a range frame."""
    w = W.partitionBy("factor").orderBy(F.expr(DAY)).rangeBetween(W.unboundedPreceding, -days)
    old, when = F.last(price).over(w), F.last("date").over(w)
    ok = F.datediff(F.col("date"), when).between(days, 2 * days)
    return F.coalesce(F.when(ok, F.try_divide(F.col(price), old) - 1), F.lit(0.0))


def price_features(prices: DataFrame) -> DataFrame:
    """prices (factor, date, price), one row per factor and date. All frames share one sort."""
    w = W.partitionBy("factor").orderBy(F.expr(DAY))
    rows = prices.withColumn("r", F.try_divide(F.col("price"), F.lag("price").over(w)) - 1)
    near = w.rangeBetween(-29, 0)
    std = F.when(F.count("r").over(near) >= 2, F.stddev_samp("r").over(near))
    back = F.when(F.count("r").over(w.rowsBetween(-2, 0)) >= 2, F.stddev_samp("r").over(w.rowsBetween(-2, 0)))
    return rows.withColumns({"return_7": asof_return(7), "return_30": asof_return(30), "volatility_30": F.coalesce(std, back, F.lit(0.0)) * 30**0.5, "level_90": F.try_divide(F.col("price"), F.avg("price").over(w.rangeBetween(-89, 0))) - 1})


def factor_risk(features: DataFrame, thresholds: Sequence[float] = (0.2, 0.3, 0.2)) -> DataFrame:
    """Month-end snapshot of clipped, weighted components."""
    parts = [w * clip(F.greatest(F.col(c), F.lit(0.0)) / t, 0, 1) for w, c, t in zip((0.45, 0.3, 0.25), ("return_30", "volatility_30", "level_90"), thresholds, strict=True)]
    rows = features.withColumns({"risk": sum(parts, F.lit(0.0)), "month": F.trunc("date", "MM")})
    return rows.groupBy("factor", "month").agg(F.max_by(F.struct("date", "return_30", "volatility_30", "level_90", "risk"), "date").alias("x")).select("factor", "month", "x.*")


def market_paths(items: DataFrame, factors: DataFrame) -> DataFrame:
    """items (stock_item_key, codes, mapping_weight, confidence) exploded by code and joined with factors (code, factor, transmission, proxy, lag_days)."""
    long = items.withColumn("code", F.explode(split_codes(F.col("codes")))).drop("codes")
    out = long.join(factors, "code")
    conf = ladder([(F.lower("confidence") == "high", 0.9), (F.lower("confidence") == "medium", 0.7), (F.lower("confidence") == "low", 0.4)], 0.5)
    return out.withColumn("path_weight", geometric_mean([F.col("mapping_weight"), conf, F.col("transmission"), F.col("proxy")]))


def commodity_scores(paths: DataFrame, risk: DataFrame, watch: float = 0.05) -> DataFrame:
    """Item-month risk: factors' risks shifted by the path's lag, compounded as independent causes."""
    j = paths.join(risk, "factor").withColumn("score_month", F.trunc(F.date_add(F.last_day("month"), F.col("lag_days")), "MM"))
    x = F.least(F.col("risk") * F.col("path_weight"), F.lit(1.0))
    return j.withColumn("x", x).groupBy("stock_item_key", F.col("score_month").alias("month")).agg(
        noisy_or(F.col("x")).alias("commodity_risk"), F.try_divide(F.sum(F.col("return_30") * F.col("path_weight")), F.sum("path_weight")).alias("weighted_return"), F.count_distinct("factor").alias("factors"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("x") >= watch, F.col("factor")))), ";").alias("event_codes"), F.count("*").alias("paths"))


def lag_scan(up: DataFrame, down: DataFrame, most: int = 6, least: int = 12) -> DataFrame:
    """up, down (month, value): correlation of monthly changes at lags 0..most; best is the largest in size."""
    change = lambda df, n: df.withColumn(n, F.try_divide(F.col("value"), F.lag("value").over(W.orderBy("month"))) - 1).select("month", n)
    u = change(up, "u").withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("month", F.expr("add_months(month, lag)"))
    return u.join(change(down, "d"), "month").where("u is not null and d is not null").groupBy("lag").agg(correlation("u", "d").alias("r"), F.count("*").alias("n")).where(F.col("n") >= least)


MEASURES = ("import_value", "import_weight", "export_value", "export_weight")


def country_flows(flows: DataFrame) -> DataFrame:
    """flows (month, hs_code, country_code, import_value, import_weight, export_value, export_weight) summed by month, code and country."""
    return flows.groupBy("month", "hs_code", "country_code").agg(*(F.sum(c).alias(c) for c in MEASURES))


def trade_totals(flows: DataFrame) -> DataFrame:
    """The same flows summed by month and code."""
    t = flows.groupBy("month", "hs_code").agg(*(F.sum(c).alias(c) for c in MEASURES))
    return t.withColumns({"unit_value": F.try_divide("import_value", "import_weight"), "net_import": F.greatest(F.col("import_value") - F.col("export_value"), F.lit(0.0))})


def trade_windows(totals: DataFrame) -> DataFrame:
    w = W.partitionBy("hs_code").orderBy("month")
    six, v = w.rowsBetween(-5, 0), F.col("import_value")
    cv = F.when(F.count(v).over(six) >= 3, F.try_divide(F.stddev_pop(v).over(six), F.avg(v).over(six)))
    rows = totals.withColumn("dl", F.when(F.col("unit_value") > 0, F.ln("unit_value")) - F.when(F.lag("unit_value").over(w) > 0, F.ln(F.lag("unit_value").over(w))))
    rows = rows.withColumns({"import_cv": cv, "price_volatility": F.when(F.count("dl").over(six) >= 3, F.stddev_pop("dl").over(six)), "prior_positive": F.coalesce(F.max(v).over(w.rowsBetween(-12, -1)) > 0, F.lit(False)), "island": F.sum((v > 0).cast("int")).over(w)})
    streak = F.sum((F.col("import_value") <= 0).cast("int")).over(W.partitionBy("hs_code", "island").orderBy("month"))
    return rows.withColumn("zero_streak", streak).drop("dl", "island")


def year_ago(totals: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Change against the same month a year before, by calendar; null where that was 0 or missing."""
    prev = totals.select(F.add_months("month", 12).alias("month"), "hs_code", *(F.col(c).alias(f"prev_{c}") for c in columns))
    return totals.join(prev, ["month", "hs_code"], "left").withColumns({f"{c}_yoy": F.try_divide(F.col(c), F.col(f"prev_{c}")) - 1 for c in columns})


def concentration(flows: DataFrame, totals: DataFrame) -> DataFrame:
    c = flows.groupBy("month", "hs_code", "country_code").agg(F.sum("import_value").alias("v"))
    j = c.join(totals.select("month", "hs_code", "import_value"), ["month", "hs_code"]).withColumn("share", clip(F.try_divide("v", "import_value"), 0, 1))
    return j.groupBy("month", "hs_code").agg(F.max("share").alias("top1"), F.sum(F.col("share") * F.col("share")).alias("hhi"), F.count_if(F.col("v") > 0).alias("suppliers"), F.least(F.try_divide(F.sum("v"), F.first("import_value")), F.lit(1.0)).alias("coverage"))


WEIGHTS = {"fall": 0.25, "concentration": 0.2, "volatility": 0.15, "price": 0.2, "interruption": 0.2}


def trade_components(df: DataFrame) -> DataFrame:
    """Clipped component risks, their weighted score and the share of weights that could be computed."""
    c = F.col
    parts = {"fall": clip(-c("import_value_yoy") / 0.5, 0, 1), "concentration": clip((c("hhi") - 0.1) / 0.4, 0, 1), "volatility": clip(c("import_cv") / 1.0, 0, 1), "price": clip(c("unit_value_yoy") / 0.5, 0, 1), "interruption": F.when(c("prior_positive") & (c("zero_streak") > 0), 1.0).otherwise(0.0)}
    out = df.withColumns({f"{k}_risk": v for k, v in parts.items()})
    score = sum((w * F.coalesce(F.col(f"{k}_risk"), F.lit(0.0)) for k, w in WEIGHTS.items()), F.lit(0.0))
    known = sum((w * F.col(f"{k}_risk").isNotNull().cast("double") for k, w in WEIGHTS.items()), F.lit(0.0))
    codes = F.array_join(flags([(F.col(f"{k}_risk") >= 0.3, k.upper()) for k in WEIGHTS]), ";")
    return out.withColumns({"trade_score": score, "trade_confidence": known, "event_codes": codes})


def propagate_trade(scores: DataFrame, paths: DataFrame, observed: DataFrame) -> DataFrame:
    """paths (stock_item_key, hs_code, weight, valid_from, valid_to) applied to observed item-months: 1 - product of (1 - risk * weight)."""
    keys = observed.select("month", "stock_item_key").distinct()
    j = keys.join(paths, "stock_item_key").where(F.col("month").between(F.col("valid_from"), F.col("valid_to"))).join(scores.select("month", "hs_code", "trade_score"), ["month", "hs_code"])
    x = F.least(F.col("trade_score") * F.col("weight"), F.lit(1.0))
    return j.groupBy("month", "stock_item_key").agg((1 - F.exp(F.sum(F.ln(F.greatest(1 - x, F.lit(1e-12)))))).alias("trade_risk"), F.array_join(F.array_sort(F.collect_set("hs_code")), ";").alias("hs_codes"), F.count("*").alias("paths"))


def positive_quantile(df: DataFrame, group: Sequence[str], value: str, q: float, default: float, least: int = 10) -> DataFrame:
    """The exact quantile of each group's positive values, or the default of a group that has fewer than `least`. Values are range-partitioned."""
    counted = df.groupBy(*group).agg(F.count_if(F.col(value) > 0).alias("n"))
    high = quantiles(df.where(F.col(value) > 0).select(*group, value), group, value, {"high": q})
    return counted.join(high, list(group), "left").select(*group, "n", F.when(F.col("n") >= least, F.col("high")).otherwise(F.lit(default)).alias("threshold"))


def chronological(df: DataFrame, month: str, test: int, validation: int) -> DataFrame:
    """Last months for test, those before for validation; months are few, so they are ranked on their own."""
    m = df.select(month).distinct()
    ranked = m.withColumn("k", F.row_number().over(W.orderBy(F.desc(month))))
    name = ladder([(F.col("k") <= test, "test"), (F.col("k") <= test + validation, "validation")], "train")
    return df.join(F.broadcast(ranked.select(month, name.alias("split"))), month)


SUPPLY = {"supply_news_risk": 1.0, "material_news_risk": 0.8, "commodity_risk": 0.7}


def fuse(news: DataFrame, market: DataFrame, trade: DataFrame) -> DataFrame:
    """Full outer join on (month, stock_item_key); gates, weighted maximum, trade overlay, confidence, level, codes."""
    j = news.join(market, ["month", "stock_item_key"], "full_outer").join(trade, ["month", "stock_item_key"], "full_outer")
    nums = ("disease_news_risk", "supply_news_risk", "material_news_risk", "news_confidence", "commodity_risk", "market_confidence", "trade_risk", "trade_confidence")
    j = j.fillna(0.0, list(nums)).withColumns({g: F.coalesce(F.col(g), F.lit(False)) for g in ("material_approved", "demand_approved")})
    c = F.col
    gate = c("material_approved") | (c("commodity_risk") > 0) | (c("trade_risk") > 0)
    demand = F.when(c("demand_approved"), c("disease_news_risk")).otherwise(F.lit(0.0))
    base = F.when(gate, clip(F.greatest(*(w * c(n) for n, w in SUPPLY.items())) / max(SUPPLY.values()), 0, 1)).otherwise(F.lit(0.0))
    j = j.withColumns({"demand_risk": demand, "base_supply": base})
    j = j.withColumn("supply_risk", F.when(c("trade_risk") > 0, 1 - (1 - c("base_supply")) * (1 - 0.224 * c("trade_risk"))).otherwise(c("base_supply")))
    active = [(c("news_confidence"), c("news_confidence") > 0), (c("market_confidence"), c("market_confidence") > 0), (c("trade_confidence"), c("trade_confidence") > 0)]
    n = sum((a.cast("int") for _, a in active), F.lit(0))
    total = F.greatest("demand_risk", "supply_risk")
    j = j.withColumns({"trade_contribution": c("supply_risk") - c("base_supply"), "confidence": F.coalesce(F.try_divide(sum((v for v, _ in active), F.lit(0.0)), n), F.lit(0.0)), "total_risk": total, "driver": F.when(c("demand_risk") > c("supply_risk"), "demand").otherwise("supply")})
    codes = F.trim(F.regexp_replace(F.concat_ws(";", "news_codes", "market_codes", "trade_codes"), ";{2,}", ";"))
    return j.withColumns({"risk_level": level(c("total_risk")), "event_codes": F.regexp_replace(codes, "^;|;$", "")})


def level(c: Column) -> Column:
    return ladder([(c >= 0.75, "critical"), (c >= 0.55, "warning"), (c >= 0.30, "watch")], "normal")


def audit(scores: DataFrame, latest_only: bool = False) -> DataFrame:
    """A row per signal with its weight and contribution."""
    weights = {"disease_news_risk": 1.0, **SUPPLY, "trade_risk": 0.224}
    rows = scores
    if latest_only:
        rows = rows.join(F.broadcast(rows.agg(F.max("month").alias("latest"))), F.lit(True)).where("month = latest")
    long = F.explode(F.array(*(F.struct(F.lit(k).alias("signal"), F.col(k).alias("value"), F.lit(w).alias("weight"), (w * F.col(k)).alias("contribution")) for k, w in weights.items())))
    return rows.select("month", "stock_item_key", long.alias("x")).select("month", "stock_item_key", "x.*")
