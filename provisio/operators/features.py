"""Gap-aware time-series features. A lag never crosses a missing month: every window runs inside a segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provisio.functions import safe_divide

LAGS = {"demand": (1, 2, 3, 6, 12), "inbound_qty": (1, 2, 3), "month_end_stock": (1, 2, 3), "stockout_rate": (1, 2, 3), "disposal_qty": (1, 2, 3), "auto_disposal_adjustment_qty": (1,)}
IDENTIFIERS = {"year_month", "institution_code", "department", "item_code", "stock_item_key", "segment", "forecast_month", "target_next_month"}
SAME_MONTH = {"consumption_qty", "demand", "inbound_qty", "month_end_stock", "stockout_rate", "disposal_qty", "auto_disposal_adjustment_qty", "negative_demand"}


def time_features(df: DataFrame, month: str = "year_month") -> DataFrame:
    nxt = F.add_months(month, 1)
    return df.withColumns({"forecast_month": nxt, "forecast_year": F.year(nxt), "forecast_month_of_year": F.month(nxt), "forecast_quarter": F.quarter(nxt)})


def demand(df: DataFrame, qty: str = "consumption_qty") -> DataFrame:
    """Demand is null, not 0, where the outbound quantity is negative."""
    return df.withColumns({"negative_demand": (F.col(qty) < 0).cast("int"), "demand": F.when(F.col(qty) >= 0, F.col(qty))})


def segments(df: DataFrame, key: Sequence[str], month: str = "year_month") -> DataFrame:
    """Contiguous-month segments, with the position in the segment and in the series."""
    w = W.partitionBy(*key).orderBy(month)
    start = F.when(F.col(month) == F.add_months(F.lag(month).over(w), 1), 0).otherwise(1)
    out = df.withColumn("segment", F.sum(start).over(w)).withColumn("series_observation_count", F.row_number().over(w))
    return out.withColumn("history_months", F.row_number().over(W.partitionBy(*key, "segment").orderBy(month)))


def _segment(key: Sequence[str], month: str) -> W:
    return W.partitionBy(*key, "segment").orderBy(month)


def lags(df: DataFrame, key: Sequence[str], which: dict[str, Sequence[int]] = LAGS, month: str = "year_month") -> DataFrame:
    """The current row is the forecast's origin, so lag k is k - 1 rows back."""
    w = _segment(key, month)
    return df.withColumns({f"{c}_lag_{k}": F.lag(c, k - 1).over(w) if k > 1 else F.col(c) for c, ks in which.items() for k in ks})


def rolling(df: DataFrame, key: Sequence[str], value: str = "demand", month: str = "year_month") -> DataFrame:
    w, v = _segment(key, month), F.col(value)
    back = lambda n: w.rowsBetween(-(n - 1), 0)
    cols: dict[str, Column] = {}
    for n in (3, 6, 12):
        cols[f"rolling_mean_{n}"], cols[f"rolling_std_{n}"] = F.avg(v).over(back(n)), F.stddev_samp(v).over(back(n))
    cols["rolling_median_3"] = F.percentile(v, F.lit(0.5)).over(back(3))
    whole = w.rowsBetween(W.unboundedPreceding, 0)
    cols["expanding_mean"] = F.try_divide(F.sum(v).over(whole), F.count(v).over(whole))
    for n in (6, 12):
        cols[f"zero_rate_{n}"] = F.avg(F.when(v.isNotNull(), (v == 0).cast("double"))).over(back(n))
    return df.withColumns(cols)


def target(df: DataFrame, key: Sequence[str], value: str = "demand", month: str = "year_month") -> DataFrame:
    return df.withColumn("target_next_month", F.lead(value).over(_segment(key, month)))


def season(df: DataFrame) -> DataFrame:
    """Needs forecast_month_of_year, demand_lag_1 and demand_lag_12."""
    m = F.col("forecast_month_of_year")
    return df.withColumns({"is_winter": m.isin(12, 1, 2).cast("int"), "is_summer": m.isin(6, 7, 8).cast("int"), "same_month_last_year": F.col("demand_lag_12"), "yoy": safe_divide(F.col("demand_lag_1") - F.col("demand_lag_12"), F.col("demand_lag_12"))})


def feature_table(fact: DataFrame, key: Sequence[str], month: str = "year_month") -> DataFrame:
    """All features in one sort: every window shares the series' partitioning."""
    out = segments(demand(time_features(fact, month)), key, month)
    return season(target(rolling(lags(out, key, month=month), key, month=month), key, month=month))


def with_external(df: DataFrame, external: DataFrame, on: Sequence[str], columns: Sequence[str], fill: float | None = None) -> DataFrame:
    """Left join of optional features; missing columns and rows become fill."""
    have = [c for c in columns if c in external.columns]
    out = df.join(external.select(*on, *have), list(on), "left")
    out = out.withColumns({c: F.lit(fill).cast("double") for c in columns if c not in have})
    return out if fill is None else out.fillna(fill, list(columns))


def coverage(df: DataFrame, signals: Sequence[str], split: Column) -> DataFrame:
    """Per split and signal: rows, non-zero rows, their ratio, the largest value."""
    long = df.select(split.alias("split"), F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value")) for s in signals))).alias("x")).select("split", "x.*")
    out = long.groupBy("split", "signal").agg(F.count("*").alias("rows"), F.count_if(F.coalesce(F.col("value"), F.lit(0.0)) != 0).alias("nonzero_rows"), F.max("value").alias("max_value"))
    return out.withColumn("ratio", F.try_divide("nonzero_rows", "rows"))


def enforce_coverage(found: DataFrame, required: Sequence[str], least: float) -> DataFrame:
    """Raises with every breach; found is the small table of coverage(). Returns it."""
    rows = {r.signal: r for r in found.where("split = 'train'").where(F.col("signal").isin(*required)).collect()}
    bad = [f"{s}: no training rows" if s not in rows or not rows[s].nonzero_rows else f"{s}: coverage {rows[s].ratio:.4f} < {least}" for s in required if s not in rows or not rows[s].nonzero_rows or rows[s].ratio < least]
    if bad:
        raise ValueError("; ".join(bad))
    return found


def model_columns(df: DataFrame, news: bool = True, commodity: bool = True, fused: bool = True) -> list[str]:
    """Columns a model may see: no identifiers, target, same-month values or predictions; signal blocks as asked."""
    block = {"news_": news, "commodity_": commodity, "fused_": fused}
    return [c for c in df.columns if c not in IDENTIFIERS | SAME_MONTH and not c.endswith("_pred") and all(on or not c.startswith(p) for p, on in block.items())]


def price_volatility(prices: DataFrame, factor: str = "factor", date: str = "date", price: str = "price", least: int = 5) -> DataFrame:
    """Per factor and month: the spread of log returns where a month has the median of least prices, else the size of the monthly mean's log return."""
    p = prices.withColumn("month", F.trunc(date, "MM")).withColumn("r", F.ln(price) - F.lag(F.ln(price)).over(W.partitionBy(factor).orderBy(date)))
    months = p.groupBy(factor, "month").agg(F.count("*").alias("n"), F.stddev_samp("r").alias("std"), F.count("r").alias("returns"), F.avg(price).alias("mean"))
    usual = months.groupBy(factor).agg(F.percentile("n", F.lit(0.5)).alias("usual"))
    out = months.join(usual, factor).withColumn("sparse", F.abs(F.ln("mean") - F.lag(F.ln("mean")).over(W.partitionBy(factor).orderBy("month"))))
    return out.select(factor, "month", F.when(F.col("usual") >= least, F.when(F.col("returns") >= least, F.col("std"))).otherwise(F.col("sparse")).alias("volatility"))


def moments(fact: DataFrame, key: Sequence[str], value: str, least: int = 6) -> DataFrame:
    out = fact.groupBy(*key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))
    return out.where((F.col("n") >= least) & (F.col("mean") > 0) & F.col("std").isNotNull())
