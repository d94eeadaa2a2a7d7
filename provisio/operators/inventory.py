"""Inventory recommendation, stock status, substitutes, service tables, and demand hidden by empty stock."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provisio.operators.ordered import quantiles
from provisio.functions import clip, ladder, last_wins, truthy


@dataclass(frozen=True)
class Policy:
    """Fixed values of the order policy."""

    default_lead_days: float = 15.0
    lead_cap: float = 120.0
    review_days: float = 30.0
    base_factor: float = 1.2
    usage_uplift: float = 0.35
    lead_factor: float = 0.5
    lead_extra_days: float = 14.0
    safety_base: float = 0.2
    safety_slope: float = 0.25
    buffer_cap: float = 0.75
    fixed_rates: tuple[float, float, float] = (0.2, 0.2, 0.1)
    fixed_cap: float = 0.5


P = Policy()


def resolved_lead(c: Column, p: Policy = P) -> Column:
    """Missing, NaN or under a day becomes the default; capped."""
    bad = c.isNull() | F.isnan(c) | (c < 1)
    return F.least(F.when(bad, F.lit(p.default_lead_days)).otherwise(c), F.lit(p.lead_cap))


def gated_risks(df: DataFrame) -> DataFrame:
    """Material risk is the larger of news and commodity; all are 0 without an approved mapping."""
    ok = truthy(F.col("mapping_approved"))
    gate = lambda c: F.when(ok, clip(F.coalesce(c, F.lit(0.0)), 0, 1)).otherwise(F.lit(0.0))
    out = df.withColumns({"gate_news": gate(F.col("news_risk")), "gate_material": gate(F.greatest("news_risk", "commodity_risk")), "gate_trade": gate(F.col("trade_risk"))})
    return out.withColumn("external_risk", 0.4 * F.col("gate_news") + 0.3 * F.col("gate_material") + 0.3 * F.col("gate_trade"))


def recommend(df: DataFrame, p: Policy = P) -> DataFrame:
    """Target and order from predicted_usage (a month), current_stock, lead_time_days, on_order_qty, backorder_qty, and review_period_days where it is there.

    With fused_risk, usage, lead time and safety grow with it up to a cap; without (null), three fixed-rate buffers
    apply. status 'DORMANT' or 'NOT_OPERATED' orders 0; 'DATA_MISSING' or 'STALE' orders null.
    """
    c, daily = F.col, F.greatest(F.col("predicted_usage"), F.lit(0.0)) / 30
    lead, s = resolved_lead(c("lead_time_days"), p), clip(F.col("fused_risk"), 0, 1)
    review = F.coalesce(c("review_period_days"), F.lit(p.review_days)) if "review_period_days" in df.columns else F.lit(p.review_days)
    protection = daily * (review + lead)
    base = protection * p.base_factor
    risky = daily * (1 + p.usage_uplift * s) * (review + lead * (1 + p.lead_factor * s) + p.lead_extra_days * s) * (1 + p.safety_base + p.safety_slope * s)
    fused = F.least(F.greatest(risky - base, F.lit(0.0)), p.buffer_cap * protection)
    parts = [r * F.coalesce(F.col(n), F.lit(0.0)) for r, n in zip(p.fixed_rates, ("gate_news", "gate_material", "gate_trade"), strict=True)]
    rate = sum(parts, F.lit(0.0))
    fixed = protection * F.least(rate, F.lit(p.fixed_cap))
    buffer = F.when(s.isNotNull(), fused).otherwise(fixed)
    position = F.coalesce(c("current_stock"), F.lit(0.0)) + F.coalesce(c("on_order_qty"), F.lit(0.0)) - F.coalesce(c("backorder_qty"), F.lit(0.0))
    order = F.greatest(base + buffer - position, F.lit(0.0))
    order = last_wins([(c("status").isin("DORMANT", "NOT_OPERATED"), F.lit(0.0)), (c("status").isin("DATA_MISSING", "STALE"), F.lit(None).cast("double"))], order)
    return df.withColumns({"lead_days": lead, "base_stock": base, "risk_buffer": buffer, "target_stock": base + buffer, "position": position, "recommended_order": order})


def series_status(fact: DataFrame, key: Sequence[str]) -> DataFrame:
    """Latest month of each series with lifetime and last-three-month sums, daily mean and spread over its calendar days."""
    w = W.partitionBy(*key)
    last = fact.agg(F.max("year_month").alias("corpus_month"), F.max("last_date").alias("corpus_date"))
    rows = fact.join(F.broadcast(last), F.lit(True))
    recent = F.col("year_month") > F.add_months("corpus_month", -3)
    stats = rows.groupBy(*key).agg(
        F.max_by(F.struct("year_month", "month_end_stock", "last_date", "consumption_qty", "physical_violation_count"), "year_month").alias("x"), F.min("first_date").alias("first_date"), F.sum("outbound_sum").alias("total"), F.sum("outbound_squared_sum").alias("squares"),
        F.coalesce(F.sum(F.when(recent, F.col("outbound_sum"))), F.lit(0.0)).alias("recent"), F.sum("physical_violation_count").alias("violations"), F.first("corpus_month").alias("corpus_month"), F.first("corpus_date").alias("corpus_date"))
    del w
    out = stats.select(*key, F.col("x.year_month").alias("latest_month"), "x.month_end_stock", "x.last_date", "first_date", "total", "squares", "recent", "violations", "corpus_date")
    days = F.datediff("corpus_date", "first_date") + 1
    mu = F.col("total") / days
    return out.withColumns({"days": days, "mu": mu, "sigma": F.sqrt(F.greatest(F.col("squares") / days - mu * mu, F.lit(0.0))), "lag_days": F.datediff("corpus_date", "last_date"), "rate_92": F.col("recent") / 92})


def zero_stock_reason(df: DataFrame, stale_days: int = 180) -> DataFrame:
    """Later masks win."""
    c = F.col
    reason = last_wins([
        (F.coalesce(c("month_end_stock"), F.lit(0.0)) <= 0, "TRUE_STOCKOUT"), (c("month_end_stock").isNull(), "DATA_MISSING"), (c("lag_days") > stale_days, "STALE"),
        ((F.coalesce(c("month_end_stock"), F.lit(0.0)) <= 0) & (c("recent") <= 0) & (c("lag_days") <= stale_days), "NOT_OPERATED"), (c("month_end_stock") > 0, "IN_STOCK"),
    ], "IN_STOCK")
    return df.withColumn("reason", reason)


def group_stock(df: DataFrame, exact: Sequence[str], broad: Sequence[str]) -> DataFrame:
    """Stock held by substitutes: totals and distinct series of the exact and the broad group."""
    stock = F.greatest(F.coalesce(F.col("month_end_stock"), F.lit(0.0)), F.lit(0.0))
    out = df
    for name, group in (("exact", exact), ("broad", broad)):
        g = df.groupBy(*group).agg(F.sum(stock).alias(f"{name}_stock"), F.count("*").alias(f"{name}_series"))
        out = out.join(g, list(group), "left")
    return out


def action_status(df: DataFrame, lead_days: float = 15.0) -> DataFrame:
    """Needs reason, exact_stock, broad_stock, mu, sigma, violations. Later masks win; URGENT_SHORTAGE comes last."""
    c = F.col
    need = c("mu") * lead_days
    short = (c("reason") == "TRUE_STOCKOUT") & (c("recent") > 0)
    covered = short & (c("exact_stock") > 0)
    action = last_wins([
        (c("reason") == "IN_STOCK", "OK"), ((c("reason") == "IN_STOCK") & (c("month_end_stock") < 1.2 * need), "WATCH"), ((c("reason") == "IN_STOCK") & (c("month_end_stock") < need), "BELOW_REORDER_POINT"),
        (c("reason") == "NOT_OPERATED", "NOT_OPERATED"), (c("reason") == "DATA_MISSING", "DATA_MISSING"), (c("reason") == "STALE", "STALE"), (short, "SHORTAGE"), (covered, "COVERED_BY_EQUIVALENT"),
        (short & ~covered & (c("broad_stock") > 0), "COVERED_BY_FAMILY"), (short & (c("exact_stock") <= 0) & (c("broad_stock") <= 0), "URGENT_SHORTAGE"),
    ], "OK")
    return df.withColumn("action", action)


def transition(df: DataFrame) -> DataFrame:
    """One month: opening_stock, order_qty, lead_days, demand."""
    available = F.col("opening_stock") + F.when(F.col("lead_days") <= 30, F.col("order_qty")).otherwise(F.lit(0.0))
    met = F.least("demand", available)
    return df.withColumns({"available": available, "fulfilled": met, "unmet": F.col("demand") - met, "closing": available - met, "fill_rate": F.coalesce(F.try_divide(met, F.col("demand")), F.lit(1.0)), "residual": available - met - (available - met)})


def collapse_departments(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Series status over departments: moments add up; the most urgent reason wins; dormant only if all are."""
    rank = F.array(*(F.lit(r) for r in ("TRUE_STOCKOUT", "DATA_MISSING", "STALE", "NOT_OPERATED", "IN_STOCK")))
    out = df.groupBy(*key).agg(F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.max("days").alias("days"), F.min(F.array_position(rank, F.col("reason"))).alias("r"), F.array_join(F.array_sort(F.collect_set("reason")), ";").alias("reasons"), F.bool_and(F.col("reason") == "NOT_OPERATED").alias("dormant"))
    mu = F.col("total") / F.col("days")
    return out.withColumns({"reason": F.element_at(rank, F.col("r").cast("int")), "mu": mu, "sigma": F.sqrt(F.greatest(F.col("squares") / F.col("days") - mu * mu, F.lit(0.0)))}).drop("r")


def level_policy(df: DataFrame, cover_days: float = 30.0) -> DataFrame:
    """Safety stock and reorder point from mu, sigma, z, lead_time_days, lead_multiplier, current_stock."""
    c = F.col
    lead = resolved_lead(c("lead_time_days")) * F.coalesce(c("lead_multiplier"), F.lit(1.0))
    ss = c("z") * c("sigma") * F.sqrt(lead)
    rop = c("mu") * lead + ss
    status = ladder([(c("current_stock") <= ss, "CRITICAL"), (c("current_stock") < rop, "BELOW_ROP"), (c("current_stock") < 1.2 * rop, "WATCH")], "OK")
    return df.withColumns({"lead": lead, "safety_stock": ss, "reorder_point": rop, "target": c("mu") * (lead + cover_days) + ss, "level_status": status})


def spells(daily: DataFrame, key: Sequence[str], period_end: str) -> DataFrame:
    """Days in zero, held and unknown stock: each observation lasts until the next or the period's end."""
    nxt = F.coalesce(F.lead("closing_date").over(W.partitionBy(*key).orderBy("closing_date")), F.date_add(F.lit(period_end).cast("date"), 1))
    d = F.datediff(nxt, F.col("closing_date"))
    s = F.col("closing_stock")
    rows = daily.withColumn("d", d)
    zero, held, unknown = (F.coalesce(F.sum(F.when(m, F.col("d"))), F.lit(0)) for m in (s <= 0, s > 0, s.isNull()))
    out = rows.groupBy(*key).agg(F.min("closing_date").alias("first_date"), F.max("closing_date").alias("last_date"), F.count("*").alias("transaction_days"), F.sum(F.greatest(F.coalesce("consumption_qty", F.lit(0.0)), F.lit(0.0))).alias("demand_total"), F.sum("d").alias("total_days"), zero.alias("zero_days"), held.alias("held_days"), unknown.alias("unknown_days"))
    return rates(out)


def rates(df: DataFrame) -> DataFrame:
    return df.withColumns({"zero_ratio": F.try_divide("zero_days", "total_days"), "coverage": F.try_divide(F.col("zero_days") + F.col("held_days"), F.col("total_days")), "naive_rate": F.try_divide("demand_total", "total_days"), "available_rate": F.try_divide("demand_total", "held_days")})


def credibility(metrics: DataFrame, item: str = "item_code", least: int = 5) -> DataFrame:
    """Exposure-weighted mean, process and between variance and K for each item with enough institutions."""
    m = metrics.where("held_days > 0")
    mean = m.groupBy(item).agg((F.sum("demand_total") / F.sum("held_days")).alias("item_mean"))
    j = m.join(mean, item)
    v = j.groupBy(item).agg(F.first("item_mean").alias("item_mean"), F.count("*").alias("n"), F.sum("held_days").alias("exposure"), F.sum(F.col("held_days") * F.pow(F.col("available_rate") - F.col("item_mean"), F.lit(2.0))).alias("ss"))
    process = F.col("item_mean")
    observed = F.col("ss") / F.col("exposure")
    between = observed - process / (F.col("exposure") / F.col("n"))
    return v.withColumns({"process": process, "between": between}).withColumn("k", F.when((F.col("n") >= least) & (F.col("between") > 0), F.col("process") / F.col("between")))


def corrected(metrics: DataFrame, params: DataFrame, item: str = "item_code") -> DataFrame:
    """Classes and corrected rates: shrunk towards the item's mean, capped by the 95th percentile of uplift and by 8."""
    c = F.col
    cap = quantiles(params, [], "k", {"k_cap": 0.9, "k_mid": 0.5})
    j = metrics.join(params.select(item, "item_mean", "k"), item, "left").join(F.broadcast(cap), F.lit(True))
    k = F.coalesce(F.least("k", "k_cap"), c("k_mid"), F.lit(1.0))
    j = j.withColumn("shrunk", (c("item_mean") * k + c("demand_total")) / (k + c("held_days")))
    kind = ladder([(c("coverage") < 0.9, "NOT_VERIFIED"), (c("demand_total") <= 0, "DORMANT"), (c("zero_ratio") >= 0.5, "CENSORED")], "ACTIVE")
    j = j.withColumns({"demand_class": kind, "uplift": F.try_divide("shrunk", "naive_rate")})
    top = quantiles(j.where("demand_class = 'ACTIVE'").select("uplift"), [], "uplift", {"p95": 0.95})
    j = j.join(F.broadcast(top), F.lit(True))
    rate = F.when(c("demand_class") == "CENSORED", F.least(c("shrunk"), c("naive_rate") * F.least(F.coalesce("p95", F.lit(8.0)), F.lit(8.0)))).when(c("demand_class") == "ACTIVE", c("available_rate")).otherwise(c("naive_rate"))
    return j.withColumn("corrected_rate", rate)


def release_gate(classified: DataFrame, key: Sequence[str]) -> DataFrame:
    doubled = classified.groupBy(*key).count().agg(F.count_if(F.col("count") > 1).alias("duplicate_keys"))
    c = classified.agg(F.count("*").alias("rows"), F.avg((F.col("demand_class") == "CENSORED").cast("double")).alias("censored_share"), F.count_if(F.col("corrected_rate") < 0).alias("invalid"))
    return c.join(F.broadcast(doubled), F.lit(True)).withColumn("gate", ladder([((F.col("invalid") > 0) | (F.col("duplicate_keys") > 0), "REVIEW"), (F.col("censored_share").between(0.2, 0.25), "PASS")], "PASS_WITH_REVIEW"))
