"""Ledger cleaning, quality rules and the monthly roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provisio.functions import safe_divide
from provisio.operators.ordered import running

TOLERANCE = 1e-9
MOVES = ("purchase_in_qty", "transfer_in_qty", "return_in_qty", "transfer_out_qty", "consumption_qty", "return_out_qty", "disposal_qty", "auto_disposal_adjustment_qty", "correction_out_qty")
KEEP_NULL = ("opening_stock", "closing_stock", "unit_price")


def normalized(raw: DataFrame, keys: tuple[str, ...] = ("institution_code", "department", "item_code"), date: str = "closing_date", date_format: str = "yyyyMMdd") -> DataFrame:
    """Text rows to typed rows: dates, trimmed keys, collapsed names, numbers. Movements without a number are 0;
    stocks and prices stay null. Rows with a blank key or without a date are dropped."""
    out = raw.withColumn(date, F.try_to_timestamp(F.col(date).cast("string"), F.lit(date_format)).cast("date"))
    out = out.withColumns({k: F.trim(F.col(k).cast("string")) for k in keys if k in raw.columns})
    if "item_name" in raw.columns:
        out = out.withColumn("item_name", F.trim(F.regexp_replace("item_name", r"\s+", " ")))
    number = lambda c: F.expr(f"try_cast(trim(cast(`{c}` as string)) as double)")
    out = out.withColumns({c: F.coalesce(number(c), F.lit(0.0)) for c in MOVES if c in raw.columns} | {c: number(c) for c in KEEP_NULL if c in raw.columns})
    filled = F.col(date).isNotNull()
    for k in keys:
        filled = filled & (F.coalesce(F.col(k), F.lit("")) != "")
    return out.where(filled).withColumn("year_month", F.trunc(date, "MM"))


def nonnegative(c: Column) -> Column:
    return F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))


def physical_available() -> Column:
    """Stock that can leave: opening and inbound, each at least 0."""
    return sum((nonnegative(F.col(c)) for c in ("purchase_in_qty", "transfer_in_qty", "return_in_qty")), nonnegative(F.col("opening_stock")))


def physical_violation(tolerance: float = TOLERANCE) -> Column:
    return F.col("opening_stock").isNotNull() & (nonnegative(F.col("consumption_qty")) > physical_available() + tolerance)


def document_violation(tolerance: float = TOLERANCE) -> Column:
    """The audit rule on raw values."""
    return F.col("opening_stock").isNotNull() & (F.col("consumption_qty") > F.col("opening_stock") + F.col("purchase_in_qty") + tolerance)


def balance_residual() -> Column:
    """Closing minus what the movements give; null unless both ends are known. Auto-disposal isn't in it."""
    c = F.col
    expected = c("opening_stock") + c("purchase_in_qty") + c("transfer_in_qty") + c("return_in_qty") - c("transfer_out_qty") - c("consumption_qty") - c("return_out_qty") - c("disposal_qty") - c("correction_out_qty")
    return c("closing_stock") - expected


def flagged(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "physical_violation": physical_violation().cast("int"), "document_violation": document_violation().cast("int"),
        "opening_missing": F.col("opening_stock").isNull().cast("int"), "balance_residual": balance_residual(),
    })


def _at(c: str, order: list[str], last: bool) -> Column:
    """First or last non-null value by order."""
    known = F.when(F.col(c).isNotNull(), F.struct(*order))
    return (F.max_by if last else F.min_by)(F.col(c), known)


def monthly(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key and month. Spark aggregates map-side before the shuffle, so partials need no own step."""
    used = nonnegative(F.col("consumption_qty"))
    count_if = lambda c: F.count_if(c)
    aggs = [
        F.min("closing_date").alias("first_date"), F.max("closing_date").alias("last_date"), _at("item_name", order, True).alias("item_name"),
        _at("opening_stock", order, False).alias("month_start_stock"), _at("closing_stock", order, True).alias("month_end_stock"),
        F.min("closing_stock").alias("min_stock"), F.max("closing_stock").alias("max_stock"), F.sum("closing_stock").alias("stock_sum"), F.count("closing_stock").alias("stock_observation_count"),
        count_if(F.col("closing_stock") == 0).alias("stockout_count"), count_if(F.col("closing_stock") < 0).alias("negative_stock_count"),
        F.sum("unit_price").alias("price_sum"), F.count("unit_price").alias("price_count"), F.coalesce(F.sum("balance_residual"), F.lit(0.0)).alias("balance_residual_sum"),
        *(F.sum(m).alias(m) for m in MOVES), F.sum(used).alias("outbound_sum"), F.sum(used * used).alias("outbound_squared_sum"),
        F.sum("physical_violation").alias("physical_violation_count"), F.sum("document_violation").alias("document_violation_count"), F.sum("opening_missing").alias("opening_missing_count"),
        count_if(F.abs("balance_residual") > TOLERANCE).alias("balance_violation_count"), F.count("*").alias("row_count"),
    ]
    return rows.groupBy(*keys).agg(*aggs)


def derived(fact: DataFrame) -> DataFrame:
    """Averages, rates and totals of the monthly fact; rates without observations are null."""
    c = F.col
    return fact.withColumns({
        "average_stock": F.try_divide("stock_sum", "stock_observation_count"), "average_unit_price": F.try_divide("price_sum", "price_count"),
        "stockout_rate": F.try_divide("stockout_count", "stock_observation_count"), "inbound_qty": c("purchase_in_qty") + c("transfer_in_qty") + c("return_in_qty"),
        "other_outbound_qty": c("transfer_out_qty") + c("return_out_qty") + c("disposal_qty") + c("correction_out_qty"), "net_stock_change": c("month_end_stock") - c("month_start_stock"),
        "stock_item_key": F.concat_ws("::", "institution_code", "department", "item_code"),
    })


def summary(fact: DataFrame) -> DataFrame:
    return fact.agg(
        F.count("*").alias("rows"), F.min("year_month").alias("first_month"), F.max("year_month").alias("last_month"), F.count_distinct("year_month").alias("months"),
        F.count_distinct("institution_code").alias("institutions"), F.count_distinct("department").alias("departments"), F.count_distinct("item_code").alias("items"), F.count_distinct("stock_item_key").alias("series"),
        F.sum("balance_violation_count").alias("balance_violations"), F.sum("physical_violation_count").alias("physical_violations"),
    )


def issue_sizes(rows: DataFrame, qty: str = "consumption_qty") -> DataFrame:
    """Frequency of positive issue sizes with the running share, a row per size."""
    sizes = rows.where(F.col(qty) > 0).groupBy(F.col(qty).alias("q")).agg(F.count("*").alias("n"))
    return running(sizes, "n", [F.col("q")]).select("q", "n", F.col("__cum").alias("cum"), F.col("__all").alias("total"))


__all__ = ["safe_divide", "normalized", "flagged", "monthly", "derived", "summary", "issue_sizes"]
