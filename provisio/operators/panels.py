"""Monthly price panels: unit values of customs flows, means of quoted prices; long to work with, wide to hand out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(c: str) -> Column:
    """A finite number, else null."""
    v = F.expr(f"try_cast(`{c}` AS double)")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def unit_values(flows: DataFrame, month: str, code: str, weight: str, value: str, scale: float = 1000.0) -> DataFrame:
    """month, code and the mean unit value (value for scale units of weight) of the flows whose weight and value are both positive numbers. A mean of flows, not weighted."""
    w, v = _number(weight), _number(value)
    ok = flows.where((w > 0) & (v > 0) & F.col(month).isNotNull() & F.col(code).isNotNull())
    return ok.groupBy(F.col(month).alias("month"), F.col(code).alias("code")).agg(F.avg(v / w * scale).alias("price"))


def quoted_means(quotes: DataFrame, date: str, factor: str, price: str) -> DataFrame:
    """month (yyyy-MM), code and the mean of the prices that are numbers; quotes without a date or factor are left out."""
    day = F.try_to_timestamp(F.col(date).cast("string")).cast("date")
    ok = quotes.select(F.date_format(day, "yyyy-MM").alias("month"), F.col(factor).alias("code"), _number(price).alias("p")).dropna()
    return ok.groupBy("month", "code").agg(F.avg("p").alias("price"))


def wide(panel: DataFrame, codes: Sequence[str], most: int = 1000) -> DataFrame:
    """A row per month, a column per listed code; no price is null, and a code that isn't listed has no column. Codes are told, so that no job looks for them; more than most are an error, as columns don't scale."""
    if len(set(codes)) != len(codes) or len(codes) > most:
        raise ValueError(f"codes repeat, or are more than {most}")
    return panel.groupBy("month").pivot("code", list(codes)).agg(F.first("price", ignorenulls=True))
