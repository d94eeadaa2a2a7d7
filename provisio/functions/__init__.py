"""Scalar and aggregate expressions that the operators share; all are built-in column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(n: Column, d: Column) -> Column:
    """n / d, and 0 where d is 0 or either is null."""
    return F.coalesce(F.try_divide(n, d), F.lit(0.0))


def read_year_month(c: Column) -> Column:
    """First day of a yyyymm value, padded to six digits; null where it isn't one."""
    return F.try_to_timestamp(F.lpad(F.trim(c.cast("string")), 6, "0"), F.lit("yyyyMM")).cast("date")


def clip(c: Column, low: float | None, high: float | None) -> Column:
    """c within bounds; null stays null."""
    out = c if low is None else F.greatest(c, F.lit(float(low)))
    out = out if high is None else F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def truthy(c: Column) -> Column:
    """Boolean from text: true, t, 1, yes, y in any case; null is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "t", "1", "yes", "y"), F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def first_filled(*cs: Column) -> Column:
    """The first that is neither null nor blank, else the empty string."""
    return F.coalesce(*(blank_to_null(c) for c in cs), F.lit(""))


def stable_id(prefix: str, c: Column, n: int = 20) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, n))


def split_codes(c: Column) -> Column:
    """Trimmed, distinct, non-blank codes of a ;-joined text."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != ""))


def join_unique(c: Column, limit: int = 20) -> Column:
    """Aggregate: sorted distinct non-blank values, joined by ;."""
    return F.array_join(F.slice(F.array_sort(F.collect_set(blank_to_null(c))), 1, limit), ";")


def single_or_blank(c: Column) -> Column:
    """Aggregate: the one distinct non-blank value, else the empty string."""
    v = blank_to_null(c)
    return F.when(F.min(v) == F.max(v), F.min(v)).otherwise(F.lit(""))


def geometric_mean(parts: Sequence[Column]) -> Column:
    """0 if any part is at most 0 (or null), else exp of the mean logarithm."""
    bad = F.lit(False)
    for p in parts:
        bad = bad | p.isNull() | (p <= 0)
    return F.when(bad, F.lit(0.0)).otherwise(F.exp(sum((F.ln(p) for p in parts), F.lit(0.0)) / len(parts)))


def noisy_or(c: Column) -> Column:
    """Aggregate: 1 - product of (1 - c)."""
    return F.lit(1.0) - F.product(F.lit(1.0) - c)


def ladder(pairs: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """The first true condition's value."""
    out = None
    for cond, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def last_wins(pairs: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """The last true condition's value, as masks that are applied one after another leave it."""
    return ladder(list(pairs)[::-1], default)


def flags(pairs: Sequence[tuple[Column, str]]) -> Column:
    """Labels of the true conditions, in order, as an array."""
    return F.filter(F.array(*(F.when(c, F.lit(v)) for c, v in pairs)), lambda x: x.isNotNull())


def correlation(x: str, y: str) -> Column:
    """Pearson's r over rows where both are known; null where one of them doesn't vary, for which corr() fails in ANSI mode."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
