"""Column expressions with the semantics that the features need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero(c: Column | str) -> Column:
    """Null becomes 0; NaN stays."""
    return F.coalesce(col(c), F.lit(0))


def zsum(c: Column | str) -> Column:
    """A sum that is 0 over nothing."""
    return F.coalesce(F.sum(col(c)), F.lit(0.0))


def sum_if(cond: Column, c: Column | str) -> Column:
    return zsum(F.when(cond, col(c)))


def count_all() -> Column:
    return F.count(F.lit(1))


def nunique(c: Column | str) -> Column:
    """Number of distinct values; null is one of them."""
    c = col(c)
    return F.countDistinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))


def iso_weekday(c: Column | str) -> Column:
    """Monday is 1."""
    return F.weekday(col(c)) + 1


def is_night(c: Column | str) -> Column:
    return (F.hour(col(c)) >= 22) | (F.hour(col(c)) < 6)


def whole_seconds(start: Column | str, end: Column | str) -> Column:
    """Elapsed whole seconds; not the number of second boundaries that are crossed."""
    return F.timestamp_diff("SECOND", col(start), col(end))


def whole_days(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("DAY", col(start), col(end))


def ratio(a: Column | str, b: Column | str, add: float = EPS) -> Column:
    return col(a) / (col(b) + F.lit(add))


def clean_number(c: Column | str, most: float | None = None) -> Column:
    """NaN becomes 0, and so does an infinite value, unless most is given: then that, with its sign."""
    c = col(c)
    inf = F.lit(0.0) if most is None else F.when(c > 0, F.lit(most)).otherwise(F.lit(-most))
    return F.when(F.isnan(c), 0.0).when(F.abs(c) == float("inf"), inf).otherwise(c)


#: Where rounding goes up: not just at a half, where sums that differ in their last bit would part.
HALF = 0.5013
#: From 10**9 on, to this power of ten, values have 11 digits.
COARSE = range(9, 20)


def quantised(c: Column | str) -> Column:
    """Rounded, by one formula that engines share, to 6 decimals, or to 11 digits where that is less: from 1e9 on, where a double
    sum is not exact to 6 decimals. The relative error stays below 1e-10."""
    c = col(c).cast("double")
    out = F.when(F.abs(c) < 1e9, F.floor(c * 1e6 + HALF) / 1e6).when(F.abs(c) < 1e10, F.floor(c * 10.0 + HALF) / 10.0)
    for k in COARSE[1:]:
        step = float(10 ** (k - 10))
        rounded = F.floor(c / step + HALF) * step
        out = out.when(F.abs(c) < float(10 ** (k + 1)), rounded)
    return out.otherwise(c) + 0.0
