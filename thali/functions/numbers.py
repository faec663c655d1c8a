"""Exact money sums, shares and averages.

Money stays ``DECIMAL`` until the final value, so sums are exact and agree
with any other engine; shares are computed in integer arithmetic, so the
rounding is exact half-away-from-zero with no double-rounding edge cases.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def money(col: Column | str) -> Column:
    """Final money value as double (the reference casts Decimal to float)."""
    return _c(col).cast("double")


def money_sum(col: Column | str) -> Column:
    """``COALESCE(SUM(x), 0)`` over decimals, as double."""
    return F.coalesce(F.sum(_c(col)), F.lit(0)).cast("double")


def plain_float_text(col: Column | str) -> Column:
    """A double as ``str(float)`` of Python writes it: plain digits from 0.0001
    up to 10^16, else an exponent of at least two digits."""
    c = _c(col).cast("double")
    java = c.cast("string")
    size = F.abs(c)
    digits = F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    short = F.regexp_replace(F.regexp_replace(java, r"\.0E", "E"), "E(-?)([0-9])$", "e$10$2")
    exponent = F.regexp_replace(F.regexp_replace(short, "E", "e"), r"e(\d)", "e+$1")
    return (F.when((size == 0) | F.isnan(c) | ((size >= 1e-3) & (size < 1e7)), java)
            .when((size >= 1e-4) & (size < 1e16), plain).otherwise(exponent))


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double, 0 when the denominator is 0 or NULL."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def _idiv(a: Column, b: Column) -> Column:
    """Exact integer ``a div b`` for non-negative longs (``b > 0``)."""
    return F.call_function("div", a, b)


def pct1(part: Column, total: Column) -> Column:
    """``ROUND(part * 100.0 / total, 1)`` for non-negative counts; 0 when total is 0."""
    part, total = part.cast("long"), total.cast("long")
    tenths = _idiv(part * 2000 + total, total * 2)
    return F.when(total > 0, tenths / 10.0).otherwise(F.lit(0.0))


def pct0(part: Column, total: Column) -> Column:
    """Whole-number share ``round(part / total * 100)``; 0 when total is 0."""
    part, total = part.cast("long"), total.cast("long")
    return F.when(total > 0, _idiv(part * 200 + total, total * 2)).otherwise(F.lit(0).cast("long"))
