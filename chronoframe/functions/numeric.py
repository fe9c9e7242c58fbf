"""Scalar functions with IEEE semantics, as Columns.

Spark orders NaN above all numbers and raises on division by zero; these helpers give
NaN the meaning of a missing value once and for all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def nan() -> Column:
    return F.lit(NAN)


def ok(value: Column) -> Column:
    """The value, or null where it is NaN."""
    return F.when(~F.isnan(value), value)


def _both(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b)


def compare(op: str, a: Column, b: Column) -> Column:
    """A comparison that NaN fails, but that holds NaN equal to NaN."""
    match op:
        case "==":
            return a == b
        case "!=":
            return a != b
        case ">":
            return _both(a, b) & (a > b)
        case ">=":
            return _both(a, b) & (a >= b)
        case "<":
            return _both(a, b) & (a < b)
        case "<=":
            return _both(a, b) & (a <= b)
    raise ValueError(f"unknown comparison {op!r}")


def _keep(op: str) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.when(compare(op, a, b), a).otherwise(nan())


def _cmp(a: Column, b: Column) -> Column:
    """-1, 0 or 1; a NaN on the left is less, one on the right (or on both sides) is greater."""
    return F.when(F.isnan(b), 1.0).when(F.isnan(a), -1.0).when(a < b, -1.0).when(a > b, 1.0).otherwise(0.0)


#: The twenty binary operators of joins. Comparisons give the left value or NaN.
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "abs_diff": lambda a, b: F.abs(a - b),
    "avg": lambda a, b: (a + b) / 2,
    "cmp": _cmp,
    "coalesce": lambda a, b: F.nanvl(a, b),
    "div": lambda a, b: F.when(b == 0, nan()).otherwise(a / F.when(b != 0, b)),
    "mod": lambda a, b: F.when(b == 0, nan()).otherwise(a % F.when(b != 0, b)),
    "mul": lambda a, b: a * b,
    "pow": lambda a, b: F.when((a == 1) | (b == 0), 1.0).otherwise(F.pow(a, b)),
    "sub": lambda a, b: a - b,
    "sum": lambda a, b: a + b,
    "min": lambda a, b: F.least(F.nanvl(a, b), F.nanvl(b, a)),
    "max": lambda a, b: F.greatest(F.nanvl(a, b), F.nanvl(b, a)),
    "eq": _keep("=="),
    "ne": _keep("!="),
    "gt": _keep(">"),
    "gte": _keep(">="),
    "lt": _keep("<"),
    "lte": _keep("<="),
    "pct_change": lambda a, b: F.when(a == 0, 0.0).otherwise((b - a) / F.when(a != 0, a)),
    "sgn_diff": lambda a, b: F.when(F.isnan(a - b), nan()).when(a - b < 0, -1.0).otherwise(1.0),
}


def _half_away(x: Column) -> Column:
    """Rounds to a whole double, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5).cast("double")


def round_decimals(value: Column, digits: int) -> Column:
    """Rounds to ``digits`` (0 to 16) decimals; values too large to have any stay as they are."""
    if not 0 <= digits <= 16:
        raise ValueError("decimal digits must be 0 to 16")
    factor = 10.0**digits
    scaled = value * factor
    plain = F.isnan(value) | (F.abs(scaled) >= 2.0**53)
    return F.when(plain, value).otherwise(_half_away(F.when(~plain, scaled)) / factor)


def round_significant(value: Column, digits: int) -> Column:
    """Rounds to ``digits`` (1 to 16) significant digits; 16 changes nothing."""
    if not 1 <= digits <= 16:
        raise ValueError("significant digits must be 1 to 16")
    if digits == 16:
        return value
    plain = F.isnan(value) | (F.abs(value) == float("inf")) | (value == 0)
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.when(~plain, F.abs(value)))))
    return F.when(plain, value).otherwise(_half_away(value * scale) / scale)
