"""Guarded arithmetic as Spark columns.

Batch and online features differ in how they treat near-zero divisors and negative logarithms, so both
rules are here under their own names. NaN and infinities become NULL at every step.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8
INFINITY = float("inf")


def finite(c: Column) -> Column:
    """NULL for NaN and both infinities."""
    return F.when(F.abs(c) < F.lit(INFINITY), c)


def numeric(c: Column) -> Column:
    """Double where the value can be read as one, else NULL."""
    return finite(c.try_cast("double"))


def safe_divide(n: Column, d: Column, epsilon: float = EPSILON) -> Column:
    """Batch rule: NULL where |d| < epsilon."""
    return finite(F.when(F.abs(d) >= F.lit(epsilon), n / d))


def safe_ratio(n: Column, d: Column, epsilon: float = EPSILON) -> Column:
    """Online rule: NULL where |d| <= epsilon."""
    return finite(F.when(F.abs(d) > F.lit(epsilon), n / d))


def safe_log1p(c: Column) -> Column:
    """Batch rule: NULL at and below -1."""
    return finite(F.when(c > F.lit(-1.0), F.log1p(c)))


def clamped_log1p(c: Column) -> Column:
    """Online rule: negative values count as 0."""
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def safe_sqrt(c: Column) -> Column:
    """Square root of the value or 0, whichever is larger; NULL stays NULL."""
    return F.when(c.isNotNull(), F.sqrt(F.greatest(c, F.lit(0.0))))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it doesn't or is NULL."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def null_count(columns: list[str]) -> Column:
    """How many of the columns are NULL in a row."""
    total = F.lit(0)
    for c in columns:
        total = total + F.col(f"`{c}`").isNull().cast("int")
    return total


def machine_key(c: Column) -> Column:
    """Trimmed machine id; null and blank ids share the default key."""
    return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit("__DEFAULT_MACHINE__"))


def seconds_between(later: Column, earlier: Column) -> Column:
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(1e6)
