"""Null- and zero-safe column expressions.

The analytics follow dataframe conventions that differ from SQL defaults: sums of
nothing are 0, comparisons with a missing value are false and still count in the
denominator of a share, and division by zero is missing rather than an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sum0(c: Column | str) -> Column:
    """Sum in which an all-null group gives 0."""
    return F.coalesce(F.sum(col(c)), F.lit(0.0))


def is_true(predicate: Column) -> Column:
    """A predicate whose NULL outcome counts as false."""
    return F.coalesce(predicate, F.lit(False))


def share_true(predicate: Column) -> Column:
    """Fraction of rows where the predicate holds; NULL outcomes stay in the denominator."""
    return F.avg(is_true(predicate).cast("double"))


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL when b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def elapsed_days(start: Column | str, end: Column | str) -> Column:
    """Fractional days from start to end."""
    return F.timestamp_diff("SECOND", col(start), col(end)) / F.lit(float(SECONDS_PER_DAY))


def whole_days(start: Column | str, end: Column | str) -> Column:
    """Elapsed days, floored (a negative duration floors away from zero)."""
    return F.floor(elapsed_days(start, end)).cast("long")


def guarded_days(start: Column | str, end: Column | str) -> Column:
    """Whole days, NULL when either end is missing or the order is reversed."""
    return F.when(col(end) >= col(start), whole_days(start, end))


def time_between(unit: str, start: Column | str, end: Column | str, mode: str = "elapsed") -> Column:
    """Distance in ``unit`` (MINUTE, HOUR, DAY).

    ``elapsed`` floors the elapsed time; ``boundary`` counts the unit boundaries crossed.
    """
    seconds = {"MINUTE": 60, "HOUR": 3600, "DAY": SECONDS_PER_DAY}[unit]
    if mode == "elapsed":
        return F.floor(F.timestamp_diff("SECOND", col(start), col(end)) / F.lit(float(seconds))).cast("long")
    if mode != "boundary":
        raise ValueError(f"mode must be 'elapsed' or 'boundary', not {mode!r}")
    if unit == "DAY":
        return F.datediff(F.to_date(col(end)), F.to_date(col(start))).cast("long")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    number = lambda ts: F.floor(F.timestamp_diff("SECOND", epoch, ts) / F.lit(float(seconds)))
    return (number(col(end)) - number(col(start))).cast("long")


def percent(c: Column, digits: int = 2) -> Column:
    """A share as percent, rounded half up."""
    return F.round(c * 100, digits)


def steady(c: Column | str, digits: int) -> Column:
    """Digits for comparing results: the cut lies at 0.495, where no exact tie can fall either way.

    For display of query results only; operators round with ``percent`` or ``round``.
    """
    scale = float(10**digits)
    return F.floor(col(c) * F.lit(scale) + F.lit(0.505)) / F.lit(scale)
