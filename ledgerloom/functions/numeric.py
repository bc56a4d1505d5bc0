"""Casting and rounding policy.

Money is summed as DECIMAL (exact, so independent of partitioning) and turned
into DOUBLE once, at the end. Every division is done in DOUBLE: DECIMAL
division would keep only a limited scale.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(c: Column) -> Column:
    return c.cast("double")


def money(c: Column, places: int | None = None) -> Column:
    """A DECIMAL total as DOUBLE, rounded while still exact."""
    return as_double(c if places is None else F.round(c, places))


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def quotient(numerator: Column, denominator: Column) -> Column:
    """DOUBLE division; null where the denominator is null or zero."""
    return as_double(numerator) / F.nullif(as_double(denominator), F.lit(0.0))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: sum(value * weight) / sum(weight); a null value keeps its weight."""
    return quotient(F.sum(value * weight), F.sum(weight))


def distinct(column: str, approximate: bool = False) -> Column:
    """Aggregate: number of different values; approximately, it needs no shuffle of the values."""
    return F.approx_count_distinct(column) if approximate else F.count_distinct(column)


def half_even(c: Column, places: int = 0) -> Column:
    """A DOUBLE rounded to the nearest decimal, judged on its exact binary value, ties to even.

    ``bround`` would judge the printed digits instead: 0.15 is a little less
    than it prints and belongs to 0.1. Infinities, whose text is no number, stay as they are.
    """
    printed = F.replace(F.format_number(as_double(c), places), F.lit(","), F.lit(""))
    return F.coalesce(printed.try_cast("double"), as_double(c))


def half_up(c: Column, places: int) -> Column:
    """A DOUBLE scaled, rounded with ties away from zero, and scaled back: rounding as SQL engines do it."""
    scale = float(10**places)
    return F.round(as_double(c) * scale) / scale


def level(c: Column, high: float, medium: float) -> Column:
    """'high' above one bound, 'medium' above the other, else (also for null) 'low'."""
    return F.when(c > high, "high").when(c > medium, "medium").otherwise("low")
