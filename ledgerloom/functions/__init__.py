"""Column helpers that fix how money, ratios and roundings behave."""

from ledgerloom.functions.numeric import (
    as_double,
    distinct,
    half_even,
    half_up,
    level,
    money,
    quotient,
    weighted_mean,
    zero_if_null,
)

__all__ = ["as_double", "distinct", "half_even", "half_up", "level", "money", "quotient", "weighted_mean", "zero_if_null"]
