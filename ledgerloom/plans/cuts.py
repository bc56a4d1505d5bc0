"""Finding the slice of a value among ascending cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cuts_upto(cuts: Column, at: Column, most: int, strict: bool = False) -> Column:
    """How many of the at most ``most`` ascending ``cuts`` are not after ``at`` (``strict``: before it); 0 for a null.

    A binary search: a row costs the logarithm of the number of cuts, which grows with the session's partitions.
    """
    steps = [1 << i for i in reversed(range(max(most, 1).bit_length()))]

    def search(x: Column) -> Column:
        cut = lambda i, step: F.get(cuts, i + step - 1)
        fits = (lambda i, step: cut(i, step) < x) if strict else (lambda i, step: cut(i, step) <= x)
        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda i, step: F.when(fits(i, step), i + step).otherwise(i))

    # An array of one, so that ``at`` is computed once and not in every step.
    return F.get(F.transform(F.array(at), search), F.lit(0))
