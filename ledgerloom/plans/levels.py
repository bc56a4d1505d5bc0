"""Totals at every combination of some dimensions, each level computed from a finer one."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def all_levels(df: DataFrame, dimensions: list[str], sums: list[str], distinct: str | None = None, sets: list[tuple[str, ...]] | None = None) -> DataFrame:
    """Every grouping set of ``dimensions`` (or those in ``sets``): the dimensions (null where summed over), ``level``,
    the ``sums`` and, as ``n_<distinct>``, how many different non-null values of that column occur.

    ``level`` has a bit for each dimension that is summed over, the last dimension the lowest, so that a null dimension
    value is told from a total. Facts are read and reduced once, to one row per cell and distinct value; a coarser level
    reads the rows of a finer one, so distinct counts stay exact without keeping rows of facts.
    """
    key = [distinct] if distinct else []
    frames = {tuple(dimensions): df.groupBy(*dimensions, *key).agg(*(F.sum(s).alias(s) for s in sums))}
    for size in range(len(dimensions) - 1, -1, -1):
        for some in combinations(dimensions, size):
            # The finer level by one dimension: the last that is missing here.
            finer = tuple(d for d in dimensions if d in some or d == [x for x in dimensions if x not in some][-1])
            frames[some] = frames[finer].groupBy(*some, *key).agg(*(F.sum(s).alias(s) for s in sums))
    parts = []
    for some, frame in frames.items():
        if sets is not None and some not in [tuple(s) for s in sets]:
            continue
        if distinct:
            frame = frame.groupBy(*some).agg(*(F.sum(s).alias(s) for s in sums), F.count(distinct).alias(f"n_{distinct}"))
        level = sum(1 << (len(dimensions) - 1 - i) for i, d in enumerate(dimensions) if d not in some)
        cells = [F.col(d) if d in some else F.lit(None).cast(df.schema[d].dataType).alias(d) for d in dimensions]
        counted = [f"n_{distinct}"] if distinct else []
        parts.append(frame.select(*cells, F.lit(level).alias("level"), *sums, *counted))
    return reduce(DataFrame.unionByName, parts)


def rollup_sets(dimensions: list[str]) -> list[tuple[str, ...]]:
    return [tuple(dimensions[:n]) for n in range(len(dimensions), -1, -1)]
