"""One-row aggregates put next to other rows without a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def total(df: DataFrame, aggregate: Column) -> Column:
    """A global aggregate of ``df`` as a scalar for use in another frame.

    Partial sums are combined in one tiny shuffle, where an unpartitioned
    window would move every row to one task.
    """
    return df.agg(aggregate.alias("total")).scalar()


# A frame limited to this many rows may be broadcast whatever the size of its source.
BROADCAST_ROWS = 100_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Marks a frame of at most ``rows`` rows for broadcast if that bound is small enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def side_by_side(spark: SparkSession, sections: list[DataFrame]) -> DataFrame:
    """One row holding the columns of several one-row frames.

    Each section is an independent scalar subquery; Spark runs them at the same time.
    """
    packed = [
        section.select(F.struct(*(F.col(c) for c in section.columns)).alias("s")).scalar().alias(f"s{i}")
        for i, section in enumerate(sections)
    ]
    columns = [F.col(f"s{i}.{c}") for i, section in enumerate(sections) for c in section.columns]
    return spark.range(1).select(*packed).select(*columns)


def unpivot_row(row: DataFrame, rows: list[list[Column]], names: list[str]) -> DataFrame:
    """Turns one wide row into several narrow ones."""
    items = F.array(*(F.struct(*(c.alias(n) for c, n in zip(cells, names))) for cells in rows))
    return row.select(F.inline(items))
