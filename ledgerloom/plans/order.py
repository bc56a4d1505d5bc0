"""Running totals and ranks over a whole table without a one-task window.

Rows are dealt into slices, each a contiguous run of the wanted order; slice
totals give every slice its offset, and the remaining window is partitioned by
slice. Running totals cut slices at quantiles of the value, which come out the
same whenever they are computed, so nothing needs to be stored. Ranks in an
order of several columns have no such quantiles: their slice number comes from
a range partitioning and is materialised, as a recomputed one could cut
elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.cuts import cuts_upto
from ledgerloom.plans.lineage import materialize


def _slices(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    return materialize(df.repartitionByRange(_slices(df), *order).withColumn("_slice", F.spark_partition_id()))


def _quantiled(groups: DataFrame, value: str) -> DataFrame:
    """Slices of distinct values, largest first; nulls are a slice of their own behind them."""
    slices = _slices(groups)
    if slices < 2:
        return groups.withColumn("_slice", F.when(F.col(value).isNull(), 1).otherwise(0))
    shares = [i / slices for i in range(1, slices)]
    bounds = groups.agg(F.percentile_approx(value, shares, max(10_000, 20 * slices)).alias("b")).scalar()
    larger = F.size("_bounds") - cuts_upto(F.col("_bounds"), F.col(value), slices - 1)
    return (
        groups.withColumn("_bounds", bounds)
        .withColumn("_slice", F.when(F.col(value).isNull(), slices).otherwise(larger))
        .drop("_bounds")
    )


def _with_running(placed: DataFrame, order: list[Column], amount: Column, name: str) -> DataFrame:
    """``placed`` has its slice in ``_slice``; the result has ``name`` instead."""
    placed = placed.withColumn("_amount", amount)
    # At most one row per slice (spark.sql.shuffle.partitions rows and one), so
    # neither the unpartitioned window nor the broadcast grows with the data.
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_slice")
        .agg(F.sum("_amount").alias("_slice_amount"))
        .select("_slice", F.sum("_slice_amount").over(before).alias("_before"))
    )
    within = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.withColumn("_within", F.sum("_amount").over(within))
        .join(F.broadcast(offsets), "_slice")
        .withColumn(name, F.coalesce("_before", F.lit(0)) + F.coalesce("_within", F.lit(0)))
        .drop("_slice", "_amount", "_before", "_within")
    )


def running_groups(df: DataFrame, value: str) -> DataFrame:
    """One row per distinct ``value`` (exact numbers, not floating point): how many rows hold it (``members``) and
    the sum of all values not smaller than it (``running``).

    Equal values share one running total, and are merged before anything is
    sorted, so a value held by very many rows costs no more than another.
    """
    groups = df.groupBy(value).agg(F.count(F.lit(1)).alias("members"))
    order = [F.col(value).desc_nulls_last()]
    return _with_running(_quantiled(groups, value), order, F.col(value) * F.col("members"), "running")


def running_top(df: DataFrame, value: str, key: str, limit: int) -> DataFrame:
    """The ``limit`` largest rows of ``df`` with ``running``: the sum of all values not smaller, listed or not.

    All larger values are listed, so only rows that tie with the last listed
    value are missing; they are counted. The window sees the listed rows.
    """
    order = [F.col(value).desc_nulls_last()]
    top = df.orderBy(*order, F.col(key).asc_nulls_last()).limit(limit)
    least = top.agg(F.min(value).alias("v")).scalar()
    ties = df.where(F.col(value) == least).agg(F.count(F.lit(1)).alias("n")).scalar()
    so_far = F.sum(value).over(Window.orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    whole_list = Window.partitionBy()
    last = F.min(value).over(whole_list)
    return (
        top.select(*df.columns, so_far.alias("_so_far"), last.alias("_last"))
        .withColumn("_listed", F.count_if(F.col(value) == F.col("_last")).over(whole_list))
        .withColumn("_ties", ties)
        .withColumn(
            "running",
            F.coalesce("_so_far", F.lit(0))
            + F.when(F.col(value) == F.col("_last"), F.col("_last") * (F.col("_ties") - F.col("_listed"))).otherwise(0),
        )
        .drop("_so_far", "_last", "_listed", "_ties")
    )


def global_rank(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``position`` 1, 2, … in an order that must be total."""
    return _with_running(_ranged(df, order), order, F.lit(1).cast("bigint"), "position")
