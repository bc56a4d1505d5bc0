"""Classes that depend on a running share of a total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import as_double, half_up, money, quotient
from ledgerloom.plans.order import running_groups, running_top
from ledgerloom.plans.totals import BROADCAST_ROWS, total


def running_share(base: DataFrame, value: str, limit: int | None) -> DataFrame:
    """``base`` (one row per product; ``value`` is an exact number) with ``pct`` and ``cum_pct``.

    A top list takes its running totals from the listed rows. Otherwise they
    are kept per distinct value and joined back.
    """
    whole = as_double(total(base, F.sum(value)))
    if limit is not None and limit <= BROADCAST_ROWS:
        rows = running_top(base, value, "product_id", limit)
    else:
        groups = running_groups(base, value).select(F.col(value).alias("_value"), "running")
        rows = base
        if limit is not None:
            rows = base.orderBy(F.col(value).desc_nulls_last(), F.col("product_id").asc_nulls_last()).limit(limit)
        rows = groups.join(rows, F.col("_value").eqNullSafe(F.col(value)))
    return rows.withColumn("_whole", whole).select(
        *base.columns,
        (quotient(F.col(value), F.col("_whole")) * 100).alias("pct"),
        (quotient(F.col("running"), F.col("_whole")) * 100).alias("cum_pct"),
    )


def abc_class(cum_pct: Column) -> Column:
    return F.when(cum_pct <= 80, "A").when(cum_pct <= 95, "B").otherwise("C")


def xyz_class(variation: Column) -> Column:
    """Unknown variation (a single sale) counts as erratic."""
    return F.when(variation < 0.5, "X").when(variation < 1.0, "Y").otherwise("Z")


def revenue_classes(sales: DataFrame, limit: int | None) -> DataFrame:
    """One row per product, largest revenue first."""
    base = sales.groupBy("product_id").agg(
        F.sum("total_revenue").alias("rev"),
        F.stddev_samp("qty_sold").alias("deviation"),
        quotient(F.sum("qty_sold"), F.count("qty_sold")).alias("mean"),
    )
    variation = F.when(F.col("mean") > 0, F.col("deviation") / F.col("mean")).otherwise(0.0)
    return (
        running_share(base, "rev", limit)
        .select(
            "product_id",
            "rev",
            money(F.col("rev"), 2).alias("revenue"),
            half_up(F.col("pct"), 2).alias("revenue_pct"),
            abc_class(F.col("cum_pct")).alias("abc"),
            xyz_class(variation).alias("xyz"),
            F.round(variation, 6).alias("variability_score"),
        )
        .orderBy(F.col("rev").desc_nulls_last(), F.col("product_id").asc_nulls_last())
    )


def class_columns(classes: DataFrame, *columns: str) -> DataFrame:
    return classes.select("product_id", *columns)
