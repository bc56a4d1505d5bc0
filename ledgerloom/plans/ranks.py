"""Ranks, tiles and exact quantiles of whole tables and large groups, without a one-task window or a checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.cuts import cuts_upto
from ledgerloom.plans.timeline import slices_of


def _leading_bytes(df: DataFrame, key: str) -> Column:
    """A number in the order of the text ``key``: its seven bytes behind the prefix that all keys share."""
    ends = df.agg(F.struct(F.min(key).alias("lo"), F.max(key).alias("hi")).alias("e")).select("e.*")
    agree = "size(filter(sequence(1, least(length(lo), length(hi))), i -> substring(lo, 1, i) = substring(hi, 1, i)))"
    shared = ends.select(F.expr(f"CASE WHEN least(length(lo), length(hi)) > 0 THEN {agree} ELSE 0 END").alias("n")).scalar()
    rest = F.substring(F.col(key), shared + 1, F.lit(7))
    padded = F.rpad(F.hex(F.substring(F.encode(rest, "UTF-8"), 1, 7)), 14, "0")
    return F.conv(padded, 16, 10).cast("long")


def ranked(df: DataFrame, value: str, key: str, slices: int | None = None) -> DataFrame:
    """``df`` with ``position`` 1, 2, ... by ``value`` descending (nulls last) and ``key``, a text without repeats.

    Slices are cut at quantiles of the value. A value that fills several of them is spread over them in the order of its
    keys, so rows that tie are no hot spot either.
    """
    n = slices or slices_of(df)
    if n > 1:
        shares = [i / n for i in range(1, n)]
        accuracy = max(10_000, 20 * n)
        # Nulls stand behind all numbers; they are spread like a value that fills slices.
        cuts = df.agg(F.struct(F.percentile_approx(-F.col(value).cast("double"), shares, accuracy).alias("v"), F.count_if(F.col(value).isNull()).alias("nulls"), F.count(F.lit(1)).alias("n")).alias("c")).scalar()
        ids = df.select(_leading_bytes(df, key).alias("k"))
        marks = ids.agg(F.percentile_approx("k", shares, accuracy).alias("k")).scalar()
        placed = df.withColumn("_cuts", cuts).withColumn("_marks", marks).withColumn("_v", -F.col(value).cast("double")).withColumn("_k", _leading_bytes(df, key))
        below = cuts_upto(F.col("_cuts.v"), F.col("_v"), n - 1, strict=True)
        upto = cuts_upto(F.col("_cuts.v"), F.col("_v"), n - 1)
        share = cuts_upto(F.col("_marks"), F.col("_k"), n - 1) / F.lit(float(n))
        spread = F.when(F.col("_v").isNull(), F.lit(n) + F.floor(share * n)).when(
            upto > below, below + F.least(F.floor(share * (upto - below + 1)), upto - below)
        ).otherwise(below)
        placed = placed.withColumn("_slice", spread.cast("int")).drop("_cuts", "_marks", "_v", "_k")
    else:
        placed = df.withColumn("_slice", F.lit(0))
    # One row per slice, at most twice their number.
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(F.col("_slice"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_slice").orderBy(F.col(value).desc_nulls_last(), F.col(key).asc_nulls_last())
    return (
        placed.withColumn("_inside", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_slice")
        .withColumn("position", F.col("_before") + F.col("_inside"))
        .drop("_slice", "_before", "_inside")
    )


def tile(position: Column, rows: Column, tiles: int) -> Column:
    """Which of ``tiles`` nearly equal runs of ``rows`` positions a position lies in; the first ones are one longer."""
    size, longer = F.floor(rows / tiles), rows % tiles
    head = longer * (size + 1)
    return (
        F.when(position <= head, F.floor((position - 1) / (size + 1)))
        .otherwise(longer + F.floor((position - 1 - head) / F.greatest(size, F.lit(1))))
        .cast("int") + 1
    )


def quantiles_by(df: DataFrame, by: list[str], value: str, shares: list[float], slices: int | None = None) -> DataFrame:
    """Exact quantiles per group: ``by``, ``share``, ``quantile``, ``members``. Null values do not count; a group without
    others has no row. A quantile is the smallest value that at least the share of the members do not exceed.

    First pass: equal values of a group are merged, and counted per slice of the value; slices are cut at quantiles over
    all groups, so no (group, slice) holds more than a slice. Second pass: only the slices that hold a wanted rank are
    ordered. A group that has half the rows costs no task more than another.
    """
    n = slices or slices_of(df)
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    if n > 1:
        cuts = known.agg(F.percentile_approx(F.col(value).cast("double"), [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("c")).scalar()
        counts = counts.withColumn("_cuts", cuts).withColumn("_slice", cuts_upto(F.col("_cuts"), F.col(value).cast("double"), n - 1)).drop("_cuts")
    else:
        counts = counts.withColumn("_slice", F.lit(0))
    sizes = counts.groupBy(*by, "_slice").agg(F.sum("_n").alias("_size"))
    # At most one row per group and slice.
    group = Window.partitionBy(*by)
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).withColumn("members", F.sum("_size").over(group))
    wanted = sizes.withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares))))
    rank = F.greatest(F.lit(1), F.col("members") - F.floor(F.col("members") - F.col("share") * F.col("members")))
    wanted = wanted.withColumn("_rank", rank).where((F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_size")))
    wanted = wanted.select(*(F.col(b).alias(f"_g{i}") for i, b in enumerate(by)), F.col("_slice").alias("_s"), "share", "_rank", "_before", "members")
    alike = F.col("_slice") == F.col("_s")
    for i, b in enumerate(by):
        alike &= F.col(b).eqNullSafe(F.col(f"_g{i}"))
    needed = wanted.select(*(f"_g{i}" for i in range(len(by))), "_s").distinct()
    so_far = Window.partitionBy(*by, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ordered = counts.join(needed, alike, "left_semi").withColumn("_upto", F.sum("_n").over(so_far))
    return (
        ordered.join(wanted, alike)
        .where(F.col("_before") + F.col("_upto") >= F.col("_rank"))
        .groupBy(*by, "share")
        .agg(F.min(value).alias("quantile"), F.max("members").alias("members"))
    )
