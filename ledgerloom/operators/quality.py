"""Data-quality figures of whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import zero_if_null
from ledgerloom.tables import MissingTable, Tables


def _missing(df: DataFrame, column: str) -> Column:
    c = F.col(f"`{column}`")
    if dict(df.dtypes)[column] in ("double", "float"):
        return c.isNull() | F.isnan(c)
    return c.isNull()


_BITS = 62  # columns per mask


def _distinct_rows(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """One row per distinct row of ``df``: how often it occurs (``n``), and masks of the columns it has no value in.

    Two independent 64-bit hashes, which cover the masks, stand for a row: one
    scan, and a few numbers per row in the shuffle. Among 10^12 different rows
    the chance that any two agree in both is about 10^-15.
    """
    masks = {}
    for start in range(0, len(df.columns), _BITS):
        bits = [F.when(_missing(df, c), 1 << i).otherwise(0) for i, c in enumerate(df.columns[start : start + _BITS])]
        masks[f"m{start}"] = reduce(lambda a, b: a + b, bits).cast("bigint")
    columns = [*masks.values(), *(F.col(f"`{c}`") for c in df.columns)]
    hashes = {"h1": F.xxhash64(*columns), "h2": F.xxhash64(F.lit("second"), *reversed(columns))}
    rows = df.select(*(c.alias(n) for n, c in {**hashes, **masks}.items()))
    found = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), *(F.bit_or(m).alias(m) for m in masks))
    return found, list(masks)


def _repeats() -> Column:
    return zero_if_null(F.sum(F.col("n") - 1)).alias("duplicate_rows")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one in every column."""
    return _distinct_rows(df)[0].agg(_repeats())


def _profile(name: str, df: DataFrame) -> DataFrame:
    found, masks = _distinct_rows(df)
    holes = reduce(lambda a, b: a + b, [F.bit_count(F.bit_or(m)) for m in masks])
    row = found.agg(
        zero_if_null(F.sum("n")).alias("rows"), zero_if_null(holes).alias("columns_with_nulls"), _repeats()
    )
    score = F.greatest(
        F.lit(0), 100 - F.col("columns_with_nulls") * 5 - F.least("duplicate_rows", F.lit(10)) * 2
    )
    return row.select(
        F.lit(name).alias("table_name"),
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        "columns_with_nulls",
        "duplicate_rows",
        score.cast("bigint").alias("quality_score"),
    )


def _stacked(frames: list[DataFrame]) -> DataFrame:
    if not frames:
        raise MissingTable("no table is loaded")
    return reduce(DataFrame.unionByName, frames)


def data_quality_report(t: Tables) -> DataFrame:
    """Size, columns with nulls, repeated rows and a score, one row per loaded table; one scan per table."""
    return _stacked([_profile(name, t[name]) for name in t.names])


def null_counts(t: Tables) -> DataFrame:
    """Number of nulls of every column that has any; one pass per table."""

    def of(name: str) -> DataFrame:
        df = t[name]
        counted = df.agg(*(F.count_if(_missing(df, c)).alias(f"n{i}") for i, c in enumerate(df.columns)))
        items = F.array(
            *(
                F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("null_count"))
                for i, c in enumerate(df.columns)
            )
        )
        return counted.select(F.lit(name).alias("table_name"), F.inline(items)).where(F.col("null_count") > 0)

    return _stacked([of(name) for name in t.names])


def check_quality(df: DataFrame, quantity: str = "quantity") -> DataFrame:
    """One row for one frame: repeats and any missing value cost 5 points each, negative quantities 10."""
    missing = reduce(lambda a, b: a + b, [F.count_if(_missing(df, c)) for c in df.columns])
    negative = F.count_if(F.col(quantity) < 0) if quantity in df.columns else F.lit(0).cast("bigint")
    row = df.agg(
        F.count(F.lit(1)).alias("total_rows"), missing.alias("missing_values"), negative.alias("negative_values")
    ).withColumn("duplicates", duplicate_rows(df).scalar())
    cost = (
        F.when(F.col("duplicates") > 0, 5).otherwise(0)
        + F.when(F.col("missing_values") > 0, 5).otherwise(0)
        + F.when(F.col("negative_values") > 0, 10).otherwise(0)
    )
    return row.select(
        F.greatest(F.lit(0), 100 - cost).alias("quality_score"),
        "duplicates",
        "missing_values",
        "negative_values",
        "total_rows",
        F.lit(len(df.columns)).alias("columns"),
    )


def quality_issues(df: DataFrame, quantity: str = "quantity") -> DataFrame:
    """The same as a list of issues."""
    kinds = [("duplicates", "warning"), ("missing_values", "warning"), ("negative_values", "error")]
    items = F.array(
        *(
            F.struct(F.lit(kind).alias("type"), F.col(kind).alias("count"), F.lit(severity).alias("severity"))
            for kind, severity in kinds
        )
    )
    return check_quality(df, quantity).select(F.inline(items)).where(F.col("count") > 0)
