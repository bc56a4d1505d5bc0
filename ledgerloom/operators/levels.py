"""Revenue at every level of product category, location and month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.plans.levels import all_levels, rollup_sets
from ledgerloom.tables import Tables

DIMENSIONS = ["category", "location_id", "month"]


def _facts(t: Tables) -> DataFrame:
    """Sales per product, location, month and customer, then by category: products meet their names after the reduction."""
    month = F.trunc("transaction_date", "month").alias("month")
    reduced = t["sales_transactions"].groupBy("product_id", "location_id", month, "customer_id").agg(
        F.sum("total_revenue").alias("revenue"), F.sum("qty_sold").alias("units")
    )
    names = t["products"].select("product_id", "category")
    return reduced.join(names, "product_id", "left").drop("product_id")


def _priced(df: DataFrame) -> DataFrame:
    return df.select(*DIMENSIONS, "level", money(F.col("revenue")).alias("revenue"), "units", F.col("n_customer_id").alias("customers"))


def revenue_cube(t: Tables) -> DataFrame:
    """Revenue, units and different customers for every combination of category, location and month, with all subtotals.

    ``level`` tells which dimensions are summed over: 4 the category, 2 the location, 1 the month, added up.
    """
    return _priced(all_levels(_facts(t), DIMENSIONS, ["revenue", "units"], distinct="customer_id"))


def revenue_rollup(t: Tables) -> DataFrame:
    """The same along one path: category and location and month, category and location, category, everything."""
    return _priced(all_levels(_facts(t), DIMENSIONS, ["revenue", "units"], distinct="customer_id", sets=rollup_sets(DIMENSIONS)))
