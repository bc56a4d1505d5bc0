"""Partial results per day that are kept and merged, so that a period is answered without its facts.

Sums of a day are exact decimals; different products and customers are kept as HyperLogLog sketches, which merge to the
sketch of the union. ``sources/daily.py`` stores both day by day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import half_even, money, quotient, zero_if_null
from ledgerloom.plans.totals import side_by_side
from ledgerloom.tables import Tables

# log2 of the sketch's registers. Up to about 3,000 values a sketch is a list and its estimate the exact count; beyond,
# the standard error is 1.04 / sqrt(2^15), 0.6 %. A full sketch takes 16 to 32 KB.
SKETCH = 15
SUM = "decimal(38,4)"


def sales_state(t: Tables, by: tuple[str, ...] = ()) -> DataFrame:
    """Per day (and ``by``, e.g. a product): revenue, units, and sketches of the products and customers."""
    return (
        t["sales_transactions"]
        .groupBy("transaction_date", *by)
        .agg(
            F.sum("total_revenue").cast(SUM).alias("revenue"),
            F.sum("qty_sold").alias("units"),
            F.hll_sketch_agg("product_id", F.lit(SKETCH)).alias("products"),
            F.hll_sketch_agg("customer_id", F.lit(SKETCH)).alias("customers"),
        )
    )


def _merged(states: DataFrame, *keys: Column | str) -> DataFrame:
    estimate = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c, F.lit(True)))
    return states.groupBy(*keys).agg(
        money(F.sum("revenue")).alias("revenue"), F.sum("units").alias("units"), estimate("products").alias("products"), estimate("customers").alias("customers")
    )


def trends_from_states(states: DataFrame, granularity: str = "monthly") -> DataFrame:
    """Revenue, units and estimated numbers of products and customers per period, from ``sales_state`` alone."""
    unit = {"daily": None, "weekly": "week"}.get(granularity, "month")
    date = F.col("transaction_date")
    return _merged(states, (F.trunc(date, unit) if unit else date).alias("period"))


def reach_from_states(states: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Per product over the days from ``first`` to ``last``: revenue, units, estimated number of customers. Needs states
    kept by product."""
    day = F.col("transaction_date")
    for bound, side in ((first, day >= F.lit(first).cast("date")), (last, day <= F.lit(last).cast("date"))):
        states = states.where(side) if bound else states
    return _merged(states, "product_id").drop("products")


def revenue_trends_sketched(t: Tables, granularity: str = "monthly") -> DataFrame:
    return trends_from_states(sales_state(t), granularity)


def customer_reach(t: Tables, first: str | None = None, last: str | None = None) -> DataFrame:
    return reach_from_states(sales_state(t, ("product_id",)), first, last)


# Per source of the headline figures: its day, the amount, and the days it is weighted by.
SOURCES = {
    "inventory_snapshot": ("snapshot_date", "inventory_value", None),
    "sales_transactions": ("transaction_date", "total_cost", None),
    "ar_ledger": ("invoice_date", "invoice_amount", "days_to_pay"),
    "ap_ledger": ("invoice_date", "invoice_amount", "actual_days_to_pay"),
}
KPI_STATE = f"source string, day date, amount {SUM}, weighted {SUM}, row_count bigint"


def kpi_state(t: Tables, days: list[str] | None = None) -> DataFrame:
    """What a day adds to the headline figures, per source: amount, amount times days, rows. A ledger without dates has
    one state without a day. ``days`` reads only those days."""
    parts = []
    for source, (day, amount, weight) in SOURCES.items():
        if not t.has(source):
            continue
        rows = t[source]
        if day not in rows.columns:
            rows = rows.withColumn(day, F.lit(None).cast("date"))
        if days is not None:
            rows = rows.where(F.col(day).isin([F.lit(d).cast("date") for d in days]))
        if weight:
            rows = rows.where(F.col(weight).isNotNull())
        weighted = F.sum(F.col(weight) * F.col(amount)) if weight else F.lit(None)
        found = rows.groupBy(F.col(day).alias("day")).agg(
            F.sum(amount).cast(SUM).alias("amount"), weighted.cast(SUM).alias("weighted"), F.count(F.lit(1)).alias("row_count")
        )
        parts.append(found.select(F.lit(source).alias("source"), "day", "amount", "weighted", "row_count"))
    return reduce(DataFrame.unionByName, parts)


def kpi_from_states(states: DataFrame) -> DataFrame:
    """The cash conversion cycle from ``kpi_state`` rows: the same figures as from the tables."""
    stock, sales, ar, ap = (states.where(F.col("source") == s) for s in SOURCES)
    newest = stock.agg(F.max("day")).scalar()
    known = lambda df: F.count(F.lit(1)) > 0
    sections = [
        stock.where(F.col("day") == newest).agg(zero_if_null(money(F.sum("amount"))).alias("stock")),
        sales.agg((zero_if_null(money(F.sum("amount"))) / F.greatest(F.count("day"), F.lit(1))).alias("per_day")),
        ar.agg(F.when(known(ar), half_even(zero_if_null(quotient(F.sum("weighted"), F.sum("amount"))), 1)).otherwise(30.0).alias("dso")),
        ap.agg(F.when(known(ap), half_even(zero_if_null(quotient(F.sum("weighted"), F.sum("amount"))), 1)).otherwise(0.0).alias("dpo")),
    ]
    dio = F.when(F.col("per_day") > 0, half_even(F.col("stock") / F.col("per_day"), 1)).otherwise(0.0)
    row = side_by_side(states.sparkSession, sections).select(dio.alias("dio"), "dso", "dpo")
    return row.withColumn("ccc", half_even(F.col("dio") + F.col("dso") - F.col("dpo"), 1))


def kpi_summary_by_day(t: Tables) -> DataFrame:
    """The cash conversion cycle by way of the daily states."""
    return kpi_from_states(kpi_state(t))
