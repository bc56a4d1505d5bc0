"""Dashboard and headline figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import as_double, distinct, half_even, half_up, money, weighted_mean, zero_if_null
from ledgerloom.plans.snapshot import latest_snapshot
from ledgerloom.plans.totals import side_by_side
from ledgerloom.tables import MissingTable, Tables


def _or_zero(total: Column) -> Column:
    return zero_if_null(money(total))


def _mean(column: str, places: int) -> Column:
    """Mean of the known values, summed before dividing."""
    return zero_if_null(half_up(as_double(F.sum(column)) / F.nullif(F.count(column), F.lit(0)), places))


def full_dashboard(t: Tables, approximate: bool = False) -> DataFrame:
    """One row of totals; the columns of tables that are not loaded are left out."""
    rows = F.count(F.lit(1))
    sections = []
    if t.has("sales_transactions"):
        sections.append(
            t["sales_transactions"].agg(
                _or_zero(F.sum("total_revenue")).alias("total_revenue"),
                _or_zero(F.sum("total_cost")).alias("total_cost"),
                _or_zero(F.sum("gross_profit")).alias("gross_profit"),
                rows.alias("transactions"),
                distinct("product_id", approximate).alias("unique_products"),
            )
        )
    if t.has("inventory_snapshot"):
        sections.append(
            latest_snapshot(t["inventory_snapshot"]).agg(
                distinct("product_id", approximate).alias("unique_skus"),
                zero_if_null(F.sum("qty_on_hand")).alias("total_units"),
                _or_zero(F.sum("inventory_value")).alias("inventory_value"),
                F.count_if(F.col("stock_status") == "stockout").alias("stockouts"),
                F.count_if(F.col("stock_status") == "overstock").alias("overstocked"),
            )
        )
    if t.has("suppliers"):
        sections.append(
            t["suppliers"].agg(
                rows.alias("supplier_count"),
                _mean("avg_lead_time_days", 1).alias("avg_lead_time"),
                _mean("on_time_delivery_rate", 3).alias("avg_otd_rate"),
            )
        )
    if t.has("customers"):
        sections.append(
            t["customers"].agg(
                rows.alias("customer_count"),
                _or_zero(F.sum("ytd_revenue")).alias("total_ytd_revenue"),
                _mean("avg_days_to_pay", 1).alias("avg_days_to_pay"),
            )
        )
    if t.has("ar_ledger"):
        sections.append(
            t["ar_ledger"].agg(
                rows.alias("ar_invoices"),
                F.count_if("is_overdue").alias("ar_overdue"),
                _or_zero(F.sum(F.when(F.col("write_off_flag"), F.col("invoice_amount")))).alias("write_off_amount"),
            )
        )
    if t.has("purchase_orders"):
        sections.append(
            t["purchase_orders"].agg(
                rows.alias("po_count"),
                zero_if_null(F.sum("qty_ordered")).alias("po_qty"),
                _or_zero(F.sum("total_po_value")).alias("po_value"),
            )
        )
    if not sections:
        raise MissingTable("no table is loaded")
    return side_by_side(t.spark, sections)


def _stock_value(t: Tables) -> DataFrame:
    return latest_snapshot(t["inventory_snapshot"]).agg(_or_zero(F.sum("inventory_value")).alias("stock"))


def _daily(t: Tables, amount: str, *more: Column) -> DataFrame:
    """Total of a sales amount per date with sales, and ``more`` aggregates."""
    per_day = _or_zero(F.sum(amount)) / F.greatest(F.count_distinct("transaction_date"), F.lit(1))
    return t["sales_transactions"].agg(per_day.alias("per_day"), *more)


def _days_outstanding(ledger: DataFrame, days: str, name: str) -> DataFrame:
    known = ledger.where(F.col(days).isNotNull())
    mean = weighted_mean(F.col(days), F.col("invoice_amount"))
    return known.agg(half_even(zero_if_null(mean), 1).alias(name))


def _headline(t: Tables, sales: DataFrame | None, *more: str) -> DataFrame:
    """The headline figures, and the columns ``more`` of their sections; ``sales`` is one row with the cost per day."""
    sections = []
    if t.has("inventory_snapshot") and sales is not None:
        sections += [_stock_value(t), sales]
        dio = F.when(F.col("per_day") > 0, half_even(F.col("stock") / F.col("per_day"), 1)).otherwise(0.0)
    else:
        dio = F.lit(0.0)
    if t.has("ar_ledger"):
        sections.append(_days_outstanding(t["ar_ledger"], "days_to_pay", "dso"))
    if t.has("ap_ledger"):
        sections.append(_days_outstanding(t["ap_ledger"], "actual_days_to_pay", "dpo"))
    row = side_by_side(t.spark, sections) if sections else t.spark.range(1)
    return row.select(
        dio.alias("dio"),
        (F.col("dso") if t.has("ar_ledger") else F.lit(30.0)).alias("dso"),
        (F.col("dpo") if t.has("ap_ledger") else F.lit(0.0)).alias("dpo"),
        *more,
    ).withColumn("ccc", half_even(F.col("dio") + F.col("dso") - F.col("dpo"), 1))


def kpi_summary(t: Tables) -> DataFrame:
    """Days of inventory, receivables and payables, and the cash conversion cycle.

    Four independent aggregates in one plan. Without receivables the days are
    taken as 30, without payables or stock as 0.
    """
    return _headline(t, _daily(t, "total_cost") if t.has("sales_transactions") else None)


def kpi_simple(t: Tables) -> DataFrame:
    """The shorter form: stock at unit cost over daily revenue, 30 days receivable, none payable."""
    stock = latest_snapshot(t["inventory_snapshot"]).agg(
        _or_zero(F.sum(F.col("qty_on_hand") * F.col("unit_cost"))).alias("stock")
    )
    # No sales at all: the divisor falls back to 1.
    revenue = t["sales_transactions"].agg(
        F.coalesce(
            money(F.sum("total_revenue")) / F.nullif(F.count_distinct("transaction_date"), F.lit(0)), F.lit(1.0)
        ).alias("per_day")
    )
    return side_by_side(t.spark, [stock, revenue]).select(
        F.when(F.col("per_day") > 0, half_even(F.col("stock") / F.col("per_day"), 1)).otherwise(0.0).alias("dio"),
        F.lit(30.0).alias("dso"),
        F.lit(0.0).alias("dpo"),
    ).withColumn("ccc", half_even(F.col("dio") + F.col("dso") - F.col("dpo"), 1))


def kpi_record(t: Tables, date: str | None = None) -> DataFrame:
    """One row for the KPI history: the summary plus revenue per unit of stock value. Sales and stock are read once."""
    day = F.lit(date).cast("date") if date else F.current_date()
    turnover = half_up(F.col("revenue") / F.nullif(F.col("stock"), F.lit(0.0)), 2)
    if not t.has("inventory_snapshot"):
        raise MissingTable("the KPI history needs inventory_snapshot")
    row = _headline(t, _daily(t, "total_cost", money(F.sum("total_revenue")).alias("revenue")), "revenue", "stock")
    return row.select(day.alias("date"), "dio", "dso", "dpo", "ccc", turnover.alias("inventory_turnover"))
