"""Cash cycle, receivables, payables, shipments and the product list."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import as_double, half_even, half_up, money, weighted_mean, zero_if_null
from ledgerloom.operators.classes import running_share
from ledgerloom.plans.order import running_groups
from ledgerloom.plans.snapshot import latest_snapshot
from ledgerloom.plans.totals import total
from ledgerloom.schema import AGING_ORDER
from ledgerloom.tables import Tables

SCENARIO_SCHEMA = "scenario_id string, dio_reduction int, dso_reduction int, dpo_increase int, annual_revenue double"
FALLBACK_REVENUE = 100_000_000.0


def _scenarios(t: Tables, scenarios: DataFrame | Iterable[tuple]) -> DataFrame:
    """Scenarios with the yearly revenue each one uses.

    A scenario's own figure wins; otherwise revenue per date with sales, times
    365, and a fixed amount when that is unknown or zero.
    """
    grid = (
        scenarios
        if isinstance(scenarios, DataFrame)
        else t.spark.createDataFrame([tuple(s) for s in scenarios], SCENARIO_SCHEMA)
    )
    observed = F.lit(None).cast("double")
    if t.has("sales_transactions"):
        days = F.greatest(F.count_distinct("transaction_date"), F.lit(1))
        per_year = zero_if_null(money(F.sum("total_revenue"))) / days * 365
        observed = t["sales_transactions"].agg(per_year.alias("per_year")).scalar()
    zero = F.lit(0.0)
    annual = F.coalesce(
        F.nullif(F.col("annual_revenue"), zero), F.nullif(observed, zero), F.lit(FALLBACK_REVENUE)
    )
    return grid.withColumn("annual", annual).withColumn("daily", F.col("annual") / 365)


def ccc_scenarios(t: Tables, scenarios: DataFrame | Iterable[tuple]) -> DataFrame:
    """Days and cash each scenario frees: (id, DIO cut, DSO cut, DPO rise, yearly revenue or None)."""
    days = F.col("dio_reduction") + F.col("dso_reduction") + F.col("dpo_increase")
    return _scenarios(t, scenarios).select(
        "scenario_id",
        half_even(F.col("annual"), 2).alias("annual_revenue"),
        half_even(F.col("daily"), 2).alias("daily_revenue"),
        days.alias("total_days_saved"),
        half_even(days * F.col("daily"), 2).alias("total_cash_freed"),
    )


def ccc_scenarios_breakdown(t: Tables, scenarios: DataFrame | Iterable[tuple]) -> DataFrame:
    """The same cash by lever, three rows per scenario."""
    levers = [("Reduce DIO by ", "dio_reduction"), ("Reduce DSO by ", "dso_reduction"), ("Increase DPO by ", "dpo_increase")]
    items = F.array(
        *(
            F.struct(
                F.concat(F.lit(text), F.col(days).cast("string"), F.lit("d")).alias("action"),
                half_even(F.col(days) * F.col("daily"), 2).alias("cash"),
            )
            for text, days in levers
        )
    )
    return _scenarios(t, scenarios).select("scenario_id", F.inline(items))


def ccc_improvement(
    t: Tables,
    dio_reduction: int = 0,
    dso_reduction: int = 0,
    dpo_increase: int = 0,
    annual_revenue: float | None = None,
) -> DataFrame:
    """A single scenario."""
    scenario = ("scenario", dio_reduction, dso_reduction, dpo_increase, annual_revenue and float(annual_revenue))
    return ccc_scenarios(t, [scenario])


def ccc_improvement_breakdown(
    t: Tables,
    dio_reduction: int = 0,
    dso_reduction: int = 0,
    dpo_increase: int = 0,
    annual_revenue: float | None = None,
) -> DataFrame:
    scenario = ("scenario", dio_reduction, dso_reduction, dpo_increase, annual_revenue and float(annual_revenue))
    return ccc_scenarios_breakdown(t, [scenario])


def _first(ordered: DataFrame, limit: int | None) -> DataFrame:
    return ordered if limit is None else ordered.limit(limit)


def _most_valuable(t: Tables, limit: int | None) -> DataFrame:
    rows = (
        latest_snapshot(t["inventory_snapshot"])
        .groupBy("product_id")
        .agg(F.sum("qty_on_hand").alias("total_units"), F.sum("inventory_value").alias("value"))
        .orderBy(F.col("value").desc_nulls_last(), F.col("product_id").asc_nulls_last())
    )
    return _first(rows, limit)


def working_capital_summary(t: Tables, limit: int | None = 50) -> DataFrame:
    """The products that tie up most cash."""
    return _most_valuable(t, limit).select(
        F.coalesce("product_id", F.lit("unknown")).alias("product_id"),
        "total_units",
        money(F.col("value")).alias("trapped_cash"),
    )


def working_capital_summary_summary(t: Tables, limit: int | None = 50) -> DataFrame:
    """Cash tied up in the listed products only; with ``limit=None`` in all."""
    return _most_valuable(t, limit).agg(zero_if_null(money(F.sum("value"), 2)).alias("total_cash_trapped"))


def carrying_cost(t: Tables, holding_cost_pct: float = 0.25) -> DataFrame:
    value = zero_if_null(money(F.sum("inventory_value")))
    rate = F.lit(float(holding_cost_pct))
    return (
        latest_snapshot(t["inventory_snapshot"])
        .agg(value.alias("v"))
        .select(
            half_even(F.col("v"), 2).alias("total_inventory_value"),
            rate.alias("holding_rate"),
            half_even(F.col("v") * rate, 2).alias("annual_carrying_cost"),
            half_even(F.col("v") * rate / 12, 2).alias("monthly"),
        )
    )


def _product_values(t: Tables, dimension: str) -> DataFrame:
    if dimension == "revenue":
        return t["sales_transactions"].groupBy("product_id").agg(F.sum("total_revenue").alias("v"))
    return latest_snapshot(t["inventory_snapshot"]).groupBy("product_id").agg(F.sum("inventory_value").alias("v"))


def pareto(t: Tables, dimension: str = "revenue", limit: int | None = 50) -> DataFrame:
    """Products by revenue (any other dimension: by stock value) with the running share."""
    return (
        running_share(_product_values(t, dimension), "v", limit)
        .orderBy(F.col("v").desc_nulls_last(), F.col("product_id").asc_nulls_last())
        .select("product_id", money(F.col("v")).alias("val"), "cum_pct")
    )


def pareto_summary(t: Tables, dimension: str = "revenue") -> DataFrame:
    """How many products make up 80 %; counted per distinct value, without going back to products."""
    values = _product_values(t, dimension)
    whole = as_double(total(values, F.sum("v")))
    groups = running_groups(values, "v").withColumn("_whole", whole)
    cum_pct = as_double(F.col("running")) / F.nullif(F.col("_whole"), F.lit(0.0)) * 100
    counts = groups.agg(
        zero_if_null(F.sum("members")).alias("n"),
        zero_if_null(F.sum(F.when(cum_pct <= 80, F.col("members")))).alias("n80"),
    )
    return counts.select(
        F.lit(dimension).alias("dimension"),
        F.col("n").alias("total_skus"),
        F.col("n80").alias("skus_driving_80pct"),
        F.when(F.col("n") > 0, half_even(F.col("n80") / F.col("n") * 100, 1)).otherwise(0.0).alias("pct_of_skus"),
    )


def ar_aging(t: Tables) -> DataFrame:
    """Receivables per aging bucket, youngest first."""
    rank = F.lit(len(AGING_ORDER))
    for place, label in enumerate(AGING_ORDER):
        rank = F.when(F.col("aging_bucket") == label, place).otherwise(rank)
    return (
        t["ar_ledger"]
        .groupBy("aging_bucket")
        .agg(
            F.count(F.lit(1)).alias("invoices"),
            money(F.sum("invoice_amount")).alias("total_amount"),
            zero_if_null(money(F.sum(F.when(F.col("paid_date").isNull(), F.col("invoice_amount"))))).alias("outstanding"),
        )
        .orderBy(rank, F.col("aging_bucket").asc_nulls_last())
    )


def ar_aging_summary(t: Tables) -> DataFrame:
    """Outstanding, disputed and written-off amounts, in one pass."""

    def amount(hit: Column) -> Column:
        return zero_if_null(money(F.sum(F.when(hit, F.col("invoice_amount")))))

    return t["ar_ledger"].agg(
        amount(F.col("paid_date").isNull()).alias("total_outstanding"),
        F.count_if("dispute_flag").alias("dispute_count"),
        amount(F.col("dispute_flag")).alias("dispute_amount"),
        F.count_if("write_off_flag").alias("write_off_count"),
        amount(F.col("write_off_flag")).alias("write_off_amount"),
    )


def _mean_days(df: DataFrame, key: str, days: str, name: str) -> DataFrame:
    """Plain mean of the days per key, for when no master table is loaded."""
    mean = as_double(F.sum(days)) / F.nullif(F.count(days), F.lit(0))
    return (
        df.groupBy(key)
        .agg(half_up(mean, 1).alias(name), F.count(F.lit(1)).alias("invoices"))
        .orderBy(F.col(name).desc_nulls_last(), F.col(key).asc_nulls_last())
    )


def dso_by_customer(t: Tables, limit: int | None = 20) -> DataFrame:
    """Customers that pay latest, weighted by amount. Names are joined to the listed customers only."""
    paid = t["ar_ledger"].where(F.col("days_to_pay").isNotNull())
    if not t.has("customers"):
        return _first(_mean_days(paid, "customer_id", "days_to_pay", "weighted_dso"), limit)
    order = [F.col("weighted_dso").desc_nulls_last(), F.col("customer_id").asc_nulls_last()]
    slowest = _first(
        paid.groupBy("customer_id")
        .agg(
            half_up(weighted_mean(F.col("days_to_pay"), F.col("invoice_amount")), 1).alias("weighted_dso"),
            F.count(F.lit(1)).alias("invoices"),
            money(F.sum("invoice_amount")).alias("total_billed"),
        )
        .orderBy(*order),
        limit,
    )
    names = t["customers"].select("customer_id", "customer_name", "segment")
    return _first(
        slowest.join(names, "customer_id", "left")
        .select("customer_id", "customer_name", "segment", "weighted_dso", "invoices", "total_billed")
        .orderBy(*order),
        limit,
    )


def dso_overall(t: Tables) -> DataFrame:
    mean = weighted_mean(F.col("days_to_pay"), F.col("invoice_amount"))
    return (
        t["ar_ledger"]
        .where(F.col("days_to_pay").isNotNull())
        .agg(half_even(zero_if_null(mean), 1).alias("overall_dso"))
    )


def dpo_by_supplier(t: Tables) -> DataFrame:
    """Days until suppliers are paid. Unpaid invoices add no days but keep their weight."""
    if not t.has("suppliers"):
        return _mean_days(t["ap_ledger"], "supplier_id", "actual_days_to_pay", "weighted_dpo")
    per_supplier = (
        t["ap_ledger"]
        .groupBy("supplier_id")
        .agg(
            half_up(weighted_mean(F.col("actual_days_to_pay"), F.col("invoice_amount")), 1).alias("weighted_dpo"),
            F.count(F.lit(1)).alias("invoices"),
            money(F.sum("early_payment_discount")).alias("total_discounts"),
        )
    )
    terms = t["suppliers"].select("supplier_id", "supplier_name", F.col("contracted_payment_days").alias("terms"))
    return (
        per_supplier.join(terms, "supplier_id", "left")
        .select("supplier_id", "supplier_name", "weighted_dpo", "terms", "invoices", "total_discounts")
        .orderBy(F.col("weighted_dpo").desc_nulls_last(), F.col("supplier_id").asc_nulls_last())
    )


def dpo_overall(t: Tables) -> DataFrame:
    mean = weighted_mean(F.col("actual_days_to_pay"), F.col("invoice_amount"))
    return t["ap_ledger"].agg(half_even(zero_if_null(mean), 1).alias("overall_dpo"))


def shipment_tracking(t: Tables, status: str | None = None) -> DataFrame:
    """Shipments, quantity, freight and mean delay per status."""
    shipments = t["shipments"] if not status else t["shipments"].where(F.col("status") == status)
    delay = as_double(F.sum("delay_days")) / F.nullif(F.count("delay_days"), F.lit(0))
    return shipments.groupBy("status").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("qty_shipped").alias("total_qty"),
        money(F.sum("freight_cost")).alias("total_freight"),
        half_up(delay, 1).alias("avg_delay"),
    )


def shipments_in_transit(t: Tables, limit: int | None = 20) -> DataFrame:
    columns = (
        "shipment_id",
        "supplier_id",
        "product_id",
        "ship_date",
        "expected_arrival_date",
        "qty_shipped",
        "carrier",
    )
    # Ids may repeat; ordering by every column makes the listed rows definite.
    rows = (
        t["shipments"]
        .where(F.col("status") == "In Transit")
        .select(*columns)
        .orderBy(*(F.col(c).asc_nulls_last() for c in columns))
    )
    return rows if limit is None else rows.limit(limit)


def product_catalog(t: Tables, category: str | None = None, abc_class: str | None = None) -> DataFrame:
    """All product columns, optionally of one category and one class."""
    rows = t["products"]
    if category:
        rows = rows.where(F.col("category") == category)
    if abc_class:
        rows = rows.where(F.col("abc_class") == abc_class)
    return rows.orderBy(F.col("product_id").asc_nulls_last())
