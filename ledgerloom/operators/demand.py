"""Demand and sales questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import as_double, distinct, half_even, half_up, level, money, quotient, zero_if_null
from ledgerloom.plans.totals import bounded, total
from ledgerloom.tables import Tables


def forecast_demand(t: Tables, sku: str | None = None, horizon_days: int = 30, window: int = 7) -> DataFrame:
    """Moving average of the last days with sales, its trend, and the demand over the horizon; all products at once.

    Sales are added up per product and day first, so the window sees at most
    one row per calendar day of a product, however hot the product is.
    """
    sales = t["sales_transactions"]
    if sku is not None:
        sales = sales.where(F.col("product_id") == sku)
    daily = sales.groupBy("product_id", "transaction_date").agg(F.sum("qty_sold").alias("qty"))
    newest_first = Window.partitionBy("product_id").orderBy(F.col("transaction_date").desc_nulls_first())
    nth = F.col("nth")
    figures = (
        daily.withColumn("nth", F.row_number().over(newest_first))
        .groupBy("product_id")
        .agg(
            F.count(F.lit(1)).alias("days"),
            F.sum(F.when(nth <= window, F.col("qty"))).alias("last"),
            F.sum(F.when((nth > window) & (nth <= 2 * window), F.col("qty"))).alias("before"),
        )
        .withColumn("w", F.least(F.col("days"), F.lit(window).cast("bigint")))
        .withColumn("average", F.col("last") / F.col("w"))
    )
    earlier = F.col("before") / F.col("w")
    comparable = F.col("days") >= 2 * window
    trend = (
        F.when(comparable & (F.col("average") > earlier * 1.1), "increasing")
        .when(comparable & (F.col("average") < earlier * 0.9), "decreasing")
        .otherwise("stable")
    )
    return figures.select(
        "product_id",
        F.col("days").alias("historical_days"),
        F.col("w").alias("window"),
        trend.alias("trend"),
        half_even(F.col("average"), 2).alias("moving_average"),
        half_even(F.col("average") * horizon_days).alias("total_predicted"),
    )


def _scored(frame: DataFrame, column: str) -> DataFrame:
    """Rows with their z-score; mean and deviation are two scalars of one small aggregate."""
    x = as_double(F.col(column))
    stats = frame.agg(
        F.struct(
            quotient(F.sum(column), F.count(column)).alias("mean"), F.stddev_samp(x).alias("deviation")
        ).alias("s")
    ).scalar()
    return (
        frame.withColumn("_s", stats)
        .withColumn("z_score", (x - F.col("_s.mean")) / F.nullif(F.col("_s.deviation"), F.lit(0.0)))
        .drop("_s")
    )


def detect_anomalies(
    t: Tables,
    table: str = "sales_transactions",
    column: str = "qty_sold",
    z_threshold: float = 2.0,
    limit: int | None = None,
) -> DataFrame:
    """All columns of the rows further than ``z_threshold`` deviations from the mean."""
    rows = (
        _scored(t[table], column)
        .where(F.abs("z_score") > z_threshold)
        .withColumn("z_score", F.round("z_score", 6))
    )
    # Ordering by every column makes the listed rows definite.
    ties = [F.col(f"`{c}`").asc_nulls_last() for c in t[table].columns]
    return rows if limit is None else rows.orderBy(F.abs("z_score").desc(), *ties).limit(limit)


def detect_anomalies_summary(
    t: Tables, table: str = "sales_transactions", column: str = "qty_sold", z_threshold: float = 2.0
) -> DataFrame:
    return _scored(t[table], column).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.abs("z_score") > z_threshold).alias("anomalies_found"),
    )


def revenue_trends(t: Tables, granularity: str = "monthly", approximate: bool = False) -> DataFrame:
    """Revenue, units and products per period, and growth over the previous period that has sales."""
    unit = {"daily": None, "weekly": "week"}.get(granularity, "month")
    date = F.col("transaction_date")
    periods = (
        t["sales_transactions"]
        .groupBy((F.trunc(date, unit) if unit else date).alias("period"))
        .agg(
            money(F.sum("total_revenue")).alias("revenue"),
            F.sum("qty_sold").alias("units"),
            distinct("product_id", approximate).alias("skus"),
        )
    )
    # One row per calendar period is left here, so one task is enough.
    previous = F.lag("revenue").over(Window.orderBy(F.col("period").asc_nulls_last()))
    growth = F.when(
        previous > 0, half_even((F.col("revenue") - previous) / previous * 100, 1)
    ).when(previous.isNotNull(), 0.0)
    return periods.withColumn("growth_pct", growth).orderBy(F.col("period").asc_nulls_last())


def sales_velocity(t: Tables, limit: int | None = 30) -> DataFrame:
    """Units per day with sales; null for products sold on a single day."""
    days = F.count_distinct("transaction_date")
    rows = (
        t["sales_transactions"]
        .groupBy("product_id")
        .agg(
            F.sum("qty_sold").alias("total_sold"),
            days.alias("sale_days"),
            money(F.sum("total_revenue")).alias("total_revenue"),
        )
        .select(
            "product_id",
            "total_sold",
            "sale_days",
            half_up(as_double(F.col("total_sold")) / F.nullif(F.nullif("sale_days", F.lit(1)), F.lit(0)), 2).alias(
                "daily_velocity"
            ),
            "total_revenue",
        )
        .orderBy(F.col("daily_velocity").desc_nulls_last(), F.col("product_id").asc_nulls_last())
    )
    return rows if limit is None else rows.limit(limit)


def top_skus(t: Tables, limit: int | None = 20) -> DataFrame:
    """Products by revenue."""
    rows = (
        t["sales_transactions"]
        .groupBy("product_id")
        .agg(
            F.sum("total_revenue").alias("revenue"),
            F.sum("qty_sold").alias("units"),
            F.sum("gross_profit").alias("profit"),
        )
        .orderBy(F.col("revenue").desc_nulls_last(), F.col("product_id").asc_nulls_last())
    )
    rows = rows if limit is None else rows.limit(limit)
    return rows.select("product_id", money(F.col("revenue")).alias("revenue"), "units", money(F.col("profit")).alias("profit"))


def top_skus_brief(t: Tables, limit: int | None = 20) -> DataFrame:
    """Products by revenue, without profit (which then need not be in the data)."""
    rows = (
        t["sales_transactions"]
        .groupBy("product_id")
        .agg(F.sum("total_revenue").alias("revenue"), F.sum("qty_sold").alias("units"))
        .orderBy(F.col("revenue").desc_nulls_last(), F.col("product_id").asc_nulls_last())
    )
    rows = rows if limit is None else rows.limit(limit)
    return rows.select("product_id", money(F.col("revenue")).alias("revenue"), "units")


def _by_revenue() -> list[Column]:
    return [F.col("revenue").desc_nulls_last(), F.col("customer_id").asc_nulls_last()]


def _customer_revenue(sales: DataFrame) -> DataFrame:
    return sales.groupBy("customer_id").agg(F.sum("total_revenue").alias("revenue"))


def _top_customers(sales: DataFrame, limit: int | None) -> DataFrame:
    rows = _customer_revenue(sales).orderBy(*_by_revenue())
    return rows if limit is None else rows.limit(limit)


def customer_concentration(t: Tables, limit: int | None = 10) -> DataFrame:
    """Customers by revenue with their share of all revenue; rows without a customer form one group.

    Distinct products are counted for the listed customers only: doing it for
    everybody would shuffle every (customer, product) pair. The total is taken
    over the same per-customer sums the ranking uses, so their shuffle is reused.
    """
    sales = t["sales_transactions"]
    if not t.has("customers"):
        known = sales.where(F.col("customer_id").isNotNull())
        return _top_customers(known, limit).withColumn("revenue", money(F.col("revenue")))
    whole = as_double(total(_customer_revenue(sales), F.sum("revenue")))
    if limit is not None:
        top = _top_customers(sales, limit)
        listed = bounded(top.select(F.col("customer_id").alias("_listed")), limit)
        sales = sales.join(listed, F.col("customer_id").eqNullSafe(F.col("_listed")), "left_semi")
    bought = sales.groupBy("customer_id").agg(
        F.sum("total_revenue").alias("revenue"), F.count_distinct("product_id").alias("unique_products")
    )
    names = t["customers"].select("customer_id", "customer_name")
    rows = (
        bought.join(names, "customer_id", "left")
        .select(
            "customer_id",
            F.coalesce("customer_name", "customer_id").alias("customer_name"),
            money(F.col("revenue")).alias("revenue"),
            (quotient(F.col("revenue"), whole) * 100).alias("revenue_pct"),
            "unique_products",
        )
        .orderBy(*_by_revenue())
    )
    return rows if limit is None else rows.limit(limit)


def customer_concentration_summary(t: Tables, limit: int | None = 10) -> DataFrame:
    """Share of the listed customers together. Without a customer table no share is known and the risk is low."""
    sales = t["sales_transactions"]
    if not t.has("customers"):
        return sales.agg(F.lit(0.0).alias("top_pct"), F.lit("low").alias("concentration_risk"))
    whole = total(_customer_revenue(sales), F.sum("revenue"))
    top = _top_customers(sales, limit).agg(F.sum("revenue").alias("listed"))
    share = zero_if_null(quotient(F.col("listed"), whole) * 100)
    return top.select(share.alias("pct")).select(
        F.round("pct", 6).alias("top_pct"), level(F.col("pct"), 80, 50).alias("concentration_risk")
    )


def _monthly(t: Tables, sku: str | None) -> DataFrame:
    sales = t["sales_transactions"]
    if sku:
        sales = sales.where(F.col("product_id") == sku)
    return sales.groupBy(F.month("transaction_date").alias("month")).agg(
        F.sum("qty_sold").alias("qty"), money(F.sum("total_revenue")).alias("revenue")
    )


def seasonality(t: Tables, sku: str | None = None) -> DataFrame:
    """Units and revenue per calendar month over all years, and each month's index."""
    # At most twelve rows (and one for unknown dates) reach this window.
    everything = Window.partitionBy()
    mean = F.sum("qty").over(everything) / F.count("qty").over(everything)
    index = F.when(mean > 0, half_even(F.col("qty") / mean, 2)).otherwise(0.0)
    return _monthly(t, sku).withColumn("index_vs_avg", index).orderBy(F.col("month").asc_nulls_last())


def seasonality_summary(t: Tables, sku: str | None = None) -> DataFrame:
    """Strongest and weakest month; the earlier one wins a tie."""
    return _monthly(t, sku).agg(
        F.max_by("month", F.struct(F.col("qty"), -F.col("month"))).alias("peak_month"),
        F.min_by("month", F.struct("qty", "month")).alias("low_month"),
    )
