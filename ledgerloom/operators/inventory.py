"""Stock questions; all but the ABC-XYZ classes read the newest snapshot.

Sorted results end their sort key with the row's ids: range partitioning can
then split a value that very many rows share.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import as_double, half_even, half_up, money, quotient, zero_if_null
from ledgerloom.operators.classes import class_columns, revenue_classes
from ledgerloom.plans.snapshot import latest_snapshot
from ledgerloom.plans.totals import unpivot_row
from ledgerloom.schema import AGE_BUCKETS, DEFAULT_Z, SERVICE_LEVEL_Z
from ledgerloom.tables import Tables

_IDS = ("product_id", "location_id")


def _ids() -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in _IDS]


def _latest(t: Tables) -> DataFrame:
    return latest_snapshot(t["inventory_snapshot"])


def _below_reorder_point(t: Tables) -> DataFrame:
    return _latest(t).where(F.col("qty_on_hand") < F.col("reorder_point"))


def _top(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def reorder_alerts(t: Tables) -> DataFrame:
    """Positions below their reorder point, emptiest first."""
    return (
        _below_reorder_point(t)
        .select(*_IDS, "qty_on_hand", "reorder_point", "safety_stock_target", "stock_status", "days_of_supply")
        .orderBy(F.col("qty_on_hand").asc_nulls_last(), *_ids())
    )


def reorder_alerts_summary(t: Tables) -> DataFrame:
    return _below_reorder_point(t).agg(F.count(F.lit(1)).alias("total_alerts"))


def smart_reorder(t: Tables, limit: int | None = 20) -> DataFrame:
    """Positions to reorder, stockouts first, with order quantity and lead time.

    The ranking needs stock columns only, so the limit is taken before the
    products are joined; a left join cannot lose or reorder those rows.
    """
    urgency = (
        F.when(F.col("stock_status") == "stockout", 1).when(F.col("stock_status") == "low_stock", 2).otherwise(3)
    )
    order = [F.col("priority").asc(), F.col("days_of_supply").asc_nulls_last(), *_ids()]
    chosen = _top(_below_reorder_point(t).withColumn("priority", urgency), order, limit)
    columns = ["product_id", "qty_on_hand", "reorder_point", "days_of_supply"]
    if not t.has("products"):
        return chosen.select(*columns[:3])
    products = t["products"].select("product_id", "economic_order_qty", "lead_time_days")
    joined = chosen.join(products, "product_id", "left").select(
        *columns,
        F.coalesce("economic_order_qty", F.lit(100)).alias("eoq"),
        F.coalesce("lead_time_days", F.lit(14)).alias("lead_time"),
        "stock_status",
        "priority",
        "location_id",
    )
    return _top(joined, order, limit).drop("location_id")


def _per_product(t: Tables, skus: Iterable[str] | None, sales: DataFrame, columns: list[str]) -> DataFrame:
    """Product attributes and per-product sales figures, one row per listed or sold product or per given id.

    Of a product listed twice the smallest known attribute counts.
    """
    attributes = None
    if t.has("products"):
        attributes = t["products"].groupBy("product_id").agg(*(F.min(c).alias(c) for c in columns))
    if skus is not None:
        wanted = t.spark.createDataFrame([(s,) for s in dict.fromkeys(skus)], "product_id string")
        spine = wanted if attributes is None else wanted.join(attributes, "product_id", "left")
    elif attributes is not None:
        return attributes.join(sales.where(F.col("product_id").isNotNull()), "product_id", "full")
    else:
        spine = sales.select("product_id")
    for c in columns:
        if c not in spine.columns:
            spine = spine.withColumn(c, F.lit(None))
    return spine.join(sales, "product_id", "left")


def safety_stock(t: Tables, skus: Iterable[str] | None = None, service_level: float = 0.95) -> DataFrame:
    """z · deviation of a sale's quantity · √lead time; 50 and 14 stand in for unknown or zero inputs."""
    z = SERVICE_LEVEL_Z.get(service_level, DEFAULT_Z)
    spread = t["sales_transactions"].groupBy("product_id").agg(F.stddev_samp("qty_sold").alias("deviation"))
    deviation = F.coalesce(F.nullif(F.col("deviation"), F.lit(0.0)), F.lit(50.0))
    lead = F.coalesce(F.nullif(F.col("lead_time_days").cast("int"), F.lit(0)), F.lit(14))
    return (
        _per_product(t, skus, spread, ["lead_time_days"])
        .select("product_id", deviation.alias("sigma"), lead.alias("lead_time"))
        .select(
            "product_id",
            half_even(F.lit(z) * F.col("sigma") * F.sqrt("lead_time")).cast("bigint").alias("safety_stock"),
            half_even(F.col("sigma"), 2).alias("demand_std"),
            "lead_time",
            F.lit(z).alias("z_score"),
        )
    )


def eoq(
    t: Tables, skus: Iterable[str] | None = None, order_cost: float = 50, holding_cost_pct: float = 0.25
) -> DataFrame:
    """Economic order quantity from yearly demand and holding cost; unit cost 10 when unknown or zero."""
    demand = (
        t["sales_transactions"]
        .groupBy("product_id")
        .agg(F.sum("qty_sold").alias("sold"), F.count_distinct("transaction_date").alias("days"))
    )
    annual = zero_if_null(F.col("sold")) / F.greatest(F.coalesce("days", F.lit(1)), F.lit(1)) * 365
    unit_cost = F.coalesce(F.nullif(as_double(F.col("unit_cost")), F.lit(0.0)), F.lit(10.0))
    holding = F.col("unit_cost") * F.lit(holding_cost_pct)
    quantity = F.when(
        holding > 0, half_even(F.sqrt(F.lit(2) * F.col("annual") * F.lit(order_cost) / holding))
    ).otherwise(0.0)
    return (
        _per_product(t, skus, demand, ["unit_cost"])
        .select("product_id", annual.alias("annual"), unit_cost.alias("unit_cost"))
        .withColumn("eoq", quantity.cast("bigint"))
        .select(
            "product_id",
            "eoq",
            half_even(F.col("annual")).cast("bigint").alias("annual_demand"),
            "unit_cost",
            F.when(F.col("eoq") > 0, half_even(F.col("annual") / F.col("eoq"), 1))
            .otherwise(0.0)
            .alias("orders_per_year"),
        )
    )


def inventory_turnover(t: Tables, limit: int | None = 50) -> DataFrame:
    """Revenue per unit of stock value. Both sides are reduced to one row per
    product before they meet, on the partitioning the grouping left behind."""
    stock = (
        _latest(t)
        .groupBy("product_id")
        .agg(
            F.sum("qty_on_hand").alias("qty_on_hand"),
            quotient(F.sum("unit_cost"), F.count("unit_cost")).alias("unit_cost"),
            F.sum("inventory_value").alias("inventory_value"),
        )
    )
    sold = (
        t["sales_transactions"]
        .groupBy("product_id")
        .agg(F.sum("qty_sold").alias("total_sold"), F.sum("total_revenue").alias("revenue"))
    )
    value = money(F.col("inventory_value"))
    revenue = zero_if_null(money(F.col("revenue")))
    rows = stock.join(sold, "product_id", "left").select(
        "product_id",
        "qty_on_hand",
        "unit_cost",
        value.alias("inventory_value"),
        zero_if_null(F.col("total_sold")).alias("total_sold"),
        revenue.alias("revenue"),
        F.when(value > 0, half_up(revenue / value, 2)).otherwise(0.0).alias("turnover_ratio"),
    )
    return _top(rows, [F.col("turnover_ratio").desc_nulls_last(), F.col("product_id").asc_nulls_last()], limit)


def _stock_per_product(t: Tables, value_name: str) -> DataFrame:
    return (
        _latest(t)
        .groupBy("product_id")
        .agg(
            F.sum("qty_on_hand").alias("qty"),
            F.sum("inventory_value").alias(value_name),
            F.max("days_since_last_movement").alias("days_idle"),
        )
    )


def _age_bucket(bounds: Iterable[int] | str = (30, 60, 90)) -> tuple[Column, list[str]]:
    """``bounds``: the last day of each bucket but the open one, or a text such as ``0-30,31-60,61-90,90+``."""
    if isinstance(bounds, str):
        bounds = [int(part.split("-")[1].strip(" d")) for part in bounds.split(",") if "-" in part]
    bounds = list(bounds)
    labels = list(AGE_BUCKETS)
    if bounds != [30, 60, 90]:
        lows = [0] + [b + 1 for b in bounds]
        labels = [f"{lo}-{hi}d" for lo, hi in zip(lows, bounds)] + [f"{bounds[-1]}+d"]
    bucket = None
    for bound, label in zip(bounds, labels):
        condition = F.col("days_idle") <= bound
        bucket = F.when(condition, label) if bucket is None else bucket.when(condition, label)
    return bucket.otherwise(labels[-1]), labels


def inventory_aging(t: Tables, buckets: Iterable[int] = (30, 60, 90)) -> DataFrame:
    """Stock per product by how long its slowest position has not moved (unknown counts as oldest)."""
    bucket, _ = _age_bucket(buckets)
    return _stock_per_product(t, "value").select(
        "product_id", "qty", money(F.col("value")).alias("value"), "days_idle", bucket.alias("age_bucket")
    )


def inventory_aging_buckets(t: Tables, buckets: Iterable[int] = (30, 60, 90)) -> DataFrame:
    """Products and value per age bucket; every bucket has a row, empty ones too."""
    bucket, labels = _age_bucket(buckets)
    aged = _stock_per_product(t, "value").withColumn("age_bucket", bucket)
    inside = [F.col("age_bucket") == label for label in labels]
    row = aged.agg(
        *(F.count_if(hit).alias(f"n{i}") for i, hit in enumerate(inside)),
        *(F.sum(F.when(hit, F.col("value"))).alias(f"v{i}") for i, hit in enumerate(inside)),
    )
    return unpivot_row(
        row,
        [
            [F.lit(label), F.col(f"n{i}"), zero_if_null(money(F.col(f"v{i}"), 2))]
            for i, label in enumerate(labels)
        ],
        ["age_bucket", "sku_count", "total_value"],
    )


def _idle(t: Tables, days: int) -> DataFrame:
    return _stock_per_product(t, "value_at_risk").where(F.col("days_idle") > days)


def dead_stock(t: Tables, days: int = 90) -> DataFrame:
    """Products with a position that has not moved for more than ``days``, most valuable first."""
    return (
        _idle(t, days)
        .withColumn("value_at_risk", money(F.col("value_at_risk")))
        .orderBy(F.col("value_at_risk").desc_nulls_last(), F.col("product_id").asc_nulls_last())
    )


def dead_stock_summary(t: Tables, days: int = 90) -> DataFrame:
    return _idle(t, days).agg(
        F.count(F.lit(1)).alias("items"),
        zero_if_null(money(F.sum("value_at_risk"), 2)).alias("total_value_at_risk"),
    )


def _overstocked(t: Tables, threshold_multiplier: float | None) -> DataFrame:
    if threshold_multiplier is None:
        return _latest(t).where(F.col("stock_status") == "overstock")
    return _latest(t).where(F.col("qty_on_hand") > F.col("reorder_point") * threshold_multiplier)


def overstock(t: Tables, threshold_multiplier: float | None = None) -> DataFrame:
    """Positions marked as overstock, or above a multiple of their reorder point when one is given."""
    return (
        _overstocked(t, threshold_multiplier)
        .select(
            *_IDS, "qty_on_hand", "reorder_point", money(F.col("inventory_value")).alias("inventory_value"), "stock_status"
        )
        .orderBy(F.col("inventory_value").desc_nulls_last(), *_ids())
    )


def overstock_summary(t: Tables, threshold_multiplier: float | None = None) -> DataFrame:
    return _overstocked(t, threshold_multiplier).agg(
        F.count(F.lit(1)).alias("overstocked_items"),
        zero_if_null(money(F.sum("inventory_value"), 2)).alias("total_excess_value"),
    )


def _running_out(t: Tables, horizon_days: float) -> DataFrame:
    supply = F.col("days_of_supply")
    return _latest(t).where((supply >= 0) & (supply < horizon_days))


def stockout_risk(t: Tables, horizon_days: float = 14) -> DataFrame:
    """Positions whose supply ends within the horizon, soonest first."""
    return (
        _running_out(t, horizon_days)
        .select(*_IDS, "qty_on_hand", "days_of_supply", "stock_status")
        .orderBy(F.col("days_of_supply").asc_nulls_last(), *_ids())
    )


def stockout_risk_summary(t: Tables, horizon_days: float = 14) -> DataFrame:
    return _running_out(t, horizon_days).agg(F.count(F.lit(1)).alias("at_risk_count"))


def abc_xyz(t: Tables, limit: int | None = 100) -> DataFrame:
    """Stored classes if a product table is loaded, else computed ones."""
    return abc_xyz_stored(t) if t.has("products") else abc_xyz_computed(t, limit)


def abc_xyz_stored(t: Tables) -> DataFrame:
    return (
        t["products"]
        .select(
            "product_id",
            "product_name",
            "category",
            "abc_class",
            "xyz_class",
            money(F.col("unit_cost")).alias("unit_cost"),
            money(F.col("unit_price")).alias("unit_price"),
        )
        .orderBy(
            F.col("abc_class").asc_nulls_last(), F.col("xyz_class").asc_nulls_last(), F.col("product_id").asc_nulls_last()
        )
    )


def abc_xyz_computed(t: Tables, limit: int | None = 100) -> DataFrame:
    """Classes by share of revenue (A, B, C) and by variation of quantities (X, Y, Z)."""
    return class_columns(revenue_classes(t["sales_transactions"], limit), "revenue", "abc", "xyz")


def abc_xyz_with_pct(t: Tables, limit: int | None = 100) -> DataFrame:
    """As computed, with each product's share of revenue."""
    return class_columns(revenue_classes(t["sales_transactions"], limit), "revenue", "revenue_pct", "abc", "xyz")


def abc_xyz_classification(t: Tables) -> DataFrame:
    """The classification of every product, in the form ``abc_xyz_lookup`` reads."""
    return class_columns(
        revenue_classes(t["sales_transactions"], None), "abc", "xyz", "revenue_pct", "variability_score"
    )


def abc_xyz_lookup(classification: DataFrame, limit: int | None = 100) -> DataFrame:
    """Reads a stored classification, largest share of revenue first."""
    return _top(
        classification.select("product_id", "abc", "xyz", "revenue_pct", "variability_score"),
        [F.col("revenue_pct").desc_nulls_last(), F.col("product_id").asc_nulls_last()],
        limit,
    )


def _banded(t: Tables, upper: Column, *extra: Column) -> DataFrame:
    critical = F.col("qty_on_hand") < F.col("reorder_point")
    fill = quotient(F.col("qty_on_hand"), F.col("reorder_point"))
    return (
        _latest(t)
        .where(F.col("qty_on_hand") < upper)
        .withColumn("status", F.when(critical, "critical").otherwise("warning"))
        .orderBy(fill.asc_nulls_last(), *_ids())
        .select(*_IDS, "qty_on_hand", "reorder_point", *extra, "status")
    )


def reorder_alerts_banded(t: Tables) -> DataFrame:
    """Critical below the reorder point, warning up to 20 % above it; least filled first."""
    return _banded(t, F.col("reorder_point") * F.lit("1.2").cast("decimal(2,1)"))


def reorder_alerts_banded_summary(t: Tables) -> DataFrame:
    rows = reorder_alerts_banded(t)
    return rows.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(F.col("status") == "critical").alias("critical_count"),
        F.count_if(F.col("status") == "warning").alias("warning_count"),
    )


def reorder_alerts_safety_band(t: Tables) -> DataFrame:
    """Critical below the reorder point, warning up to the safety stock above it."""
    safety = F.col("safety_stock_target")
    return _banded(t, F.col("reorder_point") + safety, safety.alias("safety_stock"))


def dead_stock_with_age(t: Tables, days: int = 90, as_of: str | None = None) -> DataFrame:
    """Positions whose product was never sold or last sold more than ``days`` before ``as_of`` (default today).

    The last sale is found per product first, so the join adds no rows.
    """
    today = F.lit(as_of).cast("date") if as_of else F.current_date()
    last_sale = t["sales_transactions"].groupBy("product_id").agg(F.max("transaction_date").alias("last_sale_date"))
    age = F.date_diff(today, F.col("last_sale_date"))
    value = zero_if_null(money(F.col("qty_on_hand") * F.col("unit_cost")))
    return (
        _latest(t)
        .join(last_sale, "product_id", "left")
        .where(F.col("last_sale_date").isNull() | (age > days))
        .select(
            *_IDS,
            "qty_on_hand",
            money(F.col("unit_cost")).alias("unit_cost"),
            value.alias("value_at_risk"),
            "last_sale_date",
            age.alias("days_since_sale"),
        )
        .distinct()
        .orderBy(F.col("value_at_risk").desc_nulls_last(), *_ids())
    )


def dead_stock_by_last_sale(t: Tables, days: int = 90, as_of: str | None = None) -> DataFrame:
    return dead_stock_with_age(t, days, as_of).drop("days_since_sale")


def dead_stock_by_last_sale_summary(t: Tables, days: int = 90, as_of: str | None = None) -> DataFrame:
    # The total is taken over cents, so its last digits do not depend on the partitioning.
    cents = F.sum(F.col("value_at_risk").cast("decimal(18,2)"))
    return dead_stock_with_age(t, days, as_of).agg(
        F.count(F.lit(1)).alias("total_items"), zero_if_null(money(cents, 2)).alias("total_value_at_risk")
    )
