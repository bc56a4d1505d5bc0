"""What was known, open or near at a point in time: as-of and interval joins, neighbours, tiles and quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import as_double, half_even, half_up, money
from ledgerloom.plans.difference import changes
from ledgerloom.plans.ranks import quantiles_by, ranked, tile
from ledgerloom.plans.timeline import inside_slices, last_known, running, with_neighbours
from ledgerloom.plans.totals import total
from ledgerloom.tables import Tables

SHARES = [0.5, 0.9, 0.99]


def _sales(t: Tables) -> DataFrame:
    return t["sales_transactions"].select("transaction_id", "product_id", "transaction_date", "qty_sold")


def stock_at_sale(t: Tables, strict: bool = False) -> DataFrame:
    """Every sale with the stock its product had at the last snapshot not after it (``strict``: before it), all
    locations together; null where none was taken yet."""
    known = t["inventory_snapshot"].groupBy("product_id", "snapshot_date").agg(F.sum("qty_on_hand").alias("qty_on_hand"))
    return last_known(_sales(t), known, ["product_id"], "transaction_date", "snapshot_date", ["qty_on_hand"], strict)


def receipt_before_sale(t: Tables) -> DataFrame:
    """Every sale with the last day before it on which its product was received, the units of that day and their cost."""
    known = (
        t["purchase_orders"]
        .where(F.col("actual_delivery_date").isNotNull())
        .groupBy("product_id", F.col("actual_delivery_date").alias("received_date"))
        .agg(F.sum("qty_ordered").alias("received_qty"), F.sum("total_po_value").alias("_value"))
    )
    found = last_known(_sales(t), known, ["product_id"], "transaction_date", "received_date", ["received_qty", "_value"], strict=True)
    cost = half_up(as_double(F.col("_value")) / F.nullif(as_double(F.col("received_qty")), F.lit(0.0)), 4)
    return found.withColumn("unit_cost", cost).drop("_value")


def _open_spells(t: Tables) -> DataFrame:
    """Receivables with their days from issue to payment; what was paid by its issue day was never open."""
    ledger = t["ar_ledger"].where(F.col("invoice_date").isNotNull())
    return ledger.where(F.col("paid_date").isNull() | (F.col("paid_date") > F.col("invoice_date")))


def open_receivables_daily(t: Tables) -> DataFrame:
    """For every calendar day from the first invoice to the last event: invoices opened and closed, and what was open at
    its end.

    An invoice counts at its two ends only, never once per day it is open; what the ends add up to per day is one row a
    calendar day.
    """
    end = lambda day, sign: F.struct(F.col(day).alias("day"), F.lit(sign).alias("sign"))
    ends = _open_spells(t).select("invoice_amount", F.inline(F.array(end("invoice_date", 1), end("paid_date", -1)))).where("day IS NOT NULL")
    per_day = ends.groupBy("day").agg(
        F.count_if(F.col("sign") > 0).alias("opened"),
        F.count_if(F.col("sign") < 0).alias("closed"),
        F.sum(F.col("invoice_amount") * F.col("sign")).alias("_change"),
    )
    # One row: the first and the last day.
    calendar = per_day.agg(F.sequence(F.min("day"), F.max("day")).alias("days")).select(F.explode("days").alias("day"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    filled = calendar.join(per_day, "day", "left").select("day", zero("opened").alias("opened"), zero("closed").alias("closed"), zero("_change").alias("_change"))
    sums = {"open_invoices": F.col("opened") - F.col("closed"), "_open": F.col("_change")}
    days = running(filled, [], "day", sums)
    return days.select("day", "opened", "closed", "open_invoices", money(F.col("_open")).alias("open_amount"))


def credit_exposure(t: Tables, over_limit_only: bool = False) -> DataFrame:
    """Every invoice with what its customer owed just before it (earlier invoices not paid by that day), and whether it
    exceeds the customer's credit limit together with that.

    Invoices of a day follow each other by id, payments of a day come before them. The invoices open at a day are never
    looked up one by one: a running sum over issues and payments holds them.
    """
    ledger = t["ar_ledger"].where(F.col("invoice_date").isNotNull()).select("invoice_id", "customer_id", "invoice_date", "paid_date", "invoice_amount")
    lasts = F.col("paid_date").isNull() | (F.col("paid_date") > F.col("invoice_date"))
    none = F.lit(0).cast("decimal(18,2)")
    issue = F.struct(F.col("invoice_date").alias("at"), F.lit(1).alias("rank"), F.when(lasts, F.col("invoice_amount")).otherwise(none).cast("decimal(18,2)").alias("change"), lasts.cast("int").alias("one"))
    payment = F.struct(F.col("paid_date").alias("at"), F.lit(0).alias("rank"), (-F.col("invoice_amount")).cast("decimal(18,2)").alias("change"), F.lit(-1).alias("one"))
    events = ledger.select("*", F.inline(F.when(lasts & F.col("paid_date").isNotNull(), F.array(issue, payment)).otherwise(F.array(issue))))
    summed = running(events, ["customer_id"], "at", {"_open": F.col("change"), "_n": F.col("one")}, [F.col("rank"), F.col("invoice_id")])
    rows = summed.where("rank = 1").select(
        "invoice_id",
        "customer_id",
        "invoice_date",
        "invoice_amount",
        (F.col("_open") - F.col("change")).alias("_before"),
        (F.col("_n") - F.col("one")).alias("open_invoices"),
    )
    limits = t["customers"].select("customer_id", "credit_limit")
    rows = rows.join(limits, "customer_id", "left").select(
        "invoice_id",
        "customer_id",
        "invoice_date",
        money(F.col("invoice_amount")).alias("invoice_amount"),
        money(F.col("_before")).alias("open_amount"),
        "open_invoices",
        (F.col("_before") + F.col("invoice_amount") > F.col("credit_limit")).alias("over_limit"),
    )
    return rows.where("over_limit") if over_limit_only else rows


def order_gaps(t: Tables) -> DataFrame:
    """Every invoice with the days since its customer's previous one and until the next one."""
    rows = t["ar_ledger"].select("customer_id", "invoice_date", "invoice_id")
    near = with_neighbours(rows, ["customer_id"], "invoice_date", ["invoice_id"], before=1, after=1)
    order = inside_slices(["customer_id"], "invoice_date", ["invoice_id"])
    return (
        near.withColumn("days_since_previous", F.date_diff("invoice_date", F.lag("invoice_date").over(order)))
        .withColumn("days_to_next", F.date_diff(F.lead("invoice_date").over(order), F.col("invoice_date")))
        .where("_own")
        .select("invoice_id", "customer_id", "invoice_date", "days_since_previous", "days_to_next")
    )


def moving_revenue(t: Tables, days: int = 7) -> DataFrame:
    """Revenue per product and day with sales, and over the last ``days`` such days of the product."""
    if days < 1:
        raise ValueError("days must be at least 1")
    daily = t["sales_transactions"].groupBy("product_id", "transaction_date").agg(F.sum("total_revenue").alias("revenue"))
    near = with_neighbours(daily, ["product_id"], "transaction_date", [], before=days - 1)
    frame = inside_slices(["product_id"], "transaction_date", []).rowsBetween(1 - days, 0)
    moved = near.withColumn("_moving", F.sum("revenue").over(frame)).withColumn("_days", F.count(F.lit(1)).over(frame))
    return moved.where("_own").select(
        "product_id", "transaction_date", money(F.col("revenue")).alias("revenue"), money(F.col("_moving")).alias("moving_revenue"), F.col("_days").cast("int").alias("days")
    )


def customer_deciles(t: Tables, tiles: int = 10) -> DataFrame:
    """Customers by revenue with their position and which of ``tiles`` nearly equal groups they belong to, best first."""
    if tiles < 1:
        raise ValueError("tiles must be at least 1")
    sales = t["sales_transactions"].where(F.col("customer_id").isNotNull())
    revenue = sales.groupBy("customer_id").agg(F.sum("total_revenue").alias("revenue"))
    rows = ranked(revenue, "revenue", "customer_id")
    number = total(revenue, F.count(F.lit(1)))
    return rows.select("customer_id", money(F.col("revenue")).alias("revenue"), "position", tile(F.col("position"), number, tiles).alias("decile"))


def customer_deciles_summary(t: Tables, tiles: int = 10) -> DataFrame:
    """What each group of customers buys, and its share of all."""
    rows = customer_deciles(t, tiles).groupBy("decile").agg(
        F.count(F.lit(1)).alias("customers"), F.sum(F.col("revenue").cast(T.DecimalType(28, 4))).alias("_revenue")
    )
    # One row per tile.
    whole = F.sum("_revenue").over(Window.partitionBy())
    share = half_even(as_double(F.col("_revenue")) / F.nullif(as_double(whole), F.lit(0.0)) * 100, 2)
    return rows.select("decile", "customers", money(F.col("_revenue")).alias("revenue"), share.alias("revenue_pct")).orderBy("decile")


def purchase_order_changes(t: Tables, as_of: str) -> DataFrame:
    """What changed in the purchase orders since the end of ``as_of``: orders placed since then, and orders received
    since then in their old and new state, as rows added and removed."""
    day = F.lit(as_of).cast("date")
    orders = t["purchase_orders"]
    later = F.col("actual_delivery_date") > day
    unknown = {c: F.when(later, F.lit(None)).otherwise(F.col(c)) for c in ("actual_delivery_date", "delay_days")}
    status = F.when(later, "open").otherwise(F.col("po_status"))
    earlier = orders.where(F.col("po_date") <= day).withColumns({"po_status": status, **unknown})
    return changes(earlier, orders)


def payment_quantiles(t: Tables, shares: list[float] | None = None) -> DataFrame:
    """Exact quantiles of the days to pay per customer segment; invoices of unknown customers form a group."""
    segments = t["customers"].select("customer_id", "segment")
    paid = t["ar_ledger"].select("customer_id", "days_to_pay").join(segments, "customer_id", "left")
    found = quantiles_by(paid, ["segment"], "days_to_pay", shares or SHARES)
    return found.select("segment", "share", F.col("quantile").alias("days_to_pay"), F.col("members").alias("invoices"))


def payment_quantiles_overall(t: Tables, shares: list[float] | None = None) -> DataFrame:
    found = quantiles_by(t["ar_ledger"].select("days_to_pay"), [], "days_to_pay", shares or SHARES)
    return found.select("share", F.col("quantile").alias("days_to_pay"), F.col("members").alias("invoices"))


def sale_value_quantiles(t: Tables, shares: list[float] | None = None) -> DataFrame:
    """Exact quantiles of the revenue of a sale per location."""
    found = quantiles_by(t["sales_transactions"].select("location_id", "total_revenue"), ["location_id"], "total_revenue", shares or SHARES)
    return found.select("location_id", "share", money(F.col("quantile")).alias("revenue"), F.col("members").alias("sales"))
