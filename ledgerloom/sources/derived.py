"""The nine tables derived from a star-schema data set.

Column expressions are plain SQL text, kept as data so that a second engine
can build the same nine inputs from the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.tables import Tables

SNAPSHOTS = ("2001-05-31", "2001-06-30", "2001-07-31")
LOCATIONS = (0, 1, 2)


def _text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _dec(x: str, p: int, s: int) -> str:
    return f"CAST({x} AS DECIMAL({p},{s}))"


_PRICE = _dec("p_retailprice", 12, 2)
_COST = _dec(f"{_PRICE} * {_dec('0.6', 2, 1)}", 12, 2)
_EXTENDED = _dec("l_extendedprice", 12, 2)
_REVENUE = _dec(f"{_EXTENDED} * ({_dec('1', 3, 2)} - {_dec('l_discount', 3, 2)})", 18, 4)
_SALE_COST = _dec(f"CAST(l_quantity AS INT) * {_PRICE} * {_dec('0.6', 2, 1)}", 18, 4)
_ORDER_DATE = "CAST(o_orderdate AS DATE)"
_PO_VALUE = _dec(f"{_EXTENDED} * 6", 18, 2)
# Every fifth part is bought from one supplier only.
_SUPPLIER = "CASE WHEN l_partkey % 5 = 0 THEN l_partkey % 7 + 1 ELSE l_suppkey END"
_EXPECTED = f"{_ORDER_DATE} + CAST(5 + l_suppkey % 41 AS INT)"
_DELAY = "CAST(l_orderkey % 15 - 5 AS INT)"
_OPEN = "l_linestatus = 'O'"
_DAYS = "CAST(5 + o_orderkey % 120 AS INT)"

COLUMNS: dict[str, list[tuple[str, str]]] = {
    "products": [
        ("product_id", f"'P' || {_text('p_partkey')}"),
        ("product_name", "p_name"),
        ("category", "p_type"),
        ("subcategory", "p_brand"),
        ("unit_cost", f"CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE {_COST} END"),
        ("unit_price", _PRICE),
        ("lead_time_days", "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE 5 + p_size % 26 END"),
        ("abc_class", "CASE WHEN p_partkey % 10 < 2 THEN 'A' WHEN p_partkey % 10 < 5 THEN 'B' ELSE 'C' END"),
        ("xyz_class", "CASE WHEN p_partkey % 3 = 0 THEN 'X' WHEN p_partkey % 3 = 1 THEN 'Y' ELSE 'Z' END"),
        ("reorder_point", "20 + p_size"),
        ("economic_order_qty", "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 50 + p_size * 4 END"),
        ("safety_stock_target", "10 + p_size % 20"),
    ],
    "customers": [
        ("customer_id", f"'C' || {_text('c_custkey')}"),
        ("customer_name", "c_name"),
        ("segment", "c_mktsegment"),
        ("region", "r_name"),
        ("state", "n_name"),
        ("credit_limit", _dec("10000 + c_custkey % 40 * 1000", 12, 2)),
        ("contracted_payment_days", "CAST(30 + 15 * (c_custkey % 3) AS INT)"),
        ("risk_score", "CAST(c_custkey % 100 AS DOUBLE)"),
        ("ytd_revenue", _dec("c_acctbal", 12, 2)),
        ("avg_days_to_pay", "CAST(20 + c_custkey % 50 AS INT)"),
    ],
    "suppliers": [
        ("supplier_id", f"'S' || {_text('s_suppkey')}"),
        ("supplier_name", "s_name"),
        ("country", "n_name"),
        ("contracted_payment_days", "CAST(30 + 15 * (s_suppkey % 3) AS INT)"),
        ("avg_lead_time_days", "CASE WHEN s_suppkey % 13 = 12 THEN NULL ELSE CAST(5 + s_suppkey % 41 AS INT) END"),
        ("on_time_delivery_rate", f"CAST({_dec('60 + s_suppkey * 7 % 40', 6, 2)} / 100 AS DOUBLE)"),
        (
            "quality_rejection_rate",
            f"CASE WHEN s_suppkey % 17 = 16 THEN NULL ELSE CAST({_dec('s_suppkey * 3 % 50', 6, 3)} / 1000 AS DOUBLE) END",
        ),
        ("risk_score", "CAST(s_suppkey * 11 % 100 AS DOUBLE)"),
        ("annual_spend", _dec("s_acctbal", 12, 2)),
    ],
    "sales_transactions": [
        ("transaction_id", f"'T' || {_text('l_orderkey')} || '-' || {_text('l_linenumber')}"),
        ("transaction_date", _ORDER_DATE),
        ("product_id", f"'P' || {_text('l_partkey')}"),
        ("customer_id", f"CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE 'C' || {_text('o_custkey')} END"),
        ("location_id", f"'L' || {_text('l_orderkey % 5')}"),
        ("qty_sold", "CAST(l_quantity AS INT)"),
        ("total_revenue", _REVENUE),
        ("total_cost", _SALE_COST),
        ("gross_profit", f"{_REVENUE} - {_SALE_COST}"),
    ],
    "inventory_snapshot": [
        ("product_id", f"'P' || {_text('p_partkey')}"),
        ("snapshot_date", "snapshot_date"),
        ("location_id", f"'L' || {_text('loc')}"),
        ("qty_on_hand", "q"),
        ("reorder_point", "20 + p_size"),
        ("safety_stock_target", "10 + p_size % 20"),
        ("unit_cost", _COST),
        ("inventory_value", _dec(f"q * {_COST}", 18, 2)),
        ("days_of_supply", "CAST(q AS DOUBLE) / CAST(1 + p_size % 9 AS DOUBLE)"),
        (
            "stock_status",
            "CASE WHEN q = 0 THEN 'stockout' WHEN q < 20 + p_size THEN 'low_stock' "
            "WHEN q > 160 THEN 'overstock' ELSE 'normal' END",
        ),
        ("days_since_last_movement", "CAST((p_partkey * 13 + loc * 7 + k) % 150 AS INT)"),
    ],
    "purchase_orders": [
        ("po_id", f"'PO' || {_text('l_orderkey')} || '-' || {_text('l_linenumber')}"),
        ("po_date", _ORDER_DATE),
        ("supplier_id", f"'S' || {_text(_SUPPLIER)}"),
        ("product_id", f"'P' || {_text('l_partkey')}"),
        ("qty_ordered", "CAST(l_quantity * 10 AS INT)"),
        ("total_po_value", _PO_VALUE),
        ("expected_delivery_date", _EXPECTED),
        ("actual_delivery_date", f"CASE WHEN {_OPEN} THEN NULL ELSE {_EXPECTED} + {_DELAY} END"),
        ("po_status", f"CASE WHEN {_OPEN} THEN 'open' ELSE 'received' END"),
        ("delay_days", f"CASE WHEN {_OPEN} THEN NULL ELSE {_DELAY} END"),
    ],
    "ar_ledger": [
        ("invoice_id", f"'INV' || {_text('o_orderkey')}"),
        ("customer_id", f"'C' || {_text('o_custkey')}"),
        ("invoice_amount", _dec("o_totalprice", 18, 2)),
        ("invoice_date", _ORDER_DATE),
        ("due_date", f"{_ORDER_DATE} + 30"),
        ("paid_date", f"CASE WHEN o_orderstatus = 'O' THEN NULL ELSE {_ORDER_DATE} + {_DAYS} END"),
        ("days_to_pay", f"CASE WHEN o_orderstatus = 'O' THEN NULL ELSE {_DAYS} END"),
        ("is_overdue", f"{_DAYS} > 30"),
        (
            "aging_bucket",
            f"CASE WHEN {_DAYS} <= 30 THEN 'Current' WHEN {_DAYS} <= 60 THEN '1-30 days' "
            f"WHEN {_DAYS} <= 90 THEN '31-60 days' WHEN {_DAYS} <= 120 THEN '61-90 days' ELSE '90+ days' END",
        ),
        ("dispute_flag", "o_orderkey % 29 = 0"),
        ("write_off_flag", "o_orderkey % 97 = 0"),
    ],
    "ap_ledger": [
        ("invoice_id", f"'API' || {_text('l_orderkey')} || '-' || {_text('l_linenumber')}"),
        ("supplier_id", f"'S' || {_text(_SUPPLIER)}"),
        ("po_id", f"'PO' || {_text('l_orderkey')} || '-' || {_text('l_linenumber')}"),
        ("invoice_amount", _PO_VALUE),
        ("actual_days_to_pay", f"CASE WHEN {_OPEN} THEN NULL ELSE CAST(15 + l_orderkey % 60 AS INT) END"),
        ("early_payment_discount", _dec("CASE WHEN l_orderkey % 7 = 0 THEN 25 ELSE 0 END", 12, 2)),
        ("payment_status", f"CASE WHEN {_OPEN} THEN 'pending' ELSE 'paid' END"),
    ],
    "shipments": [
        ("shipment_id", f"'SH' || {_text('l_orderkey')} || '-' || {_text('l_linenumber')}"),
        ("po_id", f"'PO' || {_text('l_orderkey')} || '-' || {_text('l_linenumber')}"),
        ("supplier_id", f"'S' || {_text(_SUPPLIER)}"),
        ("product_id", f"'P' || {_text('l_partkey')}"),
        ("ship_date", f"{_ORDER_DATE} + 2"),
        ("expected_arrival_date", _EXPECTED),
        ("qty_shipped", "CAST(l_quantity * 10 AS INT)"),
        ("freight_cost", _dec("50 + l_orderkey % 400", 12, 2)),
        ("carrier", f"'CR' || {_text('l_orderkey % 6')}"),
        (
            "status",
            f"CASE WHEN {_OPEN} THEN 'In Transit' WHEN {_DELAY} > 0 THEN 'Delayed' ELSE 'Delivered' END",
        ),
        ("delay_days", f"CASE WHEN {_OPEN} THEN NULL ELSE {_DELAY} END"),
    ],
}

STOCK_QTY = "CAST((p_partkey * 37 + loc * 53 + k * 29) % 200 AS INT)"


def derived_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The nine tables over ``sf_dir``; each is built when first used.

    No join is hinted: dimension sides are broadcast only while Spark's own
    size check allows it, and skewed keys are left to adaptive execution.
    """

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def orders_with_lines(lines: DataFrame) -> DataFrame:
        return lines.join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))

    def purchases() -> DataFrame:
        return orders_with_lines(read("lineitem"))

    def positions() -> DataFrame:
        cells = [
            f"named_struct('loc', {loc}, 'k', {k}, 'snapshot_date', DATE '{day}')"
            for loc in LOCATIONS
            for k, day in enumerate(SNAPSHOTS)
        ]
        return (
            read("part")
            .selectExpr("p_partkey", "p_size", "p_retailprice", f"inline(array({', '.join(cells)}))")
            .withColumn("q", F.expr(STOCK_QTY))
        )

    bases = {
        "products": lambda: read("part"),
        "customers": lambda: read("customer")
        .join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")),
        "suppliers": lambda: read("supplier").join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey")),
        "sales_transactions": lambda: orders_with_lines(read("lineitem")).join(
            read("part"), F.col("l_partkey") == F.col("p_partkey")
        ),
        "inventory_snapshot": positions,
        "purchase_orders": purchases,
        "ar_ledger": lambda: read("orders"),
        "ap_ledger": purchases,
        "shipments": purchases,
    }

    def build(name: str) -> DataFrame:
        return bases[name]().selectExpr(*(f"{expr} AS {column}" for column, expr in COLUMNS[name]))

    return Tables(spark, {name: (lambda name=name: build(name)) for name in bases})
