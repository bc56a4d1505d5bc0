"""Declared model: the nine tables, the two support tables and the code lists.

Everything that needs to know a column name or type (ingestion, templates,
DDL, catalog reports) reads it from here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    """One table: DDL fragments of its required and optional columns."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    graph: bool = False
    partition_by: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(", ".join(self.required + self.optional))

    @property
    def required_columns(self) -> list[str]:
        return [c.split()[0] for c in self.required]

    @property
    def optional_columns(self) -> list[str]:
        return [c.split()[0] for c in self.optional]

    @property
    def destination(self) -> str:
        return "table + graph" if self.graph else "table"


def _spec(name, required, optional, **kw) -> TableSpec:
    split = lambda ddl: tuple(part.strip() for part in ddl.split(";") if part.strip())
    return TableSpec(name, split(required), split(optional), **kw)


# Table and column names are the input contract.
TABLES: dict[str, TableSpec] = {
    s.name: s
    for s in (
        _spec(
            "products",
            "product_id string; product_name string; unit_cost decimal(12,2); unit_price decimal(12,2)",
            "category string; subcategory string; supplier_id string; lead_time_days int; abc_class string;"
            "xyz_class string; reorder_point int; economic_order_qty int; safety_stock_target int",
        ),
        _spec(
            "customers",
            "customer_id string; customer_name string",
            "segment string; region string; state string; credit_limit decimal(12,2);"
            "contracted_payment_days int; risk_score double; ytd_revenue decimal(12,2); avg_days_to_pay int",
        ),
        _spec(
            "suppliers",
            "supplier_id string; supplier_name string",
            "category string; segment string; country string; contracted_payment_days int;"
            "avg_lead_time_days int; on_time_delivery_rate double; quality_rejection_rate double;"
            "risk_score double; annual_spend decimal(12,2)",
            graph=True,
        ),
        _spec(
            "inventory_snapshot",
            "product_id string; qty_on_hand int",
            "snapshot_date date; location_id string; qty_in_transit int; qty_committed int; qty_available int;"
            "safety_stock_target int; reorder_point int; days_of_supply double; unit_cost decimal(12,2);"
            "inventory_value decimal(18,2); stock_status string; days_since_last_movement int",
            partition_by=("snapshot_date",),
        ),
        _spec(
            "sales_transactions",
            "transaction_date date; product_id string; qty_sold int; total_revenue decimal(18,4)",
            "transaction_id string; customer_id string; location_id string; unit_price decimal(12,2);"
            "unit_cost decimal(12,2); total_cost decimal(18,4); gross_profit decimal(19,4);"
            "profit_margin double; channel string; is_promotional boolean; invoice_id string",
        ),
        _spec(
            "purchase_orders",
            "po_id string; supplier_id string; product_id string; qty_ordered int",
            "po_date date; location_id string; qty_received int; unit_cost decimal(12,2);"
            "total_po_value decimal(18,2); expected_delivery_date date; actual_delivery_date date;"
            "po_status string; delay_days int; invoice_id string",
            graph=True,
        ),
        _spec(
            "ar_ledger",
            "invoice_id string; customer_id string; invoice_amount decimal(18,2)",
            "transaction_id string; invoice_date date; due_date date; paid_amount decimal(18,2); paid_date date;"
            "days_to_pay int; is_overdue boolean; days_overdue int; aging_bucket string;"
            "dispute_flag boolean; write_off_flag boolean",
        ),
        _spec(
            "ap_ledger",
            "invoice_id string; supplier_id string; invoice_amount decimal(18,2)",
            "po_id string; invoice_date date; due_date date; paid_amount decimal(18,2); paid_date date;"
            "contracted_days int; actual_days_to_pay int; early_payment_discount decimal(12,2);"
            "payment_status string; dpo_contribution double",
        ),
        _spec(
            "shipments",
            "shipment_id string; po_id string; supplier_id string",
            "product_id string; origin_location string; destination_location_id string; ship_date date;"
            "expected_arrival_date date; actual_arrival_date date; qty_shipped int; freight_cost decimal(12,2);"
            "carrier string; tracking_number string; status string; delay_days int",
        ),
    )
}

TABLE_NAMES: tuple[str, ...] = tuple(TABLES)

UPLOAD_LOG = (
    "id bigint, file_category string, filename string, upload_timestamp timestamp, row_count bigint, "
    "status string, storage_path string"
)
UPLOAD_LOG_COLUMNS = ("id", "file_category", "filename", "upload_timestamp", "row_count", "status")

KPI_HISTORY = "date date, dio double, dso double, dpo double, ccc double, inventory_turnover double"

# The older four-file layout, still offered as templates and DDL.
LEGACY_TABLES: dict[str, TableSpec] = {
    s.name: s
    for s in (
        _spec(
            "sales",
            "date date; sku string; quantity int; revenue decimal(12,2)",
            "customer_name string; region string; category string",
        ),
        _spec(
            "inventory",
            "sku string; qty_on_hand int; reorder_point int",
            "location string; unit_cost decimal(10,2); supplier_id string",
        ),
        _spec(
            "suppliers",
            "supplier_id string; supplier_name string; lead_time int",
            "contact_email string; rating decimal(3,1); country string",
        ),
        _spec(
            "purchase_orders",
            "po_number string; sku string; quantity int",
            "order_date date; delivery_date date; supplier_id string",
        ),
    )
}

# Example rows shown with the older templates.
LEGACY_EXAMPLES: dict[str, dict[str, str]] = {
    "sales": {"date": "2024-01-01", "sku": "SKU001", "quantity": "100", "revenue": "5000.0"},
    "inventory": {"sku": "SKU001", "qty_on_hand": "500", "reorder_point": "100"},
    "suppliers": {"supplier_id": "SUP001", "supplier_name": "Acme Corp", "lead_time": "14"},
    "purchase_orders": {"po_number": "PO001", "sku": "SKU001", "quantity": "1000"},
}

# Code lists the questions rely on.
AGE_BUCKETS = ("0-30d", "31-60d", "61-90d", "90+d")
AGING_ORDER = ("Current", "1-30 days", "31-60 days", "61-90 days")
SERVICE_LEVEL_Z = {0.90: 1.28, 0.95: 1.65, 0.99: 2.33}
DEFAULT_Z = 1.65

GRAPH = {"name": "supply_chain", "nodes": ("Supplier", "Product"), "relationships": ("SUPPLIES",)}
