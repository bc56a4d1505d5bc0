"""The supplier graph as three frames; every graph question is a join on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.tables import Tables


def _filled(column: str) -> Column:
    return F.col(column).isNotNull() & (F.col(column) != "")


def _or_missing(df: DataFrame, column: str, type_: str) -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast(type_)


def ordered_pairs(t: Tables) -> DataFrame:
    """The (supplier_id, product_id) of all orders that name both, as often as they were ordered."""
    return t["purchase_orders"].where(_filled("supplier_id") & _filled("product_id")).select("supplier_id", "product_id")


def supply_edges(t: Tables) -> DataFrame:
    """Distinct (supplier_id, product_id) pairs that were ordered at least once."""
    return ordered_pairs(t).distinct()


def described_suppliers(t: Tables) -> DataFrame:
    """Ids in the supplier table, as often as they stand there."""
    return t["suppliers"].where(_filled("supplier_id")).select("supplier_id")


def known_suppliers(t: Tables) -> DataFrame:
    """Vertices described in the supplier table; missing numbers read as 0."""
    s = t["suppliers"]
    # One row per id; max_by over the whole row keeps its values together.
    properties = F.struct(
        F.col("supplier_name"),
        F.coalesce(_or_missing(s, "avg_lead_time_days", "int"), F.lit(0)).alias("lead_time"),
        F.coalesce(_or_missing(s, "risk_score", "double"), F.lit(0.0)).alias("rating"),
        F.coalesce(_or_missing(s, "on_time_delivery_rate", "double"), F.lit(0.0)).alias("otd_rate"),
        F.coalesce(_or_missing(s, "country", "string"), F.lit("")).alias("country"),
    )
    return (
        s.where(_filled("supplier_id"))
        .groupBy("supplier_id")
        .agg(F.max(properties).alias("p"))
        .select("supplier_id", "p.*")
    )


# Vertex properties and their types.
PROPERTIES = {
    "supplier_name": "string",
    "lead_time": "int",
    "rating": "double",
    "otd_rate": "double",
    "country": "string",
}


def with_supplier(t: Tables, rows: DataFrame, *properties: str) -> DataFrame:
    """Adds supplier properties to rows that carry the id of an ordered-from supplier.

    Such a supplier has a vertex anyway; one without a description gets nulls.
    """
    if t.has("suppliers"):
        return rows.join(known_suppliers(t).select("supplier_id", *properties), "supplier_id", "left")
    return rows.withColumns({p: F.lit(None).cast(PROPERTIES[p]) for p in properties})


def supplier_vertices(t: Tables) -> DataFrame:
    """All suppliers; one that only appears in orders has an id and nothing else."""
    if not t.has("purchase_orders"):
        return known_suppliers(t)
    ordered = t["purchase_orders"].where(_filled("supplier_id") & _filled("product_id")).select("supplier_id").distinct()
    if not t.has("suppliers"):
        return with_supplier(t, ordered, *PROPERTIES)
    known = known_suppliers(t)
    bare = ordered.join(known.select("supplier_id"), "supplier_id", "left_anti")
    return known.unionByName(bare, allowMissingColumns=True)


def product_vertices(t: Tables) -> DataFrame:
    """Products that were ordered at least once."""
    orders = t["purchase_orders"]
    return orders.where(_filled("supplier_id") & _filled("product_id")).select("product_id").distinct()
