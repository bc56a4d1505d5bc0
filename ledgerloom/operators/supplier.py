"""Supplier figures and supplier-graph questions (joins on vertices and edges)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import half_even, level, money, quotient, zero_if_null
from ledgerloom.plans.absent import best_absent
from ledgerloom.plans.lineage import materialize, stored
from ledgerloom.plans.paths import reached
from ledgerloom.plans.totals import total
from ledgerloom.sources.graph import ordered_pairs, supplier_vertices, supply_edges, with_supplier
from ledgerloom.tables import Tables


def _finite(c: Column) -> Column:
    """Not-a-number reads as unknown."""
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def supplier_risk_scores(t: Tables) -> DataFrame:
    """Risk from lead time, lateness and rejections, riskiest first.

    Unknown lead time or punctuality adds nothing; an unknown rejection rate
    leaves the score unknown. Columns missing altogether read as 14, 0.9, 0.01.
    """
    s = t["suppliers"]

    def column(name: str, default: float) -> Column:
        return _finite(F.col(name)) if name in s.columns else F.lit(default)

    def shown(name: str, type_: str) -> Column:
        return F.col(name) if name in s.columns else F.lit(None).cast(type_)

    # greatest() and least() skip nulls.
    lead = F.least(F.lit(100.0), F.greatest(F.lit(0.0), (column("avg_lead_time_days", 14.0) - 5) * 3))
    late = F.greatest(F.lit(0.0), (1 - column("on_time_delivery_rate", 0.9)) * 200)
    rejected = column("quality_rejection_rate", 0.01) * 1000
    return (
        s.select(
            "supplier_id",
            "supplier_name",
            half_even(lead * 0.3 + late * 0.4 + rejected * 0.3, 1).alias("risk_score"),
            shown("avg_lead_time_days", "int").alias("lead_time"),
            shown("on_time_delivery_rate", "double").alias("otd_rate"),
            shown("quality_rejection_rate", "double").alias("qrr"),
        )
        .withColumn("risk_level", level(F.col("risk_score"), 60, 30))
        .select("supplier_id", "supplier_name", "risk_score", "risk_level", "lead_time", "otd_rate", "qrr")
        .orderBy(F.col("risk_score").desc_nulls_last(), F.col("supplier_id").asc_nulls_last())
    )


def supplier_performance(t: Tables) -> DataFrame:
    """All supplier columns, most punctual first."""
    return t["suppliers"].orderBy(
        F.col("on_time_delivery_rate").desc_nulls_last(), F.col("supplier_id").asc_nulls_last()
    )


def _spend(t: Tables) -> tuple[DataFrame, Column]:
    """Orders and value per supplier, and the value of all. The total reads both
    sums, so that it needs the very same shuffle as the rows and reuses it."""
    per_supplier = t["purchase_orders"].groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("total_po_value").alias("value")
    )
    whole = total(per_supplier, F.struct(F.sum("value").alias("value"), F.sum("orders").alias("orders")))
    ordered = per_supplier.orderBy(F.col("value").desc_nulls_last(), F.col("supplier_id").asc_nulls_last())
    return ordered, whole["value"]


def supplier_concentration(t: Tables) -> DataFrame:
    """Orders and their value per supplier, with the share of all value."""
    spend, whole = _spend(t)
    return spend.select(
        "supplier_id",
        "orders",
        money(F.col("value")).alias("total_value"),
        (quotient(F.col("value"), whole) * 100).alias("value_pct"),
    )


def supplier_concentration_summary(t: Tables) -> DataFrame:
    """Share of the three largest suppliers."""
    spend, whole = _spend(t)
    top = spend.limit(3).agg(F.sum("value").alias("top"))
    return top.select(zero_if_null(quotient(F.col("top"), whole) * 100).alias("pct")).select(
        half_even(F.col("pct"), 1).alias("top3_value_pct"), level(F.col("pct"), 80, 50).alias("concentration_risk")
    )


def supplier_network(t: Tables) -> DataFrame:
    """Who supplies what; the supplier table when there are no orders to tell."""
    if not t.has("purchase_orders"):
        return t["suppliers"]
    edges = with_supplier(t, supply_edges(t), "supplier_name", "lead_time")
    return edges.select("supplier_id", "supplier_name", "lead_time", "product_id").orderBy(
        F.col("supplier_name").asc_nulls_last(), "supplier_id", "product_id"
    )


def supplier_network_named(t: Tables) -> DataFrame:
    """Who supplies what, with product names."""
    names = t["products"].select("product_id", "product_name")
    return (
        with_supplier(t, supply_edges(t), "supplier_name", "lead_time")
        .join(names, "product_id", "left")
        .select("supplier_id", "supplier_name", "lead_time", "product_id", "product_name")
        .orderBy(F.col("supplier_name").asc_nulls_last(), "supplier_id", "product_id")
    )


def _single_source(t: Tables) -> DataFrame:
    """Products with one supplier. Pairs are made distinct by hashing first; the
    text minimum, which Spark takes by sorting, then sees few rows."""
    return (
        supply_edges(t)
        .groupBy("product_id")
        .agg(F.min("supplier_id").alias("supplier_id"), F.count(F.lit(1)).alias("_suppliers"))
        .where(F.col("_suppliers") == 1)
        .drop("_suppliers")
    )


def _named(t: Tables, rows: DataFrame) -> DataFrame:
    return with_supplier(t, rows, "supplier_name").withColumnRenamed("supplier_name", "sole_supplier")


def single_source_risks(t: Tables, limit: int | None = 50) -> DataFrame:
    """Products that only one supplier delivers."""
    order = [F.col("product_id").asc()]
    rows = _single_source(t).orderBy(*order)
    rows = rows if limit is None else rows.limit(limit)
    return (
        _named(t, rows)
        .select("product_id", "sole_supplier", F.lit("high").alias("risk"))
        .orderBy(*order)
    )


def single_source_by_revenue(t: Tables, limit: int | None = 50) -> DataFrame:
    """The same, by the product's revenue."""
    order = [F.col("annual_revenue").desc_nulls_last(), F.col("product_id").asc()]
    revenue = t["sales_transactions"].groupBy("product_id").agg(
        money(F.sum("total_revenue")).alias("annual_revenue")
    )
    rows = _single_source(t).join(revenue, "product_id", "left").orderBy(*order)
    rows = rows if limit is None else rows.limit(limit)
    return (
        _named(t, rows)
        .select("product_id", "sole_supplier", F.lit("high").alias("risk"), "supplier_id", "annual_revenue")
        .orderBy(*order)
    )


def ripple_effect(t: Tables, supplier_id: str | None = None) -> DataFrame:
    """How many products a supplier's failure would hit; one supplier or all that supply anything."""
    counts = ripple_effect_products(t, supplier_id).groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("impacted_count")
    )
    return with_supplier(t, counts, "supplier_name").select(
        "supplier_id", "supplier_name", "impacted_count", level(F.col("impacted_count"), 10, 3).alias("severity")
    )


def ripple_effect_products(t: Tables, supplier_id: str | None = None) -> DataFrame:
    edges = supply_edges(t)
    return edges if supplier_id is None else edges.where(F.col("supplier_id") == supplier_id)


def ripple_with_finished_goods(
    t: Tables, bom: DataFrame | None = None, supplier_id: str | None = None
) -> DataFrame:
    """Products hit by a failure and, one step on, the finished goods made of them.

    ``bom`` holds (component_id, finished_id). ``impacted_count`` counts
    product / finished-good lines; revenue at risk adds up each product once.
    """
    edges = ripple_effect_products(t, supplier_id)
    if bom is None:
        bom = edges.sparkSession.createDataFrame([], "component_id string, finished_id string")
    parts = bom.select("component_id", "finished_id").distinct()
    lines = edges.join(parts, F.col("product_id") == F.col("component_id"), "left")
    impacted = lines.groupBy("supplier_id").agg(F.count(F.lit(1)).alias("impacted_count"))
    revenue = t["sales_transactions"].groupBy("product_id").agg(F.sum("total_revenue").alias("revenue"))
    finished = lines.where(F.col("finished_id").isNotNull()).select(
        "supplier_id", F.col("finished_id").alias("product_id")
    )
    at_risk = (
        edges.unionByName(finished)
        .distinct()
        .join(revenue, "product_id")
        .groupBy("supplier_id")
        .agg(F.sum("revenue").alias("revenue"))
    )
    return (
        with_supplier(t, impacted.join(at_risk, "supplier_id", "left"), "supplier_name")
        .select(
            "supplier_id",
            "supplier_name",
            "impacted_count",
            zero_if_null(money(F.col("revenue"))).alias("revenue_at_risk"),
            F.when(F.col("impacted_count") > 10, "high").otherwise("medium").alias("severity"),
        )
    )


def ripple_all_levels(t: Tables, bom: DataFrame) -> DataFrame:
    """Per supplier: products it supplies, everything those go into through all levels of ``bom`` (component_id,
    finished_id, quantity), and the revenue of all of them.

    Suppliers are numbered in order of their ids, and a row stands for those of 64 numbers that reach a product, a bit for
    each: the higher a level, the more suppliers share its products.
    """
    pairs = stored(ordered_pairs(t))  # what is ordered twice sets the same bit
    numbers = pairs.select("supplier_id").distinct().orderBy("supplier_id")
    numbers = stored(numbers.select("supplier_id", F.monotonically_increasing_id().alias("_number")))
    block, bit = F.expr("_number >> 6").alias("_block"), F.expr("1L << CAST(_number & 63 AS INT)")
    own = stored(pairs.join(numbers, "supplier_id").groupBy(block, "product_id").agg(F.bit_or(bit).alias("_bits")))
    touched = own.withColumn("_own", F.col("_bits"))
    for level in reached(own, "_block", bom, "_bits"):
        touched = touched.unionByName(level.withColumn("_own", F.lit(0).cast("bigint")))
    # Dealt out by product alone, which the join below needs too: a product has at most a row per block and level.
    touched = touched.repartition("product_id").groupBy("_block", "product_id").agg(F.bit_or("_bits").alias("_bits"), F.bit_or("_own").alias("_own"))
    revenue = t["sales_transactions"].groupBy("product_id").agg(F.sum("total_revenue").alias("revenue"))
    each = touched.join(revenue, "product_id", "left").withColumn("_bit", F.explode(F.sequence(F.lit(0), F.lit(63))))
    each = each.where("getbit(_bits, _bit) = 1").selectExpr("(_block << 6) + _bit AS _number", "getbit(_own, _bit) AS _own", "revenue")
    found = each.groupBy("_number").agg(F.sum("_own").alias("supplied"), F.count(F.lit(1)).alias("impacted"), F.sum("revenue").alias("_revenue"))
    return found.join(numbers, "_number").select(
        "supplier_id", "supplied", "impacted", zero_if_null(money(F.col("_revenue"))).alias("revenue_at_risk")
    )


def ripple_with_finished_goods_lines(
    t: Tables, bom: DataFrame, supplier_id: str | None = None
) -> DataFrame:
    """The lines behind the counts."""
    parts = bom.select("component_id", "finished_id").distinct()
    return (
        ripple_effect_products(t, supplier_id)
        .join(parts, F.col("product_id") == F.col("component_id"), "left")
        .select("supplier_id", "product_id", "finished_id")
    )


def lead_time_listing(t: Tables) -> DataFrame:
    """Suppliers by lead time, longest first."""
    return (
        supplier_vertices(t)
        .select("supplier_id", "supplier_name", "lead_time", "rating")
        .orderBy(F.col("lead_time").desc_nulls_last(), F.col("supplier_id").asc())
    )


def lead_time_variability(t: Tables) -> DataFrame:
    """Spread of the lead times of the products each supplier delivers."""
    lead = t["products"].select("product_id", "lead_time_days")
    per_supplier = (
        supply_edges(t)
        .join(lead, "product_id", "left")
        .groupBy("supplier_id")
        .agg(
            F.count(F.lit(1)).alias("product_count"),
            half_even(zero_if_null(quotient(F.sum("lead_time_days"), F.count("lead_time_days"))), 1).alias(
                "avg_lead_time"
            ),
            F.min("lead_time_days").alias("min_lead_time"),
            F.max("lead_time_days").alias("max_lead_time"),
            half_even(zero_if_null(F.stddev_samp("lead_time_days")), 2).alias("variability"),
        )
    )
    return (
        with_supplier(t, per_supplier, "supplier_name")
        .select(
            "supplier_id",
            "supplier_name",
            "product_count",
            "avg_lead_time",
            "min_lead_time",
            "max_lead_time",
            "variability",
        )
        .orderBy(F.col("variability").desc_nulls_last(), F.col("supplier_id").asc())
    )


def current_supplier(t: Tables, sku: str | None = None) -> DataFrame:
    """The first supplier (by id) of each product, or of one."""
    edges = supply_edges(t)
    if sku is not None:
        edges = edges.where(F.col("product_id") == sku)
    first = edges.groupBy("product_id").agg(F.min("supplier_id").alias("supplier_id"))
    return with_supplier(t, first, "supplier_name", "lead_time", "rating").select(
        "product_id", "supplier_id", "supplier_name", "lead_time", "rating"
    )


def alternative_suppliers(t: Tables, sku: str | None = None, k: int = 5, shortlist: int = 512) -> DataFrame:
    """The ``k`` best-rated suppliers that do not deliver a product, for one product or all listed or ordered ones."""
    order = [F.col("rating").desc_nulls_last(), F.col("supplier_id").asc()]
    pool = supplier_vertices(t).select("supplier_id", "supplier_name", "lead_time", "rating")
    columns = ["product_id", "supplier_id", "supplier_name", "lead_time", "rating"]
    if sku is not None:
        own = supply_edges(t).where(F.col("product_id") == sku).select("supplier_id")
        chosen = pool.join(own, "supplier_id", "left_anti").orderBy(*order).limit(k)
        return chosen.withColumn("product_id", F.lit(sku)).select(*columns)
    holdings = t["purchase_orders"].where((F.col("supplier_id") != "") & (F.col("product_id") != ""))
    items = holdings.select("product_id")
    if t.has("products"):
        items = items.union(t["products"].where(F.col("product_id") != "").select("product_id"))
    return best_absent(
        holdings.select("product_id", "supplier_id"),
        pool,
        order,
        item="product_id",
        member="supplier_id",
        items=items.distinct(),
        k=k,
        shortlist=shortlist,
    ).select(*columns)


def alternative_suppliers_same_category(
    t: Tables, sku: str | None = None, k: int = 5, shortlist: int = 512
) -> DataFrame:
    """As above, among the suppliers of products of the same category; faster delivery breaks rating ties."""
    order = [
        F.col("rating").desc_nulls_last(),
        F.col("lead_time").asc_nulls_last(),
        F.col("supplier_id").asc(),
    ]
    columns = ["product_id", "supplier_id", "supplier_name", "lead_time", "rating", "country"]
    items = t["products"].where(F.col("category").isNotNull()).select("product_id", "category")
    vertices = supplier_vertices(t).select("supplier_id", "supplier_name", "lead_time", "rating", "country")
    holdings = supply_edges(t).join(items, "product_id")
    if sku is None:
        # Read for the pool and again for the holdings.
        holdings = materialize(holdings)
    pool = holdings.select("category", "supplier_id").distinct().join(vertices, "supplier_id")
    if sku is not None:
        category = items.where(F.col("product_id") == sku).select("category").distinct()
        own = supply_edges(t).where(F.col("product_id") == sku).select("supplier_id")
        chosen = (
            pool.join(category, "category", "left_semi").join(own, "supplier_id", "left_anti").orderBy(*order).limit(k)
        )
        return chosen.withColumn("product_id", F.lit(sku)).select(*columns)
    return best_absent(
        holdings,
        pool,
        order,
        item="product_id",
        member="supplier_id",
        items=items,
        group="category",
        k=k,
        shortlist=shortlist,
    ).select(*columns)
