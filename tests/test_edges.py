"""Hand-made inputs for the corner cases of each question."""

from datetime import date
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from ledgerloom.functions import half_even
from ledgerloom.operators import cash, catalog, demand, inventory, overview, quality, supplier
from ledgerloom.sources.graph import product_vertices, supplier_vertices, supply_edges
from ledgerloom.tables import MissingTable

D = [date(2024, 1, d) for d in range(1, 31)]


def sale(product, qty, revenue, day=D[0], customer="C1", cost=0):
    return dict(
        transaction_date=day,
        product_id=product,
        qty_sold=qty,
        total_revenue=revenue,
        total_cost=cost,
        gross_profit=0,
        customer_id=customer,
    )


def stock(product, qty, day=D[0], **more):
    return dict(product_id=product, qty_on_hand=qty, snapshot_date=day, location_id="L1", **more)


def by(rows, key):
    return {r[key]: r for r in rows}


def test_single_sale(make, rows):
    t = make(sales_transactions=[sale("P1", 3, 10)], products=[dict(product_id="P1", lead_time_days=4)])
    assert rows(inventory.abc_xyz_computed(t))[0]["xyz"] == "Z"
    assert rows(demand.sales_velocity(t))[0]["daily_velocity"] is None
    assert rows(inventory.safety_stock(t))[0] == {
        "product_id": "P1", "safety_stock": 165, "demand_std": 50.0, "lead_time": 4, "z_score": 1.65
    }


def test_sold_products_missing_from_products_and_listed_twice(make, rows):
    t = make(
        sales_transactions=[sale("P9", 3, 10), sale("P1", 1, 5)],
        products=[dict(product_id="P1", lead_time_days=4, unit_cost=2), dict(product_id="P1", lead_time_days=9, unit_cost=3)],
    )
    assert {p: r["lead_time"] for p, r in by(rows(inventory.safety_stock(t)), "product_id").items()} == {"P1": 4, "P9": 14}
    assert len(rows(inventory.safety_stock(t))) == 2
    assert {p: r["unit_cost"] for p, r in by(rows(inventory.eoq(t)), "product_id").items()} == {"P1": 2.0, "P9": 10.0}


def test_alternatives_for_products_without_orders(make, rows):
    t = make(
        products=[dict(product_id="P1"), dict(product_id="P2")],
        suppliers=[dict(supplier_id="S1"), dict(supplier_id="S2")],
        purchase_orders=[dict(supplier_id="S1", product_id="P1")],
    )
    found = {(r["product_id"], r["supplier_id"]) for r in rows(supplier.alternative_suppliers(t))}
    assert found == {("P1", "S2"), ("P2", "S1"), ("P2", "S2")}


def test_age_buckets_as_text(make, rows):
    t = make(inventory_snapshot=[stock("P1", 1, days_since_last_movement=50, inventory_value=1)])
    as_text = rows(inventory.inventory_aging_buckets(t, "0-30,31-60,61-90,90+"))
    assert as_text == rows(inventory.inventory_aging_buckets(t)) and [r["sku_count"] for r in as_text] == [0, 1, 0, 0]


def test_half_even_keeps_infinities(make, spark):
    values = spark.createDataFrame([(float("inf"),), (float("-inf"),), (2.5,), (None,)], "x double")
    got = [r[0] for r in values.select(half_even(F.col("x"))).collect()]
    assert got == [float("inf"), float("-inf"), 2.0, None]


def test_one_product_with_most_revenue_is_never_class_a(make, rows):
    t = make(sales_transactions=[sale("P1", 1, 90), sale("P2", 1, 6), sale("P3", 1, 4)])
    assert [r["abc"] for r in rows(inventory.abc_xyz_computed(t))] == ["B", "C", "C"]
    assert rows(cash.pareto_summary(t)) == [
        {"dimension": "revenue", "total_skus": 3, "skus_driving_80pct": 0, "pct_of_skus": 0.0}
    ]


def test_equal_values_share_their_running_share(make, rows):
    t = make(sales_transactions=[sale(p, 1, 10) for p in ("P1", "P2", "P3")] + [sale("P4", 1, 30)])
    assert [(r["product_id"], r["cum_pct"]) for r in rows(cash.pareto(t))] == [
        ("P4", 50.0), ("P1", 100.0), ("P2", 100.0), ("P3", 100.0)
    ]
    assert [r["product_id"] for r in rows(cash.pareto(t, limit=2))] == ["P4", "P1"]


def test_running_share_with_returns_and_unknown_revenue(make, rows):
    """Negative totals make the running share fall again; unknown totals come last."""
    values = {"P1": 60, "P2": 50, "P3": -10, "P4": None}
    t = make(sales_transactions=[sale(p, 1, v) for p, v in values.items()])
    got = by(rows(cash.pareto(t, limit=None)), "product_id")
    assert {p: r["cum_pct"] for p, r in got.items()} == {"P1": 60.0, "P2": 110.00000000000001, "P3": 100.0, "P4": 100.0}
    assert rows(inventory.abc_xyz_computed(t))[-1]["abc"] == "C"


def test_supplier_risk_null_rules(make, rows):
    base = dict(avg_lead_time_days=15, on_time_delivery_rate=0.8, quality_rejection_rate=0.02)
    t = make(
        suppliers=[
            dict(supplier_id="S0", **base),
            dict(supplier_id="S1", **{**base, "avg_lead_time_days": None}),
            dict(supplier_id="S2", **{**base, "on_time_delivery_rate": None}),
            dict(supplier_id="S3", **{**base, "quality_rejection_rate": None}),
            dict(supplier_id="S4", **{**base, "quality_rejection_rate": float("nan")}),
            dict(supplier_id="S5", avg_lead_time_days=90, on_time_delivery_rate=0.1, quality_rejection_rate=0.2),
        ]
    )
    got = by(rows(supplier.supplier_risk_scores(t)), "supplier_id")
    assert {k: v["risk_score"] for k, v in got.items()} == {
        "S0": 31.0, "S1": 22.0, "S2": 15.0, "S3": None, "S4": None, "S5": 162.0
    }
    assert [got[s]["risk_level"] for s in ("S0", "S1", "S3", "S5")] == ["medium", "low", "low", "high"]


def test_supplier_risk_without_the_columns(spark, rows):
    from ledgerloom.tables import Tables

    t = Tables(spark, {"suppliers": spark.createDataFrame([("S1", "n")], "supplier_id string, supplier_name string")})
    assert rows(supplier.supplier_risk_scores(t))[0] == {
        "supplier_id": "S1", "supplier_name": "n", "risk_score": 19.1, "risk_level": "low",
        "lead_time": None, "otd_rate": None, "qrr": None,
    }


def test_days_payable_with_unpaid_invoices(make, rows):
    t = make(
        ap_ledger=[
            dict(invoice_id="1", supplier_id="S1", invoice_amount=100, actual_days_to_pay=10),
            dict(invoice_id="2", supplier_id="S1", invoice_amount=300),
        ]
    )
    assert rows(overview.kpi_summary(t))[0] == {"dio": 0.0, "dso": 30.0, "dpo": 10.0, "ccc": 20.0}
    assert rows(cash.dpo_overall(t)) == [{"overall_dpo": 2.5}]
    assert rows(cash.dpo_by_supplier(t)) == [{"supplier_id": "S1", "weighted_dpo": 10.0, "invoices": 2}]


def test_order_quantity_fallbacks(make, rows):
    t = make(
        products=[dict(product_id="P1", lead_time_days=0, unit_cost=0), dict(product_id="P2", unit_cost=4)],
        sales_transactions=[sale("P1", 10, 1, D[0]), sale("P1", 30, 1, D[1]), sale("P9", 5, 1)],
    )
    got = by(rows(inventory.eoq(t, ["P1", "P2", "NONE", "P9"])), "product_id")
    assert got["P1"] == {
        "product_id": "P1", "eoq": 540, "annual_demand": 7300, "unit_cost": 10.0, "orders_per_year": 13.5
    }
    assert (got["P2"]["eoq"], got["P2"]["unit_cost"], got["P2"]["orders_per_year"]) == (0, 4.0, 0.0)
    assert (got["NONE"]["eoq"], got["NONE"]["unit_cost"]) == (0, 10.0)
    assert got["P9"]["annual_demand"] == 1825
    assert rows(inventory.safety_stock(t, ["P1"]))[0]["lead_time"] == 14
    assert rows(inventory.eoq(t, ["P1"], holding_cost_pct=0))[0]["eoq"] == 0
    assert {r["z_score"] for r in rows(inventory.safety_stock(t, service_level=0.99))} == {2.33}
    assert {r["z_score"] for r in rows(inventory.safety_stock(t, service_level=0.5))} == {1.65}
    assert {r["product_id"] for r in rows(inventory.eoq(t.without("products")))} == {"P1", "P9"}


def test_unknown_customers(make, rows):
    t = make(
        sales_transactions=[sale("P1", 1, 60, customer=None), sale("P2", 1, 30), sale("P1", 1, 10, customer="C2")],
        customers=[dict(customer_id="C1", customer_name="One")],
    )
    got = rows(demand.customer_concentration(t))
    assert [(r["customer_id"], r["customer_name"], r["revenue_pct"]) for r in got] == [
        (None, None, 60.0), ("C1", "One", 30.0), ("C2", "C2", 10.0)
    ]
    assert rows(demand.customer_concentration_summary(t, limit=1)) == [{"top_pct": 60.0, "concentration_risk": "medium"}]
    assert rows(demand.customer_concentration_summary(t))[0]["concentration_risk"] == "high"
    bare = t.without("customers")
    assert rows(demand.customer_concentration(bare)) == [
        {"customer_id": "C1", "revenue": 30.0}, {"customer_id": "C2", "revenue": 10.0}
    ]
    assert rows(demand.customer_concentration_summary(bare)) == [{"top_pct": 0.0, "concentration_risk": "low"}]


def test_growth_skips_empty_periods(make, rows):
    t = make(
        sales_transactions=[
            sale("P1", 5, 100, date(2024, 1, 3)),
            sale("P1", 5, 150, date(2024, 3, 3)),
            sale("P2", 1, 0, date(2024, 5, 3)),
            sale("P2", 1, 7, date(2024, 6, 3)),
        ]
    )
    assert [r["growth_pct"] for r in rows(demand.revenue_trends(t))] == [None, 50.0, -100.0, 0.0]
    assert rows(demand.revenue_trends(t, "weekly"))[0]["period"] == date(2024, 1, 1)
    assert rows(demand.revenue_trends(t, "daily"))[0]["period"] == date(2024, 1, 3)
    assert rows(demand.seasonality_summary(t)) == [{"peak_month": 1, "low_month": 5}]
    assert [r["index_vs_avg"] for r in rows(demand.seasonality(t))] == [1.67, 1.67, 0.33, 0.33]
    assert rows(demand.seasonality(t, "P2"))[0]["month"] == 5


def test_empty_and_unknown_stock(make, rows):
    t = make(inventory_snapshot=[], sales_transactions=[])
    assert [(r["age_bucket"], r["sku_count"], r["total_value"]) for r in rows(inventory.inventory_aging_buckets(t))] == [
        ("0-30d", 0, 0.0), ("31-60d", 0, 0.0), ("61-90d", 0, 0.0), ("90+d", 0, 0.0)
    ]
    assert rows(overview.kpi_summary(t))[0]["dio"] == 0.0
    assert rows(overview.kpi_simple(t)) == [{"dio": 0.0, "dso": 30.0, "dpo": 0.0, "ccc": 30.0}]
    assert rows(inventory.dead_stock_summary(t)) == [{"items": 0, "total_value_at_risk": 0.0}]
    assert rows(cash.pareto_summary(t))[0]["pct_of_skus"] == 0.0
    assert rows(cash.pareto(t)) == []
    assert rows(cash.ccc_scenarios(t, [("s", 1, 0, 0, None)]))[0]["annual_revenue"] == 100_000_000.0
    undated = make(inventory_snapshot=[stock("P1", 5, None, inventory_value=3, days_since_last_movement=400)])
    assert rows(inventory.dead_stock(undated)) == []
    assert rows(cash.carrying_cost(undated))[0]["total_inventory_value"] == 0.0
    idle = make(inventory_snapshot=[stock("P1", 5, inventory_value=3)])
    assert rows(inventory.inventory_aging(idle))[0]["age_bucket"] == "90+d"
    assert rows(inventory.inventory_aging(idle, buckets=(10,)))[0]["age_bucket"] == "10+d"


def test_repeated_rows_and_score(make, rows):
    line = dict(product_id="P1", product_name="a", unit_cost=1, unit_price=2)
    t = make(products=[line, line, line, {**line, "product_id": "P2"}])
    report = rows(quality.data_quality_report(t))[0]
    assert (report["rows"], report["columns"], report["columns_with_nulls"], report["duplicate_rows"]) == (4, 13, 9, 2)
    assert report["quality_score"] == 100 - 45 - 4
    assert {r["null_count"] for r in rows(quality.null_counts(t))} == {4}
    clean = t["products"].select("product_id", "unit_cost")
    assert rows(quality.check_quality(clean))[0]["quality_score"] == 95
    assert rows(quality.quality_issues(clean)) == [{"type": "duplicates", "count": 2, "severity": "warning"}]
    negative = clean.selectExpr("product_id", "-1 as quantity")
    assert rows(quality.check_quality(negative))[0]["quality_score"] == 85


def test_not_a_number_counts_as_missing(make, rows):
    t = make(suppliers=[dict(supplier_id="S1", supplier_name="x", risk_score=float("nan"))])
    assert "risk_score" in {r["column_name"] for r in rows(quality.null_counts(t))}


@pytest.mark.parametrize(
    "quantities, window, trend, average",
    [
        ([1, 2, 3], 3, "stable", 2.0),  # fewer days than the window: it shrinks
        ([7] * 7, 7, "stable", 7.0),
        ([1] * 13, 7, "stable", 1.0),  # one day short of two windows
        ([1] * 7 + [2] * 7, 7, "increasing", 2.0),
        ([2] * 7 + [1] * 7, 7, "decreasing", 1.0),
        ([10] * 7 + [11] * 7, 7, "stable", 11.0),  # exactly ten per cent more
    ],
)
def test_forecast_windows(make, rows, quantities, window, trend, average):
    t = make(sales_transactions=[sale("P1", q, 1, D[i]) for i, q in enumerate(quantities)])
    got = rows(demand.forecast_demand(t))[0]
    assert (got["historical_days"], got["window"], got["trend"], got["moving_average"]) == (
        len(quantities), window, trend, average
    )
    assert rows(demand.forecast_demand(t, sku="P1", horizon_days=10))[0]["total_predicted"] == average * 10
    assert rows(demand.forecast_demand(t, sku="NONE")) == []


def test_reorder_points_of_zero_and_null(make, rows):
    t = make(
        inventory_snapshot=[
            stock("P1", -1, reorder_point=0, safety_stock_target=5),
            stock("P2", 1, reorder_point=None, safety_stock_target=5),
            stock("P3", 5, reorder_point=10, safety_stock_target=5, stock_status="low_stock", days_of_supply=2.0),
            stock("P4", 11, reorder_point=10, safety_stock_target=5),
            stock("P5", 0, reorder_point=10, stock_status="stockout", days_of_supply=0.0),
        ],
        products=[dict(product_id="P3", economic_order_qty=7)],
    )
    assert [r["product_id"] for r in rows(inventory.reorder_alerts(t))] == ["P1", "P5", "P3"]
    assert rows(inventory.reorder_alerts_summary(t)) == [{"total_alerts": 3}]
    banded = rows(inventory.reorder_alerts_banded(t))
    assert [(r["product_id"], r["status"]) for r in banded] == [
        ("P5", "critical"), ("P3", "critical"), ("P4", "warning"), ("P1", "critical")
    ]
    safety = rows(inventory.reorder_alerts_safety_band(t))
    assert [r["product_id"] for r in safety] == ["P3", "P4", "P1"]
    smart = rows(inventory.smart_reorder(t))
    assert [(r["product_id"], r["eoq"], r["lead_time"], r["priority"]) for r in smart] == [
        ("P5", 100, 14, 1), ("P3", 7, 14, 2), ("P1", 100, 14, 3)
    ]
    assert list(rows(inventory.smart_reorder(t.without("products"), limit=1))[0]) == [
        "product_id", "qty_on_hand", "reorder_point"
    ]


def test_only_the_newest_snapshot_counts(make, rows):
    t = make(
        inventory_snapshot=[
            stock("P1", 9, D[0], inventory_value=100, stock_status="overstock", days_of_supply=1.0),
            stock("P1", 8, D[1], inventory_value=40, stock_status="overstock", reorder_point=1, days_of_supply=0.0),
            stock("P2", 7, D[1], inventory_value=10, stock_status="normal", days_of_supply=14.0),
        ]
    )
    assert rows(inventory.overstock_summary(t)) == [{"overstocked_items": 1, "total_excess_value": 40.0}]
    assert rows(inventory.overstock_summary(t, threshold_multiplier=2)) == [
        {"overstocked_items": 1, "total_excess_value": 40.0}
    ]
    assert [r["product_id"] for r in rows(inventory.stockout_risk(t))] == ["P1"]
    assert rows(cash.working_capital_summary_summary(t, limit=1)) == [{"total_cash_trapped": 40.0}]


def test_dead_stock_by_last_sale(make, rows):
    t = make(
        inventory_snapshot=[stock("P1", 2, unit_cost=5), stock("P2", 1), stock("P3", 3, unit_cost=1), stock("P1", 2, unit_cost=5)],
        sales_transactions=[sale("P1", 1, 1, D[0]), sale("P1", 1, 1, D[3]), sale("P3", 1, 1, D[20])],
    )
    got = rows(inventory.dead_stock_with_age(t, days=10, as_of="2024-01-25"))
    assert [(r["product_id"], r["value_at_risk"], r["days_since_sale"]) for r in got] == [("P1", 10.0, 21), ("P2", 0.0, None)]
    assert rows(inventory.dead_stock_by_last_sale_summary(t, days=10, as_of="2024-01-25")) == [
        {"total_items": 2, "total_value_at_risk": 10.0}
    ]


@pytest.fixture
def graph(make):
    order = lambda s, p: dict(po_id="x", supplier_id=s, product_id=p, qty_ordered=1, total_po_value=10)
    return make(
        suppliers=[
            dict(supplier_id="S1", supplier_name="One", avg_lead_time_days=9, risk_score=5.0),
            dict(supplier_id="S2", supplier_name="Two", risk_score=8.0),
            dict(supplier_id="S3", supplier_name="Idle", avg_lead_time_days=3),
        ],
        purchase_orders=[
            order("S1", "P1"), order("S1", "P1"), order("S1", "P2"), order("S2", "P2"),
            order("S9", "P3"), order("", "P4"), order("S1", ""), order(None, "P1"),
        ],
        products=[
            dict(product_id="P1", product_name="a", category="c", lead_time_days=4),
            dict(product_id="P2", product_name="b", category="c", lead_time_days=8),
            dict(product_id="P3", product_name="d", category="e"),
        ],
        sales_transactions=[sale("P1", 1, 5), sale("P3", 1, 50), sale("F1", 1, 100)],
    )


def test_graph_parts(graph, rows):
    assert {tuple(r.values()) for r in rows(supply_edges(graph))} == {
        ("S1", "P1"), ("S1", "P2"), ("S2", "P2"), ("S9", "P3")
    }
    vertices = by(rows(supplier_vertices(graph)), "supplier_id")
    assert set(vertices) == {"S1", "S2", "S3", "S9"}
    assert (vertices["S2"]["lead_time"], vertices["S3"]["rating"]) == (0, 0.0)
    assert vertices["S9"]["supplier_name"] is None and vertices["S9"]["rating"] is None
    assert {r["product_id"] for r in rows(product_vertices(graph))} == {"P1", "P2", "P3"}
    orders_only = by(rows(supplier_vertices(graph.without("suppliers"))), "supplier_id")
    assert set(orders_only) == {"S1", "S2", "S9"}
    assert len(rows(supplier_vertices(graph.without("purchase_orders")))) == 3


def test_graph_questions(graph, rows):
    assert [(r["supplier_name"], r["product_id"]) for r in rows(supplier.supplier_network(graph))] == [
        ("One", "P1"), ("One", "P2"), ("Two", "P2"), (None, "P3")
    ]
    assert rows(supplier.supplier_network_named(graph))[0]["product_name"] == "a"
    assert [(r["product_id"], r["sole_supplier"]) for r in rows(supplier.single_source_risks(graph))] == [
        ("P1", "One"), ("P3", None)
    ]
    assert [(r["product_id"], r["annual_revenue"]) for r in rows(supplier.single_source_by_revenue(graph))] == [
        ("P3", 50.0), ("P1", 5.0)
    ]
    assert rows(supplier.ripple_effect(graph, "S1")) == [
        {"supplier_id": "S1", "supplier_name": "One", "impacted_count": 2, "severity": "low"}
    ]
    assert rows(supplier.ripple_effect(graph, "NONE")) == []
    assert [r["supplier_id"] for r in rows(supplier.lead_time_listing(graph))] == ["S1", "S3", "S2", "S9"]
    spread = by(rows(supplier.lead_time_variability(graph)), "supplier_id")
    assert (spread["S1"]["avg_lead_time"], spread["S1"]["variability"]) == (6.0, 2.83)
    assert (spread["S9"]["avg_lead_time"], spread["S9"]["variability"]) == (0.0, 0.0)


def test_alternatives(graph, rows):
    everything = rows(supplier.alternative_suppliers(graph))
    for sku in ("P1", "P2", "P3"):
        one = {r["supplier_id"] for r in rows(supplier.alternative_suppliers(graph, sku))}
        assert one == {r["supplier_id"] for r in everything if r["product_id"] == sku}
    assert [r["supplier_id"] for r in rows(supplier.alternative_suppliers(graph, "P1"))] == ["S2", "S3", "S9"]
    assert [r["supplier_id"] for r in rows(supplier.alternative_suppliers(graph, "NONE"))] == ["S2", "S1", "S3", "S9"]
    assert rows(supplier.current_supplier(graph, "P2"))[0]["supplier_id"] == "S1"
    same = rows(supplier.alternative_suppliers_same_category(graph))
    assert [(r["product_id"], r["supplier_id"]) for r in same] == [("P1", "S2")]
    assert [r["supplier_id"] for r in rows(supplier.alternative_suppliers_same_category(graph, "P1"))] == ["S2"]


def test_finished_goods(graph, spark, rows):
    bom = spark.createDataFrame([("P1", "F1"), ("P1", "F2"), ("P2", "F1")], "component_id string, finished_id string")
    got = by(rows(supplier.ripple_with_finished_goods(graph, bom)), "supplier_id")
    # S1: P1 twice, P2 once; revenue of P1 (5) and F1 (100), each once.
    assert (got["S1"]["impacted_count"], got["S1"]["revenue_at_risk"], got["S1"]["severity"]) == (3, 105.0, "medium")
    assert got["S9"]["revenue_at_risk"] == 50.0
    assert rows(supplier.ripple_with_finished_goods(graph, supplier_id="S9"))[0]["impacted_count"] == 1


def test_concentration_of_spend(graph, rows):
    got = rows(supplier.supplier_concentration(graph))
    assert got[0]["supplier_id"] == "S1" and got[0]["value_pct"] == 50.0
    assert rows(supplier.supplier_concentration_summary(graph))[0]["concentration_risk"] == "medium"


def test_receivables_branches(make, rows):
    t = make(
        ar_ledger=[
            dict(invoice_id="1", customer_id="C1", invoice_amount=100, days_to_pay=10, aging_bucket="Current", paid_date=D[0]),
            dict(invoice_id="2", customer_id="C1", invoice_amount=300, days_to_pay=20, aging_bucket="90+ days", dispute_flag=True),
            dict(invoice_id="3", customer_id="C2", invoice_amount=50, aging_bucket="1-30 days", write_off_flag=True),
        ],
        customers=[dict(customer_id="C1", customer_name="One", segment="s")],
    )
    assert rows(cash.dso_by_customer(t)) == [
        {"customer_id": "C1", "customer_name": "One", "segment": "s", "weighted_dso": 17.5, "invoices": 2, "total_billed": 400.0}
    ]
    assert rows(cash.dso_by_customer(t.without("customers"))) == [{"customer_id": "C1", "weighted_dso": 15.0, "invoices": 2}]
    assert rows(cash.dso_overall(t)) == [{"overall_dso": 17.5}]
    assert [r["aging_bucket"] for r in rows(cash.ar_aging(t))] == ["Current", "1-30 days", "90+ days"]
    assert rows(cash.ar_aging_summary(t))[0] == {
        "total_outstanding": 350.0, "dispute_count": 1, "dispute_amount": 300.0, "write_off_count": 1, "write_off_amount": 50.0
    }


def test_filters(make, rows):
    t = make(
        products=[dict(product_id=f"P{i}", category="c" if i < 3 else "d", abc_class="A" if i % 2 else "B") for i in range(5)],
        shipments=[
            dict(shipment_id="1", po_id="p", supplier_id="s", status="In Transit", qty_shipped=5, freight_cost=1),
            dict(shipment_id="2", po_id="p", supplier_id="s", status="Delayed", qty_shipped=5, freight_cost=1, delay_days=3),
            dict(shipment_id="3", po_id="p", supplier_id="s", status="Delayed", qty_shipped=5, freight_cost=1, delay_days=4),
        ],
    )
    assert [r["product_id"] for r in rows(cash.product_catalog(t, category="c", abc_class="A"))] == ["P1"]
    assert len(rows(cash.product_catalog(t))) == 5
    delayed = rows(cash.shipment_tracking(t, "Delayed"))
    assert delayed == [{"status": "Delayed", "count": 2, "total_qty": 10, "total_freight": 2.0, "avg_delay": 3.5}]
    assert len(rows(cash.shipment_tracking(t))) == 2
    assert [r["shipment_id"] for r in rows(cash.shipments_in_transit(t))] == ["1"]


def test_stored_classes_win(make, rows):
    t = make(products=[dict(product_id="P1", abc_class="C"), dict(product_id="P2", abc_class="A")], sales_transactions=[sale("P1", 1, 1)])
    assert [r["product_id"] for r in rows(inventory.abc_xyz(t))] == ["P2", "P1"]
    assert "abc" in inventory.abc_xyz(t.without("products")).columns


def test_scenarios(make, rows):
    t = make(sales_transactions=[sale("P1", 1, 365, D[0]), sale("P1", 1, 365, D[1])])
    got = rows(cash.ccc_scenarios(t, [("a", 1, 2, 3, None), ("b", 1, 0, 0, 730.0), ("c", 0, 0, 1, 0.0)]))
    assert [(r["annual_revenue"], r["total_days_saved"], r["total_cash_freed"]) for r in got] == [
        (133225.0, 6, 2190.0), (730.0, 1, 2.0), (133225.0, 1, 365.0)
    ]
    assert [r["action"] for r in rows(cash.ccc_scenarios_breakdown(t, [("a", 1, 2, 3, None)]))] == [
        "Reduce DIO by 1d", "Reduce DSO by 2d", "Increase DPO by 3d"
    ]


def test_anomalies(make, rows):
    t = make(sales_transactions=[sale("P1", 10, 1)] * 20 + [sale("P2", 100, 1)])
    assert [r["product_id"] for r in rows(demand.detect_anomalies(t))] == ["P2"]
    assert rows(demand.detect_anomalies_summary(t)) == [{"total_rows": 21, "anomalies_found": 1}]
    flat = make(sales_transactions=[sale("P1", 10, 1)] * 3)
    assert rows(demand.detect_anomalies(flat)) == []


def test_partial_dashboard(make, rows):
    t = make(suppliers=[dict(supplier_id="S1", avg_lead_time_days=3), dict(supplier_id="S2", avg_lead_time_days=4)])
    assert rows(overview.full_dashboard(t)) == [{"supplier_count": 2, "avg_lead_time": 3.5, "avg_otd_rate": 0.0}]
    with pytest.raises(MissingTable):
        overview.full_dashboard(t.without("suppliers"))
    with pytest.raises(MissingTable):
        inventory.reorder_alerts(t)
    assert rows(overview.kpi_summary(t.without("suppliers"))) == [{"dio": 0.0, "dso": 30.0, "dpo": 0.0, "ccc": 30.0}]


def test_catalog_of_a_partly_loaded_set(make, rows):
    t = make(suppliers=[dict(supplier_id="S1")])
    uploads = by(rows(catalog.list_uploads(t)), "category")
    assert uploads["suppliers"] == {
        "category": "suppliers", "status": "uploaded", "rows": 1, "destination": "table + graph"
    }
    assert uploads["shipments"]["status"] == "not_uploaded" and uploads["shipments"]["rows"] is None
    state = {(r["store"], r["object"]): r for r in rows(catalog.database_state(t))}
    assert state["table", "suppliers"]["columns"] == 11
    assert state["graph", "suppliers"]["rows"] == 1 and state["graph", "products"]["status"] == "not_loaded"
    assert rows(catalog.database_status(t))[0] == {"tables": 1, "total_rows": 1, "nodes": 1, "relationships": 0}
    assert rows(catalog.database_status(t, 12))[0]["size_bytes"] == 12
    assert len(rows(catalog.schema_info_sample(t, "suppliers"))) == 1
    assert rows(catalog.schema_info(t, "suppliers"))[0] == {"column_name": "supplier_id", "column_type": "string", "rows": 1}
    assert len(rows(catalog.schema_listing(t))) == 13
    assert sum(r["required"] for r in rows(catalog.templates(t, "products"))) == 4
    assert {r["example"] for r in rows(catalog.templates(t, "inventory", legacy=True))} == {"SKU001", "500", "100", None}


def test_graph_sizes_read_the_orders_once(make, rows):
    orders = [dict(po_id=str(i), supplier_id=f"S{i % 3}", product_id=f"P{i % 4}") for i in range(40)]
    orders += [dict(po_id="a", supplier_id="", product_id="P9"), dict(po_id="b", supplier_id="S9", product_id=None)]
    t = make(purchase_orders=orders, suppliers=[dict(supplier_id=s) for s in ("S0", "S0", "S7", None, "")])
    state = {r["object"]: r["rows"] for r in rows(catalog.database_state(t)) if r["store"] == "graph"}
    assert state == {"suppliers": 4, "products": 4, "relationships": 12}
    empty = {r["object"]: r["rows"] for r in rows(catalog.database_state(make(purchase_orders=[]))) if r["store"] == "graph"}
    assert empty == {"suppliers": 0, "products": 0, "relationships": 0}
    assert not rows(catalog.database_state(make(products=[dict(product_id="P1")])))[-1]["rows"]


def test_kpi_record_reads_each_fact_once(make):
    t = make(
        sales_transactions=[dict(product_id="P1", transaction_date=date(2024, 1, 1), total_revenue=Decimal(10), total_cost=Decimal(4))],
        inventory_snapshot=[dict(product_id="P1", snapshot_date=date(2024, 1, 1), inventory_value=Decimal(20))],
    )
    plan = overview.kpi_record(t, "2024-01-02")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("LogicalRDD" in line or "LocalRelation" in line for line in plan.splitlines()) <= 3  # sales, stock, its latest day
    row = overview.kpi_record(t, "2024-01-02").first()
    assert (row.dio, row.dso, row.dpo, row.ccc, row.inventory_turnover) == (5.0, 30.0, 0.0, 35.0, 0.5)


def test_exact_rounding(spark):
    from pyspark.sql import functions as F

    from ledgerloom.functions import half_even, half_up

    values = [0.15, 0.25, 0.35, 0.45, 2.5, 3.5, -0.25, 1234567.85, 1e12 + 0.25, 31.45, 113.15]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", half_even(F.col("v"), 1).alias("one"), half_even(F.col("v")).alias("none")).collect()
    assert [(r.one, r.none) for r in got] == [(round(r.v, 1), float(round(r.v))) for r in got]
    assert df.where("v = 0.25").select(half_up(F.col("v"), 1)).first()[0] == 0.3


def test_money_is_exact(make, rows):
    t = make(sales_transactions=[sale("P1", 1, Decimal("0.1")) for _ in range(10)])
    assert rows(demand.top_skus_brief(t)) == [{"product_id": "P1", "revenue": 1.0, "units": 10}]
