"""All questions by name. Adding a function here is the extension point."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame

from ledgerloom.operators import cash, catalog, demand, freesql, inventory, levels, overview, quality, states, supplier, timeline
from ledgerloom.tables import Tables

_MODULES = (overview, quality, inventory, cash, demand, supplier, catalog, freesql, timeline, levels, states)

# Helpers in those modules that are not questions over tables.
_OTHER = {
    "abc_xyz_lookup",
    "check_quality",
    "check_read_only",
    "kpi_from_states",
    "reach_from_states",
    "trends_from_states",
    "duplicate_rows",
    "quality_issues",
}

QUESTIONS: dict[str, Callable[..., DataFrame]] = {
    name: fn
    for module in _MODULES
    for name, fn in vars(module).items()
    if callable(fn)
    and not isinstance(fn, type)
    and getattr(fn, "__module__", None) == module.__name__
    and not name.startswith("_")
    and name not in _OTHER
}


def ask(tables: Tables, name: str, **parameters) -> DataFrame:
    """Answers a question by name."""
    if name not in QUESTIONS:
        raise KeyError(f"unknown question {name!r}; known: {sorted(QUESTIONS)}")
    return QUESTIONS[name](tables, **parameters)


# The 42 tool names clients call, and the questions that answer each.
TOOLS: dict[str, tuple[str, ...]] = {
    "get_full_dashboard": ("full_dashboard",),
    "get_kpi_summary": ("kpi_summary",),
    "get_data_quality_report": ("data_quality_report", "null_counts"),
    "get_reorder_alerts": ("reorder_alerts", "reorder_alerts_summary"),
    "get_smart_reorder_recommendations": ("smart_reorder",),
    "calculate_safety_stock": ("safety_stock",),
    "calculate_eoq": ("eoq",),
    "get_inventory_turnover": ("inventory_turnover",),
    "get_inventory_aging": ("inventory_aging", "inventory_aging_buckets"),
    "get_dead_stock": ("dead_stock", "dead_stock_summary"),
    "get_overstock_analysis": ("overstock", "overstock_summary"),
    "get_stockout_risk": ("stockout_risk", "stockout_risk_summary"),
    "get_abc_xyz_classification": ("abc_xyz",),
    "simulate_ccc_improvement": ("ccc_improvement", "ccc_improvement_breakdown"),
    "get_working_capital_summary": ("working_capital_summary", "working_capital_summary_summary"),
    "get_carrying_cost_analysis": ("carrying_cost",),
    "get_pareto_analysis": ("pareto", "pareto_summary"),
    "get_ar_aging": ("ar_aging", "ar_aging_summary"),
    "get_dso_analysis": ("dso_by_customer", "dso_overall"),
    "get_dpo_analysis": ("dpo_by_supplier", "dpo_overall"),
    "forecast_demand": ("forecast_demand",),
    "detect_anomalies": ("detect_anomalies", "detect_anomalies_summary"),
    "get_revenue_trends": ("revenue_trends",),
    "get_sales_velocity": ("sales_velocity",),
    "get_top_skus": ("top_skus",),
    "get_customer_concentration": ("customer_concentration", "customer_concentration_summary"),
    "get_seasonality_analysis": ("seasonality", "seasonality_summary"),
    "get_supplier_risk_scores": ("supplier_risk_scores",),
    "get_supplier_performance": ("supplier_performance",),
    "get_supplier_concentration": ("supplier_concentration", "supplier_concentration_summary"),
    "get_supplier_network": ("supplier_network",),
    "find_single_source_risks": ("single_source_risks",),
    "ripple_effect_analysis": ("ripple_effect", "ripple_effect_products"),
    "get_lead_time_variability": ("lead_time_listing",),
    "find_alternative_suppliers": ("alternative_suppliers", "current_supplier"),
    "list_uploads": ("list_uploads",),
    "get_schema_info": ("schema_info", "schema_info_sample"),
    "run_sql_query": ("run_sql_query", "run_sql_query_summary"),
    "get_version_history": ("version_history",),
    "trigger_database_refresh": ("database_state",),
    "get_shipment_tracking": ("shipment_tracking", "shipments_in_transit"),
    "get_product_catalog": ("product_catalog",),
}


def call_tool(tables: Tables, tool: str, **arguments) -> dict[str, DataFrame]:
    """Everything a tool answers with, one frame per part; each part takes the arguments it knows."""
    if tool not in TOOLS:
        raise KeyError(f"unknown tool {tool!r}; known: {sorted(TOOLS)}")
    known = {name: inspect.signature(QUESTIONS[name]).parameters for name in TOOLS[tool]}
    unknown = set(arguments) - {p for parameters in known.values() for p in parameters}
    if unknown:
        raise TypeError(f"{tool} has no arguments {sorted(unknown)}")
    parts = {
        name: QUESTIONS[name](tables, **{k: v for k, v in arguments.items() if k in parameters})
        for name, parameters in known.items()
        # The list of open shipments only belongs to the unfiltered overview.
        if not (name == "shipments_in_transit" and arguments.get("status"))
    }
    return parts
