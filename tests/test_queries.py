"""Every registered query against its SQL twin on a second engine."""

import duckdb
import pytest

import __spark_entry__ as registered
from __spark_entry__ import entry
from conftest import SMALL
from ledgerloom.registry import QUESTIONS, TOOLS, ask, call_tool
from ledgerloom.sources.derived import derived_tables



def queries():
    return {k: v for k, v in registered.queries().items() if k not in registered.training_data()[0]}


def oracle_sql():
    return {k: v for k, v in registered.oracle_sql().items() if k not in registered.training_data()[1]}


SOURCES = "region nation customer supplier part orders lineitem".split()
TYPES = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "DATE": "date", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in SOURCES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def test_both_sides_name_the_same_queries():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_same_rows(spark, duck, name):
    df = queries()[name](spark, SMALL)
    other = duck.execute(oracle_sql()[name])
    described = {d[0]: str(d[1]) for d in other.description}
    assert df.columns == list(described)
    for column, type_ in df.dtypes:
        assert TYPES.get(described[column], described[column].lower()) == type_, column
    assert in_order(df.collect()) == in_order(other.fetchall())


def test_entry(spark):
    assert entry(spark).columns == ["dio", "dso", "dpo", "ccc"]


def test_questions_by_name(spark):
    t = derived_tables(spark, SMALL)
    assert ask(t, "top_skus", limit=3).count() == 3
    with pytest.raises(KeyError):
        ask(t, "nothing")
    assert {"kpi_summary", "abc_xyz", "run_sql_query", "ripple_effect"} <= set(QUESTIONS)
    assert all(not n.startswith("_") for n in QUESTIONS)


ARGUMENTS = {
    "forecast_demand": dict(sku="P1", horizon_days=10, window=5),
    "simulate_ccc_improvement": dict(dio_reduction=5, annual_revenue=3650),
    "calculate_safety_stock": dict(skus=["P1", "P2"], service_level=0.9),
    "calculate_eoq": dict(skus=["P1"], order_cost=10, holding_cost_pct=0.1),
    "ripple_effect_analysis": dict(supplier_id="S1"),
    "find_alternative_suppliers": dict(sku="P1"),
    "run_sql_query": dict(sql="SELECT count(*) AS n FROM customers"),
    "get_shipment_tracking": dict(status="Delayed"),
    "get_dead_stock": dict(days=140),
}


@pytest.mark.parametrize("tool", sorted(TOOLS))
def test_every_tool_answers(spark, tool):
    t = derived_tables(spark, SMALL)
    parts = call_tool(t, tool, **ARGUMENTS.get(tool, {}))
    assert set(parts) <= set(TOOLS[tool])
    for df in parts.values():
        assert df.columns and df.limit(1).count() <= 1


def test_tool_arguments_are_checked(spark):
    t = derived_tables(spark, SMALL)
    assert len(TOOLS) == 42
    with pytest.raises(TypeError):
        call_tool(t, "get_top_skus", rows=3)
    assert call_tool(t, "get_top_skus", limit=3)["top_skus"].count() == 3
    assert list(call_tool(t, "get_shipment_tracking", status="Delayed")) == ["shipment_tracking"]
    freed = call_tool(t, "simulate_ccc_improvement", dio_reduction=5, annual_revenue=3650)["ccc_improvement"].first()
    assert (freed.total_days_saved, freed.total_cash_freed) == (5, 50.0)


def test_approximate_counts_are_close(spark):
    t = derived_tables(spark, SMALL)
    exact, close = (ask(t, "full_dashboard", approximate=a).first().unique_products for a in (False, True))
    assert close == pytest.approx(exact, rel=0.15)


def test_invariants(spark):
    run = lambda name: queries()[name](spark, SMALL).collect()
    shares = [r.cum_pct for r in run("pareto_all")]
    assert shares == sorted(shares) and shares[-1] == 100.0
    assert sum(r.value_pct for r in run("supplier_concentration")) == pytest.approx(100)
    aged = sum(r.sku_count for r in run("inventory_aging_buckets"))
    assert aged == len(run("inventory_aging"))
    kpi = run("kpi_summary")[0]
    assert kpi.ccc == round(kpi.dio + kpi.dso - kpi.dpo, 1)
