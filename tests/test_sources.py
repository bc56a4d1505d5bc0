"""CSV ingestion, the versioned store, catalog tables and sinks."""

from datetime import date
from decimal import Decimal

import pytest

from ledgerloom.operators import catalog, inventory, overview
from ledgerloom.sources.files import (
    BAD_CELLS,
    CORRUPT,
    MissingColumns,
    UnknownCategory,
    read_csv,
    store_file,
    validate_file,
    write_json,
)
from ledgerloom.sources.store import RejectedFile, Store, create_tables, drop_tables, save_table, table_ddl
from ledgerloom.tables import Tables


@pytest.fixture
def csv(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_text(text)
        return str(path)

    return write


PRODUCTS = (
    "unit_price,product_id,product_name,unit_cost,lead_time_days,colour\n"
    '2.50,P1,"a, b",1.25,14.0,red\n'
    "3,P2,NaN,,NA,\n"
)


def test_types_follow_names_not_positions(spark, csv):
    got = [r.asDict() for r in read_csv(spark, csv("p.csv", PRODUCTS), "products").collect()]
    assert got[0] == {
        "unit_price": Decimal("2.50"), "product_id": "P1", "product_name": "a, b", "unit_cost": Decimal("1.25"),
        "lead_time_days": 14, "colour": "red", BAD_CELLS: [], CORRUPT: None,
    }
    assert (got[1]["product_name"], got[1]["unit_cost"], got[1]["lead_time_days"]) == (None, None, None)


def test_bad_cells_and_broken_lines_are_reported(spark, csv):
    path = csv("p.csv", "product_id,product_name,unit_cost,unit_price,lead_time_days\nP1,a,x,1,2.5\nP2,b,1,1,3\nP3,c,1,1,1,1,1\n")
    got = {r.product_id: r for r in read_csv(spark, path, "products").collect()}
    assert got["P1"][BAD_CELLS] == ["unit_cost", "lead_time_days"]
    assert got["P2"][BAD_CELLS] == [] and got["P2"][CORRUPT] is None
    assert got["P3"][CORRUPT] is not None


def test_dates_and_flags(spark, csv):
    path = csv("ar.csv", "invoice_id,customer_id,invoice_amount,paid_date,is_overdue\n1,C1,10.5,2024-02-29,True\n2,C1,1,2024-02-30,False\n")
    a, b = read_csv(spark, path, "ar_ledger").collect()
    assert (a.paid_date, a.is_overdue) == (date(2024, 2, 29), True)
    assert b[BAD_CELLS] == ["paid_date"] and b.is_overdue is False


def test_line_breaks_inside_quotes(spark, csv):
    path = csv("c.csv", 'customer_id,customer_name\nC1,"two\nlines"\n')
    assert read_csv(spark, path, "customers", multi_line=True).first().customer_name == "two\nlines"


def test_validate_file(spark, csv):
    path = csv("p.csv", PRODUCTS)
    ok = validate_file(spark, path, "products").first()
    assert ok.valid and ok.row_count == 2 and ok.columns_missing == [] and ok.file_size_bytes == len(PRODUCTS)
    bad = validate_file(spark, csv("s.csv", "supplier_name\nx\n"), "suppliers").first()
    assert not bad.valid and bad.columns_missing == ["supplier_id"] and bad.columns_found == ["supplier_name"]
    with pytest.raises(UnknownCategory):
        validate_file(spark, path, "sales")


@pytest.mark.parametrize(
    "category,header,missing",
    [
        ("sales", "date,sku,quantity,revenue,region", []),
        ("inventory", "sku,qty_on_hand", ["reorder_point"]),
        ("suppliers", "supplier_id,supplier_name,lead_time", []),
        ("purchase_orders", "po_id,sku,quantity", ["po_number"]),
    ],
)
def test_validate_older_layouts(spark, csv, category, header, missing):
    row = validate_file(spark, csv("old.csv", f"{header}\n{'1,' * header.count(',')}1\n"), category, legacy=True).first()
    assert row.valid is not bool(missing) and row.columns_missing == missing and row.row_count == 1
    assert row.columns_found == header.split(",")


def test_store_replaces_versions(spark, csv, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.tables().names == [] and store.upload_log() is None
    assert store.ingest_csv(csv("one.csv", PRODUCTS), "products") == 2
    first = store.tables()["products"]
    assert first.count() == 2
    store.ingest_csv(csv("two.csv", PRODUCTS + "4,P3,c,2,1,\n"), "products")
    assert store.tables()["products"].count() == 3
    # Readers that started on the old version keep it.
    assert first.count() == 2
    history = catalog.version_history(store.tables()).collect()
    assert [(r.filename, r.row_count, r.status) for r in history] == [("two.csv", 3, "uploaded"), ("one.csv", 2, "uploaded")]
    assert len({r.id for r in history}) == 2 and store.size_bytes() > 0
    assert store.status().first().size_bytes == store.size_bytes()


def test_store_rejects_whole_files(spark, csv, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.ingest_csv(csv("ok.csv", PRODUCTS), "products")
    broken = csv("bad.csv", PRODUCTS + "x,P3,c,2,1,\n")
    with pytest.raises(RejectedFile, match="1 of 3"):
        store.ingest_csv(broken, "products")
    assert store.tables()["products"].count() == 2
    assert store.ingest_csv(broken, "products", on_error="null") == 3
    assert store.tables()["products"].where("unit_price is null").count() == 1
    with pytest.raises(MissingColumns):
        store.ingest_csv(csv("few.csv", "product_id\nP1\n"), "products")
    with pytest.raises(UnknownCategory):
        store.ingest_csv(broken, "sales")


def test_snapshots_are_partitioned_and_kpis_recorded(spark, make, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    days = [date(2024, 1, d) for d in (1, 2)]
    t = make(
        inventory_snapshot=[dict(product_id=f"P{i}", qty_on_hand=i, snapshot_date=d, inventory_value=10) for i in range(4) for d in days],
        sales_transactions=[dict(transaction_date=days[0], product_id="P1", qty_sold=1, total_revenue=20, total_cost=8)],
    )
    for name in t.names:
        store.replace(t[name], name)
    stored = store.tables()
    assert stored["inventory_snapshot"].count() == 8
    folders = {p.name for p in (tmp_path / "store" / "inventory_snapshot").glob("version=*/*") if p.is_dir()}
    assert folders == {"snapshot_date=2024-01-01", "snapshot_date=2024-01-02"}
    assert overview.kpi_summary(stored).first().dio == 5.0
    store.append_kpi("2024-01-03")
    store.append_kpi("2024-01-04")
    assert {(r.date.day, r.dio, r.inventory_turnover) for r in store.kpi_history().collect()} == {(3, 5.0, 0.5), (4, 5.0, 0.5)}
    with pytest.raises(ValueError):
        store.reset()
    store.reset(confirm=True)
    assert store.tables().names == [] and store.kpi_history() is None


def test_store_file_and_json(spark, csv, tmp_path):
    kept = store_file(spark, csv("p.csv", PRODUCTS), "products", str(tmp_path / "kept"))
    assert kept.split("/")[-1].startswith("products_") and spark.read.parquet(kept).count() == 2
    broken = csv("bad.csv", PRODUCTS + "x,P3,c,2,1,\n")
    with pytest.raises(RejectedFile, match="1 rows"):
        store_file(spark, broken, "products", str(tmp_path / "kept"))
    assert spark.read.parquet(store_file(spark, broken, "products", str(tmp_path / "kept"), on_error="null")).count() == 3
    out = str(tmp_path / "json")
    write_json(spark.read.parquet(kept).select("product_id", "unit_cost"), out)
    assert spark.read.json(out).count() == 2
    text = "".join(p.read_text() for p in (tmp_path / "json").glob("*.json"))
    assert '"unit_cost":null' in text


def test_stored_classification(spark, make, tmp_path):
    sales = [dict(transaction_date=date(2024, 1, 1), product_id=f"P{i}", qty_sold=i, total_revenue=i) for i in range(1, 5)]
    path = str(tmp_path / "classes")
    inventory.abc_xyz_classification(make(sales_transactions=sales)).write.parquet(path)
    top = inventory.abc_xyz_lookup(spark.read.parquet(path), limit=2).collect()
    assert [(r.product_id, r.revenue_pct, r.abc) for r in top] == [("P4", 40.0, "A"), ("P3", 30.0, "A")]


def test_catalog_tables(spark, make):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    create_tables(spark, "shop")
    assert len(table_ddl("shop")) == 11 and len(table_ddl(legacy=True)) == 6
    assert len(Tables.from_catalog(spark, "shop").names) == 9
    save_table(make(suppliers=[dict(supplier_id="S1", supplier_name="x")])["suppliers"], "suppliers", "shop")
    save_table(make(suppliers=[dict(supplier_id="S2", supplier_name="y")])["suppliers"], "suppliers", "shop")
    assert [r.supplier_id for r in Tables.from_catalog(spark, "shop")["suppliers"].collect()] == ["S2"]
    with pytest.raises(ValueError):
        drop_tables(spark, "shop")
    assert len(drop_tables(spark, "shop", confirm=True)) == 11
    assert Tables.from_catalog(spark, "shop").names == []
    spark.sql("DROP DATABASE shop")


def test_unknown_tables_are_refused(spark):
    with pytest.raises(ValueError):
        Tables(spark, {"sales": spark.range(1)})
