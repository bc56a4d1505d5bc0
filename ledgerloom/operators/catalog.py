"""What is loaded, in which shape, and since when."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.schema import GRAPH, LEGACY_EXAMPLES, LEGACY_TABLES, TABLES, TABLE_NAMES, UPLOAD_LOG_COLUMNS
from ledgerloom.sources.graph import described_suppliers, supply_edges
from ledgerloom.tables import MissingTable, Tables


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def _absent(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.lit(None).cast("bigint").alias("rows"))


def list_uploads(t: Tables) -> DataFrame:
    """The nine categories with their row counts (parquet answers those from its footers)."""
    return _union(
        [
            (_count(t[name]) if t.has(name) else _absent(t)).select(
                F.lit(name).alias("category"),
                F.lit("uploaded" if t.has(name) else "not_uploaded").alias("status"),
                "rows",
                F.lit(TABLES[name].destination if t.has(name) else None).cast("string").alias("destination"),
            )
            for name in TABLE_NAMES
        ]
    )


def schema_info(t: Tables, table: str = "sales_transactions") -> DataFrame:
    """Name and type of each column, next to the table's row count."""
    df = t[table]
    items = F.array(
        *(F.struct(F.lit(c).alias("column_name"), F.lit(type_).alias("column_type")) for c, type_ in df.dtypes)
    )
    return _count(df).select("rows", F.inline(items)).select("column_name", "column_type", "rows")


def schema_info_sample(t: Tables, table: str = "sales_transactions", rows: int = 5) -> DataFrame:
    return t[table].limit(rows)


def version_history(t: Tables) -> DataFrame:
    """The upload log, newest first; without one, the loaded tables and their sizes."""
    if t.upload_log is not None:
        return t.upload_log.select(*UPLOAD_LOG_COLUMNS).orderBy(F.col("upload_timestamp").desc(), F.col("id").desc())
    if not t.names:
        raise MissingTable("no table is loaded")
    return _union(
        [
            _count(t[name]).select(
                F.lit(None).cast("bigint").alias("id"),
                F.lit(name).alias("file_category"),
                F.lit(None).cast("string").alias("filename"),
                F.lit(None).cast("timestamp").alias("upload_timestamp"),
                F.col("rows").alias("row_count"),
                F.lit("uploaded").alias("status"),
            )
            for name in t.names
        ]
    )


def versions_as_of(t: Tables, as_of: datetime | int | None = None, path: bool = False) -> DataFrame:
    """The upload of each category that was the newest at ``as_of``, a time or the id of an upload; now without it."""
    if t.upload_log is None:
        raise MissingTable("there is no upload log")
    log = t.upload_log
    if as_of is not None:
        log = log.where(F.col("id") <= as_of) if isinstance(as_of, int) else log.where(F.col("upload_timestamp") <= F.lit(as_of))
    shown = ["id", "filename", "upload_timestamp", "row_count", *(["storage_path"] if path else [])]
    newest = log.groupBy("file_category").agg(F.max_by(F.struct(*shown), "id").alias("newest"))
    return newest.select("file_category", "newest.*").orderBy("file_category")


def _graph_sizes(t: Tables) -> DataFrame:
    """(object, status, rows) of the supplier graph. The orders are read once: both kinds of nodes come from the edges."""
    ordered = t.has("purchase_orders")
    loaded = {"suppliers": ordered or t.has("suppliers"), "products": ordered, "relationships": ordered}
    found = t.spark.range(0).selectExpr("'' AS object", "'' AS id", "id AS edges")
    if ordered:
        # One row per end of an edge; all edges of a task add up to one row without an id.
        ends = F.array(
            F.struct(F.lit("suppliers").alias("object"), F.col("supplier_id").alias("id"), F.lit(0).cast("bigint").alias("edges")),
            F.struct(F.lit("products").alias("object"), F.col("product_id").alias("id"), F.lit(0).cast("bigint").alias("edges")),
            F.struct(F.lit("relationships").alias("object"), F.lit(None).cast("string").alias("id"), F.lit(1).cast("bigint").alias("edges")),
        )
        found = found.unionByName(supply_edges(t).select(F.inline(ends)))
    if t.has("suppliers"):
        found = found.unionByName(described_suppliers(t).selectExpr("'suppliers' AS object", "supplier_id AS id", "0L AS edges"))
    found = found.groupBy("object", "id").agg(F.sum("edges").alias("edges"))
    sizes = {
        "suppliers": F.count_if(F.col("object") == "suppliers"),
        "products": F.count_if(F.col("object") == "products"),
        "relationships": F.coalesce(F.sum("edges"), F.lit(0).cast("bigint")),
    }
    lines = F.array(
        *(
            F.struct(
                F.lit(name).alias("object"),
                F.lit("ok" if loaded[name] else "not_loaded").alias("status"),
                (F.col(name) if loaded[name] else F.lit(None).cast("bigint")).alias("rows"),
            )
            for name in sizes
        )
    )
    return found.agg(*(size.alias(name) for name, size in sizes.items())).select(F.inline(lines))


def database_state(t: Tables) -> DataFrame:
    """Rows and columns of each table, and the sizes of the supplier graph."""

    def line(store: str, name: str, df: DataFrame | None, columns: int | None) -> DataFrame:
        return (_absent(t) if df is None else _count(df)).select(
            F.lit(store).alias("store"),
            F.lit(name).alias("object"),
            F.lit("not_loaded" if df is None else "ok").alias("status"),
            "rows",
            F.lit(columns).cast("int").alias("columns"),
        )

    tables = [
        line("table", n, t[n], len(t[n].columns)) if t.has(n) else line("table", n, None, None) for n in TABLE_NAMES
    ]
    graph = _graph_sizes(t).select(F.lit("graph").alias("store"), "object", "status", "rows", F.lit(None).cast("int").alias("columns"))
    return _union([*tables, graph])


def database_status(t: Tables, size_bytes: int | None = None) -> DataFrame:
    """Totals over everything that is loaded: tables, rows, graph nodes and relationships, and its size where given."""
    state = database_state(t).where(F.col("status") == "ok")
    table = F.col("store") == "table"
    edge = F.col("object") == "relationships"

    def rows(hit: Column) -> Column:
        return F.coalesce(F.sum(F.when(hit, F.col("rows"))), F.lit(0))

    return state.agg(
        F.count_if(table).alias("tables"),
        rows(table).alias("total_rows"),
        rows(~table & ~edge).alias("nodes"),
        rows(~table & edge).alias("relationships"),
        *([] if size_bytes is None else [F.lit(size_bytes).cast("bigint").alias("size_bytes")]),
    )


def schema_listing(t: Tables) -> DataFrame:
    """Names of the nine tables and of the graph's parts."""
    rows = [("table", name) for name in TABLE_NAMES]
    rows += [("graph", GRAPH["name"])]
    rows += [("node", name) for name in GRAPH["nodes"]] + [("relationship", name) for name in GRAPH["relationships"]]
    return t.spark.createDataFrame(rows, "kind string, name string")


def templates(t: Tables, category: str | None = None, legacy: bool = False) -> DataFrame:
    """Columns a file of a category must or may have, in header order."""
    registry = LEGACY_TABLES if legacy else TABLES
    chosen = registry.values() if category is None else [registry[c] for c in (category,) if c in registry]
    rows = [
        (
            spec.name,
            position,
            field.name,
            field.dataType.simpleString(),
            field.name in spec.required_columns,
            LEGACY_EXAMPLES.get(spec.name, {}).get(field.name) if legacy else None,
        )
        for spec in chosen
        for position, field in enumerate(spec.schema, start=1)
    ]
    return t.spark.createDataFrame(
        rows, "category string, position int, column_name string, column_type string, required boolean, example string"
    )
