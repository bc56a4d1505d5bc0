"""The registered queries once more, as plain SQL for a second engine.

Each text starts from the same files: the nine tables it mentions are put in
front of it as common table expressions.
"""

from __future__ import annotations

import re

from ledgerloom.schema import TABLES, TABLE_NAMES
from ledgerloom.sources.derived import COLUMNS, LOCATIONS, SNAPSHOTS, STOCK_QTY

_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_PURCHASES = _LINES
_CELLS = ", ".join(f"({loc}, {k}, DATE '{day}')" for loc in LOCATIONS for k, day in enumerate(SNAPSHOTS))

_FROM = {
    "products": "part",
    "customers": "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "suppliers": "supplier JOIN nation ON s_nationkey = n_nationkey",
    "sales_transactions": f"{_LINES} JOIN part ON l_partkey = p_partkey",
    "inventory_snapshot": f"(SELECT *, {STOCK_QTY} AS q FROM part CROSS JOIN (VALUES {_CELLS}) c(loc, k, snapshot_date))",
    "purchase_orders": _PURCHASES,
    "ar_ledger": "orders",
    "ap_ledger": _PURCHASES,
    "shipments": _PURCHASES,
}

# Shorter names for subsets many texts start from.
_PARTS = {
    "latest": "SELECT * FROM inventory_snapshot WHERE snapshot_date = (SELECT max(snapshot_date) FROM inventory_snapshot)",
    "edges": "SELECT DISTINCT supplier_id, product_id FROM purchase_orders WHERE supplier_id <> '' AND product_id <> ''",
    "vertices": """
        SELECT supplier_id, supplier_name, coalesce(avg_lead_time_days, 0) AS lead_time,
               coalesce(risk_score, 0) AS rating, coalesce(on_time_delivery_rate, 0) AS otd_rate,
               coalesce(country, '') AS country
        FROM suppliers
        UNION ALL
        SELECT DISTINCT supplier_id, NULL, NULL, NULL, NULL, NULL FROM purchase_orders
        WHERE supplier_id NOT IN (SELECT supplier_id FROM suppliers)""",
    "per_product": """
        SELECT product_id, sum(total_revenue) AS rev, stddev_samp(qty_sold) AS sd, avg(qty_sold) AS mean
        FROM sales_transactions GROUP BY product_id""",
    "classes": """
        SELECT product_id, rev, CAST(rev AS DOUBLE) / CAST(sum(rev) OVER () AS DOUBLE) * 100 AS pct,
               CAST(sum(rev) OVER (ORDER BY rev DESC) AS DOUBLE) / CAST(sum(rev) OVER () AS DOUBLE) * 100 AS cum,
               CASE WHEN mean > 0 THEN sd / mean ELSE 0 END AS cv
        FROM per_product""",
    "stock": """
        SELECT product_id, sum(qty_on_hand) AS qty, sum(inventory_value) AS v, max(days_since_last_movement) AS days_idle
        FROM latest GROUP BY product_id""",
    "sold": "SELECT product_id, sum(total_revenue) AS v FROM sales_transactions GROUP BY product_id",
    "paid": "SELECT * FROM ar_ledger WHERE days_to_pay IS NOT NULL",
}
_NEEDS = {
    "latest": ["inventory_snapshot"],
    "edges": ["purchase_orders"],
    "vertices": ["suppliers", "purchase_orders"],
    "per_product": ["sales_transactions"],
    "classes": ["per_product"],
    "stock": ["latest"],
    "sold": ["sales_transactions"],
    "paid": ["ar_ledger"],
}


def _definition(name: str) -> str:
    if name in _PARTS:
        return _PARTS[name]
    columns = ", ".join(f"{expr} AS {column}" for column, expr in COLUMNS[name])
    return f"SELECT {columns} FROM {_FROM[name]}"


def _complete(sql: str) -> str:
    names: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, []):
            add(other)
        if name not in names:
            names.append(name)

    for name in (*TABLE_NAMES, *_PARTS):
        if re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
            add(name)
    ctes = ",\n".join(f"{n} AS ({_definition(n)})" for n in names)
    body = sql.strip()
    if not names:
        return body
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def _double(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def _long(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def _weighted(days: str) -> str:
    return f"{_double(f'sum({days} * invoice_amount)')} / nullif({_double('sum(invoice_amount)')}, 0)"


def _level(x: str, high: int, medium: int) -> str:
    return f"CASE WHEN {x} > {high} THEN 'high' WHEN {x} > {medium} THEN 'medium' ELSE 'low' END"


_RUNNING = "CAST(sum(v) OVER (ORDER BY v DESC) AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE) * 100"
_AGE = (
    "CASE WHEN days_idle <= 30 THEN '0-30d' WHEN days_idle <= 60 THEN '31-60d' "
    "WHEN days_idle <= 90 THEN '61-90d' ELSE '90+d' END"
)
_URGENCY = "CASE WHEN stock_status = 'stockout' THEN 1 WHEN stock_status = 'low_stock' THEN 2 ELSE 3 END"
_ABC = "CASE WHEN cum <= 80 THEN 'A' WHEN cum <= 95 THEN 'B' ELSE 'C' END"
_XYZ = "CASE WHEN cv < 0.5 THEN 'X' WHEN cv < 1.0 THEN 'Y' ELSE 'Z' END"
_DAILY_REVENUE = (
    "(SELECT CAST(sum(total_revenue) AS DOUBLE) / count(DISTINCT transaction_date) * 365 AS per_year "
    "FROM sales_transactions)"
)


def _scenarios(scenarios: list[tuple]) -> str:
    rows = ", ".join(
        f"('{s}', {a}, {b}, {c}, {'CAST(NULL AS DOUBLE)' if r is None else float(r)})" for s, a, b, c, r in scenarios
    )
    return f"""
        grid AS (SELECT * FROM (VALUES {rows}) g(scenario_id, a, b, c, given)),
        priced AS (SELECT *, coalesce(given, per_year) AS annual FROM grid CROSS JOIN {_DAILY_REVENUE})"""


def _dead(as_of: str) -> str:
    return f"""
        aged AS (
            SELECT DISTINCT product_id, location_id, qty_on_hand, {_double('unit_cost')} AS unit_cost,
                   {_double('qty_on_hand * unit_cost')} AS value_at_risk, last_sale_date,
                   CAST(DATE '{as_of}' - last_sale_date AS INTEGER) AS days_since_sale
            FROM latest LEFT JOIN (SELECT product_id, max(transaction_date) AS last_sale_date
                                   FROM sales_transactions GROUP BY product_id) s USING (product_id)
            WHERE last_sale_date IS NULL OR DATE '{as_of}' - last_sale_date > 90)"""


def _trend(period: str) -> str:
    return f"""
        WITH p AS (
            SELECT {period} AS period, {_double('sum(total_revenue)')} AS revenue, {_long('sum(qty_sold)')} AS units,
                   count(DISTINCT product_id) AS skus
            FROM sales_transactions GROUP BY 1),
        q AS (SELECT *, lag(revenue) OVER (ORDER BY period) AS prev FROM p)
        SELECT period, revenue, units, skus,
               CASE WHEN prev > 0 THEN CAST(printf('%.1f', (revenue - prev) / prev * 100) AS DOUBLE) WHEN prev IS NOT NULL THEN 0 END
                   AS growth_pct
        FROM q"""


def _quality() -> str:
    parts = []
    for name in TABLE_NAMES:
        columns = [c for c, _ in COLUMNS[name]]
        holes = " + ".join(f"CAST(count(*) > count({c}) AS INTEGER)" for c in columns)
        parts.append(
            f"SELECT '{name}' AS table_name, count(*) AS rows, {len(columns)} AS columns, {holes} AS columns_with_nulls, "
            f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {name})) AS duplicate_rows FROM {name}"
        )
    return f"""
        SELECT table_name, rows, CAST(columns AS INTEGER) AS columns, CAST(columns_with_nulls AS INTEGER) AS columns_with_nulls,
               duplicate_rows,
               CAST(greatest(0, 100 - 5 * columns_with_nulls - 2 * least(duplicate_rows, 10)) AS BIGINT) AS quality_score
        FROM ({' UNION ALL '.join(parts)})"""


def _null_counts() -> str:
    parts = [
        f"SELECT '{name}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS null_count FROM {name}"
        for name in TABLE_NAMES
        for c, _ in COLUMNS[name]
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE null_count > 0"


def _counts(line: str) -> str:
    return " UNION ALL ".join(
        line.format(name=n, destination=TABLES[n].destination, columns=len(COLUMNS[n])) for n in TABLE_NAMES
    )


def _alternatives(candidates: str, extra: str, order: str) -> str:
    """All pairs: only for the small data the check runs on."""
    return f"""
        WITH pairs AS ({candidates}),
        free AS (SELECT * FROM pairs ANTI JOIN edges USING (product_id, supplier_id)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {order}) AS place FROM free)
        SELECT product_id, supplier_id, supplier_name, lead_time, rating{extra} FROM ranked WHERE place <= 5"""


def _asof(comparison: str) -> str:
    return f"""
        WITH known AS (SELECT product_id, snapshot_date, {_long('sum(qty_on_hand)')} AS qty_on_hand
                       FROM inventory_snapshot GROUP BY product_id, snapshot_date)
        SELECT transaction_id, s.product_id, transaction_date, qty_sold, snapshot_date, qty_on_hand
        FROM sales_transactions s ASOF LEFT JOIN known k
             ON s.product_id = k.product_id AND transaction_date {comparison} snapshot_date"""


def _ntile(tiles: int) -> str:
    return f"""
        WITH g AS (SELECT customer_id, sum(total_revenue) AS v FROM sales_transactions WHERE customer_id IS NOT NULL GROUP BY customer_id)
        SELECT customer_id, {_double('v')} AS revenue, row_number() OVER (ORDER BY v DESC, customer_id) AS position,
               CAST(ntile({tiles}) OVER (ORDER BY v DESC, customer_id) AS INTEGER) AS decile FROM g"""


def _quantiles(source: str, group: str, value: str, shown: str, members: str) -> str:
    keys, by = (f"{group}, ", f" GROUP BY {group}") if group else ("", "")
    parts = [
        f"SELECT {keys}CAST({share} AS DOUBLE) AS share, {shown.format(f'quantile_disc({value}, {share})')}, count({value}) AS {members} "
        f"FROM {source} WHERE {value} IS NOT NULL{by}"
        for share in (0.5, 0.9, 0.99)
    ]
    return " UNION ALL ".join(parts)


def _history_texts() -> dict[str, str]:
    """As-of and interval joins, neighbours, tiles, quantiles, levels and merged states."""
    spells = "SELECT * FROM ar_ledger WHERE paid_date IS NULL OR paid_date > invoice_date"
    exposure = f"""
        WITH owed AS (
            SELECT a.invoice_id, coalesce(sum(b.invoice_amount), 0) AS v, count(b.invoice_id) AS n
            FROM ar_ledger a LEFT JOIN ar_ledger b
                 ON a.customer_id = b.customer_id AND (b.paid_date IS NULL OR b.paid_date > a.invoice_date)
                    AND (b.invoice_date < a.invoice_date OR (b.invoice_date = a.invoice_date AND b.invoice_id < a.invoice_id))
            GROUP BY a.invoice_id)
        SELECT invoice_id, customer_id, invoice_date, {_double('invoice_amount')} AS invoice_amount, {_double('v')} AS open_amount,
               n AS open_invoices, v + invoice_amount > credit_limit AS over_limit
        FROM ar_ledger JOIN owed USING (invoice_id) LEFT JOIN customers USING (customer_id)"""
    levels = f"""
        SELECT category, location_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month,
               CAST(grouping(category, location_id, CAST(date_trunc('month', transaction_date) AS DATE)) AS INTEGER) AS level,
               {_double('sum(total_revenue)')} AS revenue, {_long('sum(qty_sold)')} AS units, count(DISTINCT customer_id) AS customers
        FROM sales_transactions LEFT JOIN products USING (product_id)
        GROUP BY {{}} (category, location_id, CAST(date_trunc('month', transaction_date) AS DATE))"""
    reach = f"""
        SELECT product_id, {_double('sum(total_revenue)')} AS revenue, {_long('sum(qty_sold)')} AS units, count(DISTINCT customer_id) AS customers
        FROM sales_transactions WHERE {{}} GROUP BY product_id"""
    paths = """
        WITH RECURSIVE bom AS (
            SELECT p_partkey AS c, p_partkey // 4 + 1 AS f, 1 + p_partkey % 3 AS n FROM part
            UNION ALL SELECT p_partkey, p_partkey // 6 + 1, 1 FROM part WHERE p_partkey % 2 = 0),
        uses AS (SELECT c, f, sum(n) AS n FROM bom WHERE c <> f GROUP BY c, f),
        up AS (SELECT c, f, CAST(n AS BIGINT) AS n, 1 AS level FROM uses
               UNION ALL SELECT up.c, uses.f, CAST(up.n * uses.n AS BIGINT), level + 1 FROM up JOIN uses ON up.f = uses.c)"""
    order_columns = [c for c, _ in COLUMNS["purchase_orders"]]
    late = "actual_delivery_date > DATE '2001-03-31'"
    earlier = ", ".join(
        {
            "actual_delivery_date": f"CASE WHEN {late} THEN NULL ELSE actual_delivery_date END AS actual_delivery_date",
            "delay_days": f"CASE WHEN {late} THEN NULL ELSE delay_days END AS delay_days",
            "po_status": f"CASE WHEN {late} THEN 'open' ELSE po_status END AS po_status",
        }.get(c, c)
        for c in order_columns
    )
    log = """
        WITH files AS (
            SELECT 'ar_ledger' AS file_category, date_trunc('month', o_orderdate) AS d, INTERVAL 1 MONTH AS after, count(*) AS row_count, 9 AS code
            FROM orders GROUP BY 2
            UNION ALL SELECT 'purchase_orders', date_trunc('year', o_orderdate), INTERVAL 12 MONTH, count(*), 5 FROM orders GROUP BY 2),
        log AS (SELECT CAST(strftime(d, '%Y%m') AS BIGINT) * 10 + code AS id, file_category, file_category || '-' || strftime(d, '%Y-%m') || '.csv' AS filename,
                       CAST(d + after AS TIMESTAMP) AS upload_timestamp, row_count, 'uploaded' AS status FROM files)"""
    return {
        "part_uses": f"""{paths}
            SELECT 'P' || CAST(c AS STRING) AS component_id, 'P' || CAST(f AS STRING) AS finished_id, CAST(sum(n) AS DOUBLE) AS quantity,
                   count(*) AS paths, min(level) AS first_level, max(level) AS last_level FROM up GROUP BY c, f""",
        "ripple_all_levels": f"""{paths},
            touched AS (SELECT supplier_id, product_id, 1 AS own FROM edges
                        UNION ALL SELECT supplier_id, 'P' || CAST(f AS STRING), 0 FROM edges JOIN (SELECT DISTINCT c, f FROM up) a ON product_id = 'P' || CAST(c AS STRING)),
            once AS (SELECT supplier_id, product_id, max(own) AS own FROM touched GROUP BY supplier_id, product_id)
            SELECT supplier_id, CAST(sum(own) AS BIGINT) AS supplied, count(*) AS impacted, CAST(coalesce(sum(v), 0) AS DOUBLE) AS revenue_at_risk
            FROM once LEFT JOIN sold USING (product_id) GROUP BY supplier_id""",
        "purchase_order_changes": f"""
            WITH earlier AS (SELECT {earlier} FROM purchase_orders WHERE po_date <= DATE '2001-03-31'),
            added AS (SELECT {', '.join(order_columns)} FROM purchase_orders EXCEPT ALL SELECT * FROM earlier),
            removed AS (SELECT * FROM earlier EXCEPT ALL SELECT {', '.join(order_columns)} FROM purchase_orders)
            SELECT *, 'added' AS change, count(*) AS copies FROM added GROUP BY ALL
            UNION ALL SELECT *, 'removed', count(*) FROM removed GROUP BY ALL""",
        "version_history_logged": f"{log} SELECT * FROM log",
        "versions_as_of": f"""{log}
            SELECT file_category, arg_max(id, id) AS id, arg_max(filename, id) AS filename, arg_max(upload_timestamp, id) AS upload_timestamp,
                   arg_max(row_count, id) AS row_count FROM log WHERE upload_timestamp <= TIMESTAMP '1998-07-15' GROUP BY file_category""",
        "stock_at_sale": _asof(">="),
        "stock_before_sale": _asof(">"),
        "receipt_before_sale": f"""
            WITH known AS (SELECT product_id, actual_delivery_date AS received_date, {_long('sum(qty_ordered)')} AS received_qty, sum(total_po_value) AS v
                           FROM purchase_orders WHERE actual_delivery_date IS NOT NULL GROUP BY product_id, actual_delivery_date)
            SELECT transaction_id, s.product_id, transaction_date, qty_sold, received_date, received_qty,
                   round({_double('v')} / nullif({_double('received_qty')}, 0), 4) AS unit_cost
            FROM sales_transactions s ASOF LEFT JOIN known k ON s.product_id = k.product_id AND transaction_date > received_date""",
        "open_receivables_daily": f"""
            WITH spells AS ({spells}),
            days AS (SELECT CAST(unnest(generate_series(min(a), max(b), INTERVAL 1 DAY)) AS DATE) AS day
                     FROM (SELECT invoice_date AS a, coalesce(paid_date, invoice_date) AS b FROM spells))
            SELECT day, count(*) FILTER (invoice_date = day) AS opened, count(*) FILTER (paid_date = day) AS closed,
                   count(*) FILTER (invoice_date <= day AND (paid_date IS NULL OR paid_date > day)) AS open_invoices,
                   {_double('coalesce(sum(invoice_amount) FILTER (invoice_date <= day AND (paid_date IS NULL OR paid_date > day)), 0)')} AS open_amount
            FROM days LEFT JOIN spells ON invoice_date <= day AND (paid_date IS NULL OR paid_date >= day) GROUP BY day""",
        "credit_exposure": exposure,
        "credit_exposure_over_limit": f"SELECT * FROM ({exposure}) WHERE over_limit",
        "order_gaps": """
            SELECT invoice_id, customer_id, invoice_date, CAST(invoice_date - lag(invoice_date) OVER w AS INTEGER) AS days_since_previous,
                   CAST(lead(invoice_date) OVER w - invoice_date AS INTEGER) AS days_to_next
            FROM ar_ledger WINDOW w AS (PARTITION BY customer_id ORDER BY invoice_date, invoice_id)""",
        "moving_revenue": f"""
            WITH d AS (SELECT product_id, transaction_date, sum(total_revenue) AS v FROM sales_transactions GROUP BY product_id, transaction_date)
            SELECT product_id, transaction_date, {_double('v')} AS revenue, {_double('sum(v) OVER w')} AS moving_revenue, CAST(count(*) OVER w AS INTEGER) AS days
            FROM d WINDOW w AS (PARTITION BY product_id ORDER BY transaction_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
        "customer_deciles": _ntile(10),
        "customer_quartiles": _ntile(4),
        "customer_deciles_summary": f"""
            SELECT decile, count(*) AS customers, {_double('sum(CAST(revenue AS DECIMAL(28,4)))')} AS revenue,
                   CAST(printf('%.2f', {_double('sum(CAST(revenue AS DECIMAL(28,4)))')} / {_double('sum(sum(CAST(revenue AS DECIMAL(28,4)))) OVER ()')} * 100) AS DOUBLE) AS revenue_pct
            FROM ({_ntile(10)}) GROUP BY decile""",
        "payment_quantiles": _quantiles("ar_ledger LEFT JOIN customers USING (customer_id)", "segment", "days_to_pay", "{} AS days_to_pay", "invoices"),
        "payment_quantiles_overall": _quantiles("ar_ledger", "", "days_to_pay", "{} AS days_to_pay", "invoices"),
        "sale_value_quantiles": _quantiles("sales_transactions", "location_id", "total_revenue", "CAST({} AS DOUBLE) AS revenue", "sales"),
        "revenue_cube": levels.format("CUBE"),
        "revenue_rollup": levels.format("ROLLUP"),
        "revenue_trends_sketched": f"""
            SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS period, {_double('sum(total_revenue)')} AS revenue,
                   {_long('sum(qty_sold)')} AS units, count(DISTINCT product_id) AS products, count(DISTINCT customer_id) AS customers
            FROM sales_transactions GROUP BY 1""",
        "customer_reach": reach.format("true"),
        "customer_reach_1998": reach.format("transaction_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"),
    }


def oracle_queries(scenarios: list[tuple], as_of: str, free_sql: str, long_sql: str, sales_types: list[tuple[str, str]]) -> dict[str, str]:
    latest_value = "(SELECT CAST(sum(inventory_value) AS DOUBLE) FROM latest)"
    kpi = f"""
        WITH n AS (
            SELECT CAST(printf('%.1f', {latest_value}
                       / ((SELECT CAST(sum(total_cost) AS DOUBLE) / count(DISTINCT transaction_date) FROM sales_transactions))) AS DOUBLE) AS dio,
                   CAST(printf('%.1f', (SELECT {_weighted('days_to_pay')} FROM paid)) AS DOUBLE) AS dso,
                   CAST(printf('%.1f', (SELECT {_weighted('actual_days_to_pay')} FROM ap_ledger WHERE actual_days_to_pay IS NOT NULL)) AS DOUBLE) AS dpo)"""
    top_customers = """
        WITH g AS (SELECT customer_id, sum(total_revenue) AS rev, count(DISTINCT product_id) AS unique_products
                   FROM sales_transactions GROUP BY customer_id),
        s AS (SELECT *, CAST(rev AS DOUBLE) / CAST(sum(rev) OVER () AS DOUBLE) * 100 AS revenue_pct FROM g),
        top AS (SELECT * FROM s ORDER BY rev DESC, customer_id LIMIT 10)"""
    spend = """
        WITH g AS (SELECT supplier_id, count(*) AS orders, sum(total_po_value) AS v FROM purchase_orders GROUP BY supplier_id),
        s AS (SELECT *, CAST(v AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE) * 100 AS value_pct FROM g)"""
    months = f"""
        WITH m AS (SELECT CAST(extract(month FROM transaction_date) AS INTEGER) AS month, {_long('sum(qty_sold)')} AS qty,
                          {_double('sum(total_revenue)')} AS revenue
                   FROM sales_transactions GROUP BY 1)"""
    def scored(x: str) -> str:
        return f"""
        WITH s AS (SELECT *, ({x} - avg({x}) OVER ()) / nullif(stddev_samp({x}) OVER (), 0) AS z FROM sales_transactions)"""

    def anomalies(x: str, bound: float = 2) -> str:
        return f"{scored(x)} SELECT * EXCLUDE (z), round(z, 6) AS z_score FROM s WHERE abs(z) > {bound}"

    def anomaly_count(x: str, bound: float = 2) -> str:
        return f"""{scored(x)}
            SELECT count(*) AS total_rows, count(*) FILTER (abs(z) > {bound}) AS anomalies_found FROM s"""

    single = """
        WITH one AS (SELECT product_id, min(supplier_id) AS supplier_id FROM edges GROUP BY product_id HAVING count(*) = 1)"""
    bom = """
        bom AS (SELECT DISTINCT 'P' || CAST(p_partkey AS STRING) AS component_id,
                       'P' || CAST(p_partkey // 4 + 1 AS STRING) AS finished_id FROM part),
        lines AS (SELECT * FROM edges LEFT JOIN bom ON product_id = component_id),
        touched AS (SELECT supplier_id, product_id FROM edges
                    UNION SELECT supplier_id, finished_id FROM lines WHERE finished_id IS NOT NULL)"""
    banded = """
        SELECT product_id, location_id, qty_on_hand, reorder_point,{extra}
               CASE WHEN qty_on_hand < reorder_point THEN 'critical' ELSE 'warning' END AS status
        FROM latest WHERE qty_on_hand < {upper}"""
    type_rows = ", ".join(f"('{c}', '{t}')" for c, t in sales_types)

    texts = {
        # overview
        "full_dashboard": f"""
            SELECT * FROM
            (SELECT {_double('sum(total_revenue)')} AS total_revenue, {_double('sum(total_cost)')} AS total_cost,
                    {_double('sum(gross_profit)')} AS gross_profit, count(*) AS transactions,
                    count(DISTINCT product_id) AS unique_products FROM sales_transactions)
            CROSS JOIN
            (SELECT count(DISTINCT product_id) AS unique_skus, {_long('sum(qty_on_hand)')} AS total_units,
                    {_double('sum(inventory_value)')} AS inventory_value,
                    count(*) FILTER (stock_status = 'stockout') AS stockouts,
                    count(*) FILTER (stock_status = 'overstock') AS overstocked FROM latest)
            CROSS JOIN
            (SELECT count(*) AS supplier_count, round(avg(avg_lead_time_days), 1) AS avg_lead_time,
                    round(avg(on_time_delivery_rate), 3) AS avg_otd_rate FROM suppliers)
            CROSS JOIN
            (SELECT count(*) AS customer_count, {_double('sum(ytd_revenue)')} AS total_ytd_revenue,
                    round(avg(avg_days_to_pay), 1) AS avg_days_to_pay FROM customers)
            CROSS JOIN
            (SELECT count(*) AS ar_invoices, count(*) FILTER (is_overdue) AS ar_overdue,
                    {_double('sum(CASE WHEN write_off_flag THEN invoice_amount ELSE 0 END)')} AS write_off_amount FROM ar_ledger)
            CROSS JOIN
            (SELECT count(*) AS po_count, {_long('sum(qty_ordered)')} AS po_qty,
                    {_double('sum(total_po_value)')} AS po_value FROM purchase_orders)""",
        "kpi_summary": f"{kpi} SELECT dio, dso, dpo, CAST(printf('%.1f', dio + dso - dpo) AS DOUBLE) AS ccc FROM n",
        "kpi_record": f"""{kpi}
            SELECT DATE '{as_of}' AS date, dio, dso, dpo, CAST(printf('%.1f', dio + dso - dpo) AS DOUBLE) AS ccc,
                   round((SELECT CAST(sum(total_revenue) AS DOUBLE) FROM sales_transactions) / {latest_value}, 2)
                       AS inventory_turnover
            FROM n""",
        "kpi_simple": f"""
            WITH n AS (SELECT CAST(printf('%.1f', (SELECT {_double('sum(qty_on_hand * unit_cost)')} FROM latest)
                / (SELECT {_double('sum(total_revenue)')} / count(DISTINCT transaction_date) FROM sales_transactions)) AS DOUBLE) AS dio)
            SELECT dio, 30.0::DOUBLE AS dso, 0.0::DOUBLE AS dpo, CAST(printf('%.1f', dio + 30.0::DOUBLE) AS DOUBLE) AS ccc FROM n""",
        "data_quality_report": _quality(),
        "null_counts": _null_counts(),
        "check_quality": """
            WITH d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM purchase_orders)),
            c AS (SELECT count(*) AS total_rows, 2 * count(*) - count(actual_delivery_date) - count(delay_days) AS missing_values,
                         count(*) FILTER (delay_days < 0) AS negative_values FROM purchase_orders)
            SELECT CAST(100 - CASE WHEN total_rows > n THEN 5 ELSE 0 END - CASE WHEN missing_values > 0 THEN 5 ELSE 0 END
                       - CASE WHEN negative_values > 0 THEN 10 ELSE 0 END AS INTEGER) AS quality_score,
                   total_rows - n AS duplicates, missing_values, negative_values, total_rows, CAST(10 AS INTEGER) AS columns
            FROM c CROSS JOIN d""",
        # inventory
        "reorder_alerts": """
            SELECT product_id, location_id, qty_on_hand, reorder_point, safety_stock_target, stock_status, days_of_supply
            FROM latest WHERE qty_on_hand < reorder_point""",
        "reorder_alerts_summary": "SELECT count(*) AS total_alerts FROM latest WHERE qty_on_hand < reorder_point",
        "smart_reorder": f"""
            SELECT i.product_id, i.qty_on_hand, i.reorder_point, i.days_of_supply,
                   coalesce(p.economic_order_qty, 100) AS eoq, coalesce(p.lead_time_days, 14) AS lead_time,
                   i.stock_status, CAST({_URGENCY} AS INTEGER) AS priority
            FROM latest i LEFT JOIN products p ON i.product_id = p.product_id
            WHERE i.qty_on_hand < i.reorder_point
            ORDER BY priority, i.days_of_supply, i.product_id, i.location_id LIMIT 20""",
        "safety_stock": """
            WITH s AS (SELECT product_id, stddev_samp(qty_sold) AS sd FROM sales_transactions GROUP BY product_id),
            x AS (SELECT product_id, coalesce(nullif(sd, 0), 50.0) AS sigma,
                         coalesce(nullif(lead_time_days, 0), 14) AS lead_time
                  FROM products FULL JOIN s USING (product_id))
            SELECT product_id, CAST(CAST(printf('%.0f', 1.65::DOUBLE * sigma * sqrt(lead_time)) AS DOUBLE) AS BIGINT) AS safety_stock,
                   CAST(printf('%.2f', sigma) AS DOUBLE) AS demand_std, lead_time, 1.65::DOUBLE AS z_score FROM x""",
        "eoq": """
            WITH s AS (SELECT product_id, sum(qty_sold) AS q, count(DISTINCT transaction_date) AS days
                       FROM sales_transactions GROUP BY product_id),
            x AS (SELECT product_id, CAST(coalesce(q, 0) AS DOUBLE) / greatest(coalesce(days, 1), 1) * 365 AS annual,
                         coalesce(nullif(CAST(unit_cost AS DOUBLE), 0), 10.0) AS unit_cost
                  FROM products FULL JOIN s USING (product_id)),
            y AS (SELECT *, CAST(CAST(printf('%.0f', sqrt(2 * annual * 50 / (unit_cost * 0.25::DOUBLE))) AS DOUBLE) AS BIGINT) AS eoq FROM x)
            SELECT product_id, eoq, CAST(CAST(printf('%.0f', annual) AS DOUBLE) AS BIGINT) AS annual_demand, unit_cost,
                   CASE WHEN eoq > 0 THEN CAST(printf('%.1f', annual / eoq) AS DOUBLE) ELSE 0 END AS orders_per_year FROM y""",
        "inventory_turnover": f"""
            WITH i AS (SELECT product_id, sum(qty_on_hand) AS qty, avg(CAST(unit_cost AS DOUBLE)) AS unit_cost,
                              {_double('sum(unit_cost)')} / count(unit_cost) AS mean_cost, {_double('sum(inventory_value)')} AS v
                       FROM latest GROUP BY product_id),
            s AS (SELECT product_id, sum(qty_sold) AS q, {_double('sum(total_revenue)')} AS r FROM sales_transactions GROUP BY product_id)
            SELECT i.product_id, {_long('qty')} AS qty_on_hand, mean_cost AS unit_cost, v AS inventory_value,
                   {_long('coalesce(q, 0)')} AS total_sold, coalesce(r, 0) AS revenue,
                   CASE WHEN v > 0 THEN round(coalesce(r, 0) / v, 2) ELSE 0 END AS turnover_ratio
            FROM i LEFT JOIN s ON i.product_id = s.product_id
            ORDER BY turnover_ratio DESC, i.product_id LIMIT 50""",
        "inventory_aging": f"""
            SELECT product_id, {_long('qty')} AS qty, {_double('v')} AS value, days_idle, {_AGE} AS age_bucket FROM stock""",
        "inventory_aging_buckets": f"""
            WITH b AS (SELECT {_AGE} AS age_bucket, count(*) AS n, sum(v) AS v FROM stock GROUP BY 1)
            SELECT label AS age_bucket, coalesce(n, 0) AS sku_count, coalesce({_double('v')}, 0) AS total_value
            FROM (VALUES ('0-30d'), ('31-60d'), ('61-90d'), ('90+d')) l(label) LEFT JOIN b ON label = age_bucket""",
        "dead_stock": f"""
            SELECT product_id, {_long('qty')} AS qty, {_double('v')} AS value_at_risk, days_idle FROM stock WHERE days_idle > 90""",
        "dead_stock_summary": f"""
            SELECT count(*) AS items, coalesce({_double('sum(v)')}, 0) AS total_value_at_risk FROM stock WHERE days_idle > 90""",
        "overstock": f"""
            SELECT product_id, location_id, qty_on_hand, reorder_point, {_double('inventory_value')} AS inventory_value, stock_status
            FROM latest WHERE stock_status = 'overstock'""",
        "overstock_summary": f"""
            SELECT count(*) AS overstocked_items, coalesce({_double('sum(inventory_value)')}, 0) AS total_excess_value
            FROM latest WHERE stock_status = 'overstock'""",
        "stockout_risk": """
            SELECT product_id, location_id, qty_on_hand, days_of_supply, stock_status
            FROM latest WHERE days_of_supply >= 0 AND days_of_supply < 14""",
        "stockout_risk_summary": """
            SELECT count(*) AS at_risk_count FROM latest WHERE days_of_supply >= 0 AND days_of_supply < 14""",
        "abc_xyz_stored": f"""
            SELECT product_id, product_name, category, abc_class, xyz_class, {_double('unit_cost')} AS unit_cost,
                   {_double('unit_price')} AS unit_price FROM products""",
        "abc_xyz_computed": f"""
            SELECT product_id, CAST(round(rev, 2) AS DOUBLE) AS revenue, {_ABC} AS abc, {_XYZ} AS xyz
            FROM classes ORDER BY rev DESC, product_id LIMIT 100""",
        "abc_xyz_with_pct": f"""
            SELECT product_id, CAST(round(rev, 2) AS DOUBLE) AS revenue, round(pct, 2) AS revenue_pct, {_ABC} AS abc, {_XYZ} AS xyz
            FROM classes ORDER BY rev DESC, product_id LIMIT 100""",
        "abc_xyz_classification": f"""
            SELECT product_id, {_ABC} AS abc, {_XYZ} AS xyz, round(pct, 2) AS revenue_pct, round(cv, 6) AS variability_score
            FROM classes""",
        "abc_xyz_lookup": f"""
            SELECT product_id, {_ABC} AS abc, {_XYZ} AS xyz, round(pct, 2) AS revenue_pct, round(cv, 6) AS variability_score
            FROM classes ORDER BY revenue_pct DESC, product_id LIMIT 100""",
        "reorder_alerts_banded": banded.format(extra="", upper="reorder_point * 1.2"),
        "reorder_alerts_banded_summary": """
            SELECT count(*) AS total_alerts, count(*) FILTER (qty_on_hand < reorder_point) AS critical_count,
                   count(*) FILTER (qty_on_hand >= reorder_point) AS warning_count
            FROM latest WHERE qty_on_hand < reorder_point * 1.2""",
        "reorder_alerts_safety_band": banded.format(
            extra=" safety_stock_target AS safety_stock,", upper="reorder_point + safety_stock_target"
        ),
        "dead_stock_by_last_sale": f"""
            WITH {_dead(as_of)}
            SELECT product_id, location_id, qty_on_hand, unit_cost, value_at_risk, last_sale_date FROM aged""",
        "dead_stock_by_last_sale_summary": f"""
            WITH {_dead(as_of)}
            SELECT count(*) AS total_items, coalesce({_double('sum(CAST(value_at_risk AS DECIMAL(18,2)))')}, 0) AS total_value_at_risk
            FROM aged""",
        "dead_stock_with_age": f"WITH {_dead(as_of)} SELECT * FROM aged",
        # cash cycle
        "ccc_scenarios": f"""
            WITH {_scenarios(scenarios)}
            SELECT scenario_id, CAST(printf('%.2f', annual) AS DOUBLE) AS annual_revenue, CAST(printf('%.2f', annual / 365) AS DOUBLE) AS daily_revenue,
                   CAST(a + b + c AS INTEGER) AS total_days_saved, CAST(printf('%.2f', (a + b + c) * (annual / 365)) AS DOUBLE) AS total_cash_freed
            FROM priced""",
        "ccc_scenarios_breakdown": f"""
            WITH {_scenarios(scenarios)}
            SELECT scenario_id, 'Reduce DIO by ' || a || 'd' AS action, CAST(printf('%.2f', a * (annual / 365)) AS DOUBLE) AS cash FROM priced
            UNION ALL
            SELECT scenario_id, 'Reduce DSO by ' || b || 'd', CAST(printf('%.2f', b * (annual / 365)) AS DOUBLE) FROM priced
            UNION ALL
            SELECT scenario_id, 'Increase DPO by ' || c || 'd', CAST(printf('%.2f', c * (annual / 365)) AS DOUBLE) FROM priced""",
        "working_capital_summary": f"""
            SELECT coalesce(product_id, 'unknown') AS product_id, {_long('qty')} AS total_units, {_double('v')} AS trapped_cash
            FROM stock ORDER BY v DESC, stock.product_id LIMIT 50""",
        "working_capital_summary_summary": f"""
            SELECT {_double('sum(v)')} AS total_cash_trapped FROM (SELECT v FROM stock ORDER BY v DESC, product_id LIMIT 50)""",
        "carrying_cost": f"""
            WITH n AS (SELECT {_double('sum(inventory_value)')} AS v FROM latest)
            SELECT CAST(printf('%.2f', v) AS DOUBLE) AS total_inventory_value, 0.25::DOUBLE AS holding_rate,
                   CAST(printf('%.2f', v * 0.25::DOUBLE) AS DOUBLE) AS annual_carrying_cost, CAST(printf('%.2f', v * 0.25::DOUBLE / 12) AS DOUBLE) AS monthly FROM n""",
        "pareto": f"""
            SELECT product_id, {_double('v')} AS val, {_RUNNING} AS cum_pct FROM sold ORDER BY v DESC, product_id LIMIT 50""",
        "pareto_inventory": f"""
            SELECT product_id, {_double('v')} AS val, {_RUNNING} AS cum_pct FROM stock ORDER BY v DESC, product_id LIMIT 50""",
        "pareto_all": f"SELECT product_id, {_double('v')} AS val, {_RUNNING} AS cum_pct FROM sold",
        "pareto_summary": f"""
            WITH c AS (SELECT {_RUNNING} AS cum_pct FROM sold)
            SELECT 'revenue' AS dimension, count(*) AS total_skus, count(*) FILTER (cum_pct <= 80) AS skus_driving_80pct,
                   CAST(printf('%.1f', count(*) FILTER (cum_pct <= 80) / count(*) * 100) AS DOUBLE) AS pct_of_skus FROM c""",
        "ar_aging": f"""
            SELECT aging_bucket, count(*) AS invoices, {_double('sum(invoice_amount)')} AS total_amount,
                   {_double('sum(CASE WHEN paid_date IS NULL THEN invoice_amount ELSE 0 END)')} AS outstanding
            FROM ar_ledger GROUP BY aging_bucket""",
        "ar_aging_summary": f"""
            SELECT coalesce({_double('sum(invoice_amount) FILTER (paid_date IS NULL)')}, 0) AS total_outstanding,
                   count(*) FILTER (dispute_flag) AS dispute_count,
                   coalesce({_double('sum(invoice_amount) FILTER (dispute_flag)')}, 0) AS dispute_amount,
                   count(*) FILTER (write_off_flag) AS write_off_count,
                   coalesce({_double('sum(invoice_amount) FILTER (write_off_flag)')}, 0) AS write_off_amount
            FROM ar_ledger""",
        "dso_by_customer": f"""
            SELECT a.customer_id, c.customer_name, c.segment, round({_weighted('days_to_pay')}, 1) AS weighted_dso,
                   count(*) AS invoices, {_double('sum(invoice_amount)')} AS total_billed
            FROM paid a LEFT JOIN customers c ON a.customer_id = c.customer_id
            GROUP BY a.customer_id, c.customer_name, c.segment ORDER BY weighted_dso DESC, a.customer_id LIMIT 20""",
        "dso_overall": f"SELECT CAST(printf('%.1f', {_weighted('days_to_pay')}) AS DOUBLE) AS overall_dso FROM paid",
        "dpo_by_supplier": f"""
            SELECT a.supplier_id, s.supplier_name, round({_weighted('actual_days_to_pay')}, 1) AS weighted_dpo,
                   s.contracted_payment_days AS terms, count(*) AS invoices,
                   {_double('sum(early_payment_discount)')} AS total_discounts
            FROM ap_ledger a LEFT JOIN suppliers s ON a.supplier_id = s.supplier_id
            GROUP BY a.supplier_id, s.supplier_name, s.contracted_payment_days""",
        "dpo_overall": f"SELECT CAST(printf('%.1f', {_weighted('actual_days_to_pay')}) AS DOUBLE) AS overall_dpo FROM ap_ledger",
        "shipment_tracking": f"""
            SELECT status, count(*) AS count, {_long('sum(qty_shipped)')} AS total_qty,
                   {_double('sum(freight_cost)')} AS total_freight, round(avg(delay_days), 1) AS avg_delay
            FROM shipments GROUP BY status""",
        "shipments_in_transit": """
            SELECT shipment_id, supplier_id, product_id, ship_date, expected_arrival_date, qty_shipped, carrier
            FROM shipments WHERE status = 'In Transit' ORDER BY 1, 2, 3, 4, 5, 6, 7 LIMIT 20""",
        "product_catalog": "SELECT * FROM products",
        # demand
        "forecast_demand": """
            WITH d AS (SELECT product_id, transaction_date, sum(qty_sold) AS qty FROM sales_transactions GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY transaction_date DESC) AS nth,
                         count(*) OVER (PARTITION BY product_id) AS n FROM d),
            a AS (SELECT product_id, any_value(n) AS n, least(any_value(n), 7) AS w,
                         sum(qty) FILTER (nth <= 7) AS last, sum(qty) FILTER (nth > 7 AND nth <= 14) AS before
                  FROM r GROUP BY product_id),
            m AS (SELECT *, CAST(last AS DOUBLE) / w AS ma, CAST(before AS DOUBLE) / w AS old FROM a)
            SELECT product_id, n AS historical_days, CAST(w AS BIGINT) AS window,
                   CASE WHEN n >= 14 AND ma > old * 1.1::DOUBLE THEN 'increasing'
                        WHEN n >= 14 AND ma < old * 0.9::DOUBLE THEN 'decreasing' ELSE 'stable' END AS trend,
                   CAST(printf('%.2f', ma) AS DOUBLE) AS moving_average, CAST(printf('%.0f', ma * 30) AS DOUBLE) AS total_predicted FROM m""",
        "detect_anomalies": anomalies("qty_sold"),
        "detect_anomalies_summary": anomaly_count("qty_sold"),
        "detect_anomalies_revenue": anomalies("CAST(total_revenue AS DOUBLE)", 1.5),
        "detect_anomalies_revenue_summary": anomaly_count("CAST(total_revenue AS DOUBLE)", 1.5),
        "revenue_trends": _trend("CAST(date_trunc('month', transaction_date) AS DATE)"),
        "revenue_trends_weekly": _trend("CAST(date_trunc('week', transaction_date) AS DATE)"),
        "revenue_trends_daily": _trend("transaction_date"),
        "sales_velocity": f"""
            SELECT product_id, {_long('sum(qty_sold)')} AS total_sold, count(DISTINCT transaction_date) AS sale_days,
                   round({_double('sum(qty_sold)')} / nullif(count(DISTINCT transaction_date), 1), 2) AS daily_velocity,
                   {_double('sum(total_revenue)')} AS total_revenue
            FROM sales_transactions GROUP BY product_id ORDER BY daily_velocity DESC NULLS LAST, product_id LIMIT 30""",
        "top_skus": f"""
            SELECT product_id, {_double('sum(total_revenue)')} AS revenue, {_long('sum(qty_sold)')} AS units,
                   {_double('sum(gross_profit)')} AS profit
            FROM sales_transactions GROUP BY product_id ORDER BY sum(total_revenue) DESC, product_id LIMIT 20""",
        "top_skus_brief": f"""
            SELECT product_id, {_double('sum(total_revenue)')} AS revenue, {_long('sum(qty_sold)')} AS units
            FROM sales_transactions GROUP BY product_id ORDER BY sum(total_revenue) DESC, product_id LIMIT 20""",
        "customer_concentration": f"""{top_customers}
            SELECT top.customer_id, coalesce(customer_name, top.customer_id) AS customer_name, {_double('rev')} AS revenue,
                   revenue_pct, unique_products
            FROM top LEFT JOIN customers c ON top.customer_id = c.customer_id""",
        "customer_concentration_summary": f"""{top_customers}
            SELECT round(sum(revenue_pct), 6) AS top_pct, {_level('sum(revenue_pct)', 80, 50)} AS concentration_risk FROM top""",
        "seasonality": f"{months} SELECT month, qty, revenue, CAST(printf('%.2f', qty / avg(qty) OVER ()) AS DOUBLE) AS index_vs_avg FROM m",
        "seasonality_summary": f"""{months}
            SELECT (SELECT month FROM m ORDER BY qty DESC, month LIMIT 1) AS peak_month,
                   (SELECT month FROM m ORDER BY qty, month LIMIT 1) AS low_month""",
        # suppliers
        "supplier_risk_scores": f"""
            WITH x AS (SELECT *, CAST(printf('%.1f', least(100.0::DOUBLE, greatest(0.0::DOUBLE, (CAST(avg_lead_time_days AS DOUBLE) - 5) * 3)) * 0.3::DOUBLE
                + greatest(0.0::DOUBLE, (1 - on_time_delivery_rate) * 200) * 0.4::DOUBLE
                + quality_rejection_rate * 1000 * 0.3::DOUBLE) AS DOUBLE) AS score FROM suppliers)
            SELECT supplier_id, supplier_name, score AS risk_score, {_level('score', 60, 30)} AS risk_level,
                   avg_lead_time_days AS lead_time, on_time_delivery_rate AS otd_rate, quality_rejection_rate AS qrr FROM x""",
        "supplier_performance": "SELECT * FROM suppliers",
        "supplier_concentration": f"{spend} SELECT supplier_id, orders, {_double('v')} AS total_value, value_pct FROM s",
        "supplier_concentration_summary": f"""{spend},
            t AS (SELECT sum(value_pct) AS pct FROM (SELECT * FROM s ORDER BY v DESC, supplier_id LIMIT 3))
            SELECT CAST(printf('%.1f', pct) AS DOUBLE) AS top3_value_pct, {_level('pct', 80, 50)} AS concentration_risk FROM t""",
        "supplier_network": """
            SELECT supplier_id, supplier_name, lead_time, product_id FROM edges JOIN vertices USING (supplier_id)""",
        "supplier_network_named": """
            SELECT supplier_id, supplier_name, lead_time, e.product_id, product_name
            FROM edges e JOIN vertices USING (supplier_id) LEFT JOIN products p ON e.product_id = p.product_id""",
        "single_source_risks": f"""{single}
            SELECT product_id, supplier_name AS sole_supplier, 'high' AS risk
            FROM one JOIN vertices USING (supplier_id) ORDER BY product_id LIMIT 50""",
        "single_source_by_revenue": f"""{single}
            SELECT one.product_id, supplier_name AS sole_supplier, 'high' AS risk, supplier_id, {_double('v')} AS annual_revenue
            FROM one JOIN vertices USING (supplier_id) LEFT JOIN sold ON one.product_id = sold.product_id
            ORDER BY v DESC NULLS LAST, one.product_id LIMIT 50""",
        "ripple_effect": f"""
            SELECT supplier_id, supplier_name, count(*) AS impacted_count, {_level('count(*)', 10, 3)} AS severity
            FROM edges JOIN vertices USING (supplier_id) GROUP BY supplier_id, supplier_name""",
        "ripple_effect_products": "SELECT * FROM edges",
        "ripple_with_finished_goods": f"""
            WITH {bom},
            counted AS (SELECT supplier_id, count(*) AS impacted_count FROM lines GROUP BY supplier_id),
            risk AS (SELECT supplier_id, sum(v) AS v FROM touched JOIN sold USING (product_id) GROUP BY supplier_id)
            SELECT supplier_id, supplier_name, impacted_count, coalesce({_double('v')}, 0) AS revenue_at_risk,
                   CASE WHEN impacted_count > 10 THEN 'high' ELSE 'medium' END AS severity
            FROM counted JOIN vertices USING (supplier_id) LEFT JOIN risk USING (supplier_id)""",
        "ripple_with_finished_goods_lines": f"WITH {bom} SELECT supplier_id, product_id, finished_id FROM lines",
        "lead_time_listing": "SELECT supplier_id, supplier_name, lead_time, rating FROM vertices",
        "lead_time_variability": """
            SELECT supplier_id, supplier_name, count(*) AS product_count,
                   CAST(printf('%.1f', coalesce(avg(lead_time_days), 0)) AS DOUBLE) AS avg_lead_time, min(lead_time_days) AS min_lead_time,
                   max(lead_time_days) AS max_lead_time, CAST(printf('%.2f', coalesce(stddev_samp(lead_time_days), 0)) AS DOUBLE) AS variability
            FROM edges e JOIN vertices USING (supplier_id) LEFT JOIN products p ON e.product_id = p.product_id
            GROUP BY supplier_id, supplier_name""",
        "alternative_suppliers": _alternatives(
            "SELECT * FROM (SELECT product_id FROM edges UNION SELECT product_id FROM products) CROSS JOIN (SELECT * FROM vertices)",
            "",
            "rating DESC NULLS LAST, supplier_id",
        ),
        "alternative_suppliers_current": """
            SELECT product_id, supplier_id, supplier_name, lead_time, rating
            FROM (SELECT product_id, min(supplier_id) AS supplier_id FROM edges GROUP BY product_id) JOIN vertices USING (supplier_id)""",
        "alternative_suppliers_same_category": _alternatives(
            """SELECT DISTINCT a.product_id, supplier_id, supplier_name, lead_time, rating, country
               FROM products a JOIN products b ON a.category = b.category JOIN edges e ON e.product_id = b.product_id
               JOIN vertices USING (supplier_id)""",
            ", country",
            "rating DESC NULLS LAST, lead_time, supplier_id",
        ),
        "supplier_vertices": "SELECT * FROM vertices",
        "product_vertices": "SELECT DISTINCT product_id FROM edges",
        "supply_edges": "SELECT * FROM edges",
        # catalog
        "list_uploads": _counts(
            "SELECT '{name}' AS category, 'uploaded' AS status, count(*) AS rows, '{destination}' AS destination FROM {name}"
        ),
        "schema_info": f"""
            SELECT column_name, column_type, n AS rows
            FROM (VALUES {type_rows}) t(column_name, column_type) CROSS JOIN (SELECT count(*) AS n FROM sales_transactions)""",
        "version_history": _counts(
            "SELECT CAST(NULL AS BIGINT) AS id, '{name}' AS file_category, CAST(NULL AS VARCHAR) AS filename, "
            "CAST(NULL AS TIMESTAMP) AS upload_timestamp, count(*) AS row_count, 'uploaded' AS status FROM {name}"
        ),
        "database_state": _counts(
            "SELECT 'table' AS store, '{name}' AS object, 'ok' AS status, count(*) AS rows, CAST({columns} AS INTEGER) AS columns FROM {name}"
        )
        + """
            UNION ALL SELECT 'graph', 'suppliers', 'ok', count(*), NULL FROM vertices
            UNION ALL SELECT 'graph', 'products', 'ok', count(DISTINCT product_id), NULL FROM edges
            UNION ALL SELECT 'graph', 'relationships', 'ok', count(*), NULL FROM edges""",
        "database_status": f"""
            SELECT count(*) AS tables, {_long('sum(n)')} AS total_rows,
                   (SELECT count(*) FROM vertices) + (SELECT count(DISTINCT product_id) FROM edges) AS nodes,
                   (SELECT count(*) FROM edges) AS relationships
            FROM ({_counts('SELECT count(*) AS n FROM {name}')})""",
        "run_sql_query": free_sql,
        "run_sql_query_all": long_sql,
        "run_sql_query_summary": f"SELECT count(*) AS rows FROM ({long_sql})",
        # questions where an optional table is not loaded
        "kpi_without_ledgers": f"""{kpi}
            SELECT dio, 30.0::DOUBLE AS dso, 0.0::DOUBLE AS dpo, CAST(printf('%.1f', dio + 30.0::DOUBLE) AS DOUBLE) AS ccc FROM n""",
        "dso_without_customers": """
            SELECT customer_id, round(CAST(sum(days_to_pay) AS DOUBLE) / count(days_to_pay), 1) AS weighted_dso, count(*) AS invoices
            FROM ar_ledger WHERE days_to_pay IS NOT NULL GROUP BY customer_id""",
        "dpo_without_suppliers": """
            SELECT supplier_id, round(CAST(sum(actual_days_to_pay) AS DOUBLE) / nullif(count(actual_days_to_pay), 0), 1) AS weighted_dpo,
                   count(*) AS invoices
            FROM ap_ledger GROUP BY supplier_id""",
        "customer_concentration_without_customers": f"""
            SELECT customer_id, {_double('sum(total_revenue)')} AS revenue
            FROM sales_transactions WHERE customer_id IS NOT NULL GROUP BY customer_id""",
    }

    texts |= _history_texts() | {"kpi_summary_by_day": texts["kpi_summary"]}

    def only(key: str, condition: str) -> str:
        return f"SELECT * FROM ({texts[key]}) WHERE {condition}"

    listed = "product_id IN ('P1', 'P2')"
    texts |= {
        "single_source_risks_all": texts["single_source_risks"].replace(" LIMIT 50", ""),
        "shipments_in_transit_all": texts["shipments_in_transit"].replace(" LIMIT 20", ""),
        "working_capital_total": f"SELECT {_double('sum(v)')} AS total_cash_trapped FROM stock",
        "dso_by_customer_all": texts["dso_by_customer"].replace(" LIMIT 20", ""),
        "abc_xyz_computed_all": texts["abc_xyz_computed"].replace(" LIMIT 100", ""),
        "abc_xyz_without_products": texts["abc_xyz_computed"].replace(" LIMIT 100", ""),
        "product_catalog_filtered": only("product_catalog", "abc_class = 'A' AND xyz_class = 'X'"),
        "forecast_demand_one": only("forecast_demand", "product_id = 'P1'"),
        "seasonality_one": texts["seasonality"].replace("GROUP BY 1", "WHERE product_id = 'P1' GROUP BY 1"),
        "safety_stock_some": only("safety_stock", listed),
        "eoq_some": only("eoq", listed),
        "ripple_effect_one": only("ripple_effect", "supplier_id = 'S1'"),
        "alternative_suppliers_one": only("alternative_suppliers", "product_id = 'P1'"),
        "alternative_suppliers_same_category_one": only("alternative_suppliers_same_category", "product_id = 'P1'"),
        "shipment_tracking_delayed": only("shipment_tracking", "status = 'Delayed'"),
    }
    return {key: _complete(sql) for key, sql in texts.items()}
