"""The read-only guard looks at the parsed statement, not at its text."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from ledgerloom.operators.freesql import ReadOnlyViolation, check_read_only, run_sql_query, run_sql_query_summary

REFUSED = [
    "INSERT INTO products SELECT * FROM products",
    "WITH a AS (SELECT 1 x) INSERT INTO products SELECT * FROM a",
    "FROM products INSERT INTO other SELECT *",
    "CREATE TABLE z AS SELECT * FROM products",
    "CREATE OR REPLACE TEMP VIEW products AS SELECT 1",
    "DROP TABLE products",
    "UPDATE products SET unit_cost = 1",
    "DELETE FROM products",
    "MERGE INTO a USING b ON a.x = b.x WHEN MATCHED THEN DELETE",
    "TRUNCATE TABLE products",
    "ALTER TABLE products ADD COLUMNS (z int)",
    "EXECUTE IMMEDIATE 'drop table products'",
    "SELECT TRANSFORM(product_id) USING 'cat' AS (x) FROM products",
    "SELECT reflect('java.lang.System', 'exit', 0)",
    "SELECT * FROM products WHERE product_id = java_method('java.lang.System', 'getenv', 'HOME')",
    "SELECT (SELECT try_reflect('java.lang.System', 'exit', 0)) AS x",
    "WITH a AS (SELECT reflect('java.lang.System', 'exit', 0) AS x) SELECT * FROM a",
    "SET spark.sql.ansi.enabled = false",
    "USE other",
    "CACHE TABLE products",
    "ANALYZE TABLE products COMPUTE STATISTICS",
    "ADD JAR '/tmp/x.jar'",
    "BEGIN DROP TABLE products; END",
    "SELECT * FROM products WHERE EXISTS (SELECT reflect('a', 'b') FROM products)",
    "CREATE TABLE IDENTIFIER('t' || 'u') USING parquet AS SELECT 1",
    "INSERT INTO IDENTIFIER('t' || 'u') SELECT 2",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.name')",
    "CACHE TABLE IDENTIFIER('prod' || 'ucts')",
    "CREATE TEMPORARY VIEW IDENTIFIER('v' || 'w') AS SELECT 1",
]
ACCEPTED = [
    "SELECT product_id AS last_updated FROM products",
    "WITH a AS (SELECT * FROM products) SELECT count(*) AS deleted FROM a",
    "SELECT 'DROP TABLE products' AS created",
    "SELECT * FROM products p WHERE EXISTS (SELECT 1 FROM products q WHERE q.product_id = p.product_id)",
    "SHOW TABLES",
    "DESCRIBE products",
    "EXPLAIN SELECT * FROM products",
    "VALUES (1), (2)",
]


@pytest.fixture
def t(make):
    return make(products=[dict(product_id=f"P{i:03d}", unit_cost=i) for i in range(150)])


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(t, sql):
    with pytest.raises(ReadOnlyViolation):
        run_sql_query(t, sql)


@pytest.mark.parametrize("sql", ACCEPTED)
def test_accepted(t, spark, sql):
    check_read_only(spark, sql)
    run_sql_query(t, sql).collect()


def test_first_hundred_rows_and_all_of_them(t):
    assert run_sql_query(t, "SELECT * FROM products").count() == 100
    assert run_sql_query(t, "SELECT * FROM products", limit=None).count() == 150
    assert run_sql_query_summary(t, "SELECT * FROM products").first().rows == 150


def test_files_cannot_be_read_by_path(t, spark):
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND|UNSUPPORTED_DATASOURCE|not found"):
        run_sql_query(t, "SELECT * FROM parquet.`/root/testdata/sf0.001/part.parquet`")
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_views_and_settings_of_the_caller_stay(t, spark):
    spark.range(3).createOrReplaceTempView("products")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert run_sql_query_summary(t, "SELECT * FROM products").first().rows == 150
        assert run_sql_query(t, "SELECT current_timezone() AS z").first().z == "Asia/Tokyo"
        assert spark.table("products").count() == 3
        assert not [v for v in spark.catalog.listTables("global_temp") if v.database == "global_temp"]
    finally:
        spark.conf.unset("spark.sql.session.timeZone")
        spark.catalog.dropTempView("products")


def test_views_of_the_caller_are_not_seen(t, spark):
    spark.range(3).createOrReplaceTempView("private_rows")
    try:
        with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
            run_sql_query(t, "SELECT * FROM private_rows")
    finally:
        spark.catalog.dropTempView("private_rows")


def test_statements_at_the_same_time(t, make):
    other = make(products=[dict(product_id="X", unit_cost=1)])
    with ThreadPoolExecutor(4) as pool:
        counts = list(pool.map(lambda i: run_sql_query_summary((t, other)[i % 2], "SELECT * FROM products").first().rows, range(12)))
    assert counts == [150, 1] * 6
