"""Shared plan fragments against brute force, and what the plans must (not) contain."""

import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import _PLAIN, _WITH_PARAMETERS, queries
from conftest import SMALL
from ledgerloom.plans.absent import best_absent
from ledgerloom.plans.order import global_rank, running_groups, running_top
from ledgerloom.plans.snapshot import latest_snapshot
from ledgerloom.sources.derived import derived_tables
from ledgerloom.tables import Tables

ASKED = {**_PLAIN, **_WITH_PARAMETERS}


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("partitions", ["1", "3", "64"])
def test_running_groups_match_brute_force(spark, partitions):
    random.seed(7)
    values = [random.randint(-20, 60) for _ in range(300)] + [0] * 200 + [None] * 3
    df = spark.createDataFrame([(v,) for v in values], "v int").withColumn("v", F.col("v").cast("decimal(12,2)"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.v: (r.members, r.running) for r in running_groups(df, "v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    known = [v for v in values if v is not None]
    for v in set(known):
        assert got[v] == (values.count(v), sum(x for x in known if x >= v))
    assert got[None] == (3, sum(known))


@pytest.mark.parametrize("partitions", ["1", "5", "64"])
def test_global_rank(spark, partitions):
    rows = [(i % 3, f"k{i:03d}") for i in range(200)]
    random.Random(1).shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        ranked = global_rank(
            spark.createDataFrame(rows, "r int, k string"), [F.col("r").desc_nulls_last(), F.col("k").asc()]
        ).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    wanted = sorted(rows, key=lambda x: (-x[0], x[1]))
    assert [(r.r, r.k) for r in sorted(ranked, key=lambda r: r.position)] == wanted
    assert sorted(r.position for r in ranked) == list(range(1, 201))


def brute_absent(holdings, pool, items, k):
    held = {}
    for item, member in holdings:
        held.setdefault(item, set()).add(member)
    best = sorted(pool, key=lambda m: (-m[1], m[0]))
    return {
        (item, place): m[0]
        for item in items
        for place, m in enumerate([m for m in best if m[0] not in held.get(item, set())][:k], start=1)
    }


@pytest.mark.parametrize("shortlist", [3, 4, 8, 512])
def test_best_absent_is_exact_for_any_shortlist(spark, shortlist):
    """One item holds nearly everything, one exactly the shortlist, one everything: a hot group."""
    rng = random.Random(shortlist)
    pool = [(f"m{i:02d}", float(i % 7)) for i in range(40)]
    best = sorted(pool, key=lambda m: (-m[1], m[0]))
    holdings = [("all", m) for m, _ in pool] + [("most", m) for m, _ in pool[:-2]]
    holdings += [("top", m) for m, _ in best[:shortlist]] + [("every_other", m) for m, _ in best[::2]]
    holdings += [("hole", m) for m, _ in best[:9] + best[20:31]]
    holdings += [(f"i{n}", rng.choice(pool)[0]) for n in range(20) for _ in range(rng.randint(1, 12))]
    holdings += holdings[:30]
    items = sorted({i for i, _ in holdings})
    found = best_absent(
        spark.createDataFrame(holdings, "item string, member string"),
        spark.createDataFrame(pool, "member string, rating double"),
        [F.col("rating").desc_nulls_last(), F.col("member").asc()],
        item="item",
        member="member",
        k=3,
        shortlist=shortlist,
    )
    assert {(r["item"], r["choice"]): r["member"] for r in found.collect()} == brute_absent(holdings, pool, items, 3)


@pytest.mark.parametrize("shortlist", [2, 5, 512])
def test_best_absent_by_group(spark, shortlist):
    pool = [(g, f"m{i:02d}", float(i % 5)) for g in "ab" for i in range(12 if g == "a" else 4)]
    holdings = [("a", "a1", f"m{i:02d}") for i in range(11)] + [("b", "b1", "m00"), ("a", "a2", "m04")]
    items = [("a", "a1"), ("a", "a2"), ("a", "a3"), ("b", "b1"), ("b", "b2"), ("c", "c1")]
    found = best_absent(
        spark.createDataFrame(holdings, "g string, item string, member string"),
        spark.createDataFrame(pool, "g string, member string, rating double"),
        [F.col("rating").desc_nulls_last(), F.col("member").asc()],
        item="item",
        member="member",
        items=spark.createDataFrame(items, "g string, item string"),
        group="g",
        k=2,
        shortlist=shortlist,
    ).collect()
    wanted = {}
    for g in "ab":
        wanted.update(
            brute_absent(
                [(i, m) for x, i, m in holdings if x == g],
                [(m, r) for x, m, r in pool if x == g],
                [i for x, i in items if x == g],
                2,
            )
        )
    assert {(r["item"], r["choice"]): r["member"] for r in found} == wanted


def test_latest_snapshot_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "inv")
    spark.range(100).selectExpr(
        "concat('P', id) product_id", "date_add(date'2024-01-01', cast(id % 4 as int)) snapshot_date", "cast(id as int) qty"
    ).write.partitionBy("snapshot_date").parquet(path)
    latest = latest_snapshot(spark.read.parquet(path))
    assert latest.count() == 25
    plan = executed(latest)
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan and "= Subquery" in plan
    assert "ReadSchema: struct<>" in plan


# Questions whose result is a whole table, per row or per key. None may send its
# input through one task or join without keys.
DISTRIBUTED = [
    "top_skus", "forecast_demand", "detect_anomalies", "customer_concentration", "supplier_concentration",
    "inventory_turnover", "safety_stock", "eoq", "reorder_alerts", "dead_stock_with_age", "supplier_network",
    "single_source_by_revenue", "lead_time_variability", "dso_by_customer", "sales_velocity", "alternative_suppliers",
    "alternative_suppliers_same_category", "pareto_all", "abc_xyz_classification",
]


@pytest.mark.parametrize("name", DISTRIBUTED)
def test_plan_has_no_cartesian_or_python(spark, name):
    plan = executed(queries()[name](spark, SMALL))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval", "MapInPandas"):
        assert word not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = executed(queries()["supply_edges"](spark, SMALL))
    assert "IsNotNull(l_orderkey)" in plan.split("PushedFilters: ")[1]
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint>" in plan
    assert "l_extendedprice" not in plan


TOP_LISTS = ["pareto", "pareto_inventory", "abc_xyz_computed", "abc_xyz_with_pct"]


@pytest.mark.parametrize("name", TOP_LISTS)
def test_top_lists_sort_no_whole_table(spark, name):
    """Apart from the order of the listed rows, which has few rows left to sort."""
    assert "rangepartitioning" not in executed(queries()[name](spark, SMALL).limit(1000))


@pytest.mark.parametrize("name", [*TOP_LISTS, "pareto_all", "pareto_summary", "abc_xyz_classification", "data_quality_report", "check_quality"])
def test_building_starts_no_job(spark, name):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"build-{name}", "building only")
    derived = derived_tables(spark, SMALL)
    # Opening a file makes Spark read its footer in a job; no question is asked yet.
    t = Tables(spark, {n: derived[n] for n in derived.names})
    before = len(tracker.getJobIdsForGroup(f"build-{name}"))
    ASKED[name](t)
    try:
        assert len(tracker.getJobIdsForGroup(f"build-{name}")) == before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("limit", [1, 3, 7, 12, 50])
def test_running_top_matches_brute_force(spark, limit):
    values = [5, 5, 5, 9, 9, 2, 2, 2, 2, -1, None, None, 0]
    df = spark.createDataFrame([(f"k{i:02d}", v) for i, v in enumerate(values)], "k string, v int")
    df = df.withColumn("v", F.col("v").cast("decimal(12,2)")).repartition(3)
    known = [v for v in values if v is not None]
    ordered = sorted(enumerate(values), key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))[:limit]
    wanted = {f"k{i:02d}": sum(x for x in known if v is None or x >= v) for i, v in ordered}
    assert {r.k: r.running for r in running_top(df, "v", "k", limit).collect()} == wanted


@pytest.mark.parametrize("name", ["kpi_summary", "pareto_all", "abc_xyz_with_pct", "forecast_demand", "customer_concentration"])
def test_same_result_for_any_partitioning(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1" if n == "64" else "10485760")
            results.append(sorted(queries()[name](spark, SMALL).collect(), key=str))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert results[0] == results[1]
