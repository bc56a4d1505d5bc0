"""As-of and interval joins, neighbours, ranks, quantiles, levels, differences, kept states and part paths, against brute
force on small rows with one hot key, and what their plans contain."""

import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import _PLAIN, queries
from conftest import SMALL
from ledgerloom.operators import catalog, demand, overview, states, timeline
from ledgerloom.plans.difference import changes
from ledgerloom.plans.levels import all_levels, rollup_sets
from ledgerloom.plans.paths import all_uses, cyclic_uses
from ledgerloom.plans.ranks import quantiles_by, ranked, tile
from ledgerloom.plans.timeline import inside_slices, last_known, running, with_neighbours
from ledgerloom.sources.daily import DailyStates, days_of
from ledgerloom.sources.derived import derived_tables
from ledgerloom.sources.store import Store
from ledgerloom.tables import Tables
from test_plans import executed

DAY = date(2024, 1, 1)
SLICES = [1, 5, 64]


def day(n):
    return None if n is None else DAY + timedelta(days=n)


def hot_rows(seed, n=400):
    """(key, day): a third of the rows and more under one key, some without a key or a day."""
    rng = random.Random(seed)
    keys = ["hot"] * 5 + ["a", "b", "c", None]
    return [(rng.choice(keys), rng.choice([None, *range(60)])) for _ in range(n)]


@pytest.mark.parametrize("slices", SLICES)
@pytest.mark.parametrize("strict", [False, True])
def test_last_known(spark, slices, strict):
    events = [(k, day(d), i) for i, (k, d) in enumerate(hot_rows(1))]
    states_ = [(k, day(d), i % 7, f"s{i}") for i, (k, d) in enumerate(hot_rows(2, 60)) if d is not None]
    found = last_known(
        spark.createDataFrame(events, "k string, at date, i int"),
        spark.createDataFrame(states_, "k string, seen date, level int, name string"),
        ["k"], "at", "seen", ["level", "name"], strict, slices,
    )
    wanted = []
    for k, at, i in events:
        known = [s[1:] for s in states_ if s[0] == k and at is not None and (s[1] < at or (s[1] == at and not strict))]
        wanted.append((k, at, i, *(max(known) if known else (None, None, None))))
    assert sorted(map(tuple, found.collect()), key=lambda r: r[2]) == wanted


def test_last_known_of_nothing(spark):
    events = spark.createDataFrame([("a", day(1))], "k string, at date")
    states_ = spark.createDataFrame([("a", day(0), 1)], "k string, seen date, v int")
    ask = lambda e, s: [tuple(r) for r in last_known(e, s, ["k"], "at", "seen", ["v"]).collect()]
    assert ask(events, states_) == [("a", day(1), day(0), 1)]
    assert ask(events, states_.limit(0)) == [("a", day(1), None, None)]
    assert ask(events.limit(0), states_) == []


@pytest.mark.parametrize("slices", SLICES)
def test_running(spark, slices):
    rows = [(k, day(d), i, i % 11 - 5) for i, (k, d) in enumerate(hot_rows(3)) if d is not None]
    df = spark.createDataFrame(rows, "k string, at date, i int, v int")
    found = running(df, ["k"], "at", {"s": F.col("v"), "d": F.col("v").cast("decimal(3,1)")}, [F.col("i")], slices).collect()
    whole = running(df, [], "at", {"s": F.col("v")}, [F.col("i")], slices).collect()
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    sums, total, by_key, over_all = defaultdict(int), 0, {}, {}
    for k, _, i, v in order:
        sums[k] += v
        total += v
        by_key[i], over_all[i] = sums[k], total
    assert {r.i: r.s for r in found} == by_key == {r.i: int(r.d) for r in found} and len(found) == len(rows)
    assert {r.i: r.s for r in whole} == over_all


@pytest.mark.parametrize("slices", SLICES)
def test_neighbours(spark, slices):
    rows = [(k, day(d), i, i % 13) for i, (k, d) in enumerate(hot_rows(4)) if d is not None]
    df = spark.createDataFrame(rows, "k string, at date, i int, v int")
    near = with_neighbours(df, ["k"], "at", ["i"], before=4, after=2, slices=slices)
    w = inside_slices(["k"], "at", ["i"])
    found = near.withColumn("s", F.sum("v").over(w.rowsBetween(-4, 0))).withColumn("n", F.lead("i", 2).over(w)).where("_own").collect()
    lists = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        lists[r[0]].append(r)
    wanted = {}
    for own in lists.values():
        for j, r in enumerate(own):
            wanted[r[2]] = (sum(x[3] for x in own[max(0, j - 4) : j + 1]), own[j + 2][2] if j + 2 < len(own) else None)
    assert {r.i: (r.s, r.n) for r in found} == wanted and len(found) == len(rows)


@pytest.mark.parametrize("slices", SLICES)
def test_ranks_with_a_value_that_most_rows_hold(spark, slices):
    rng = random.Random(5)
    rows = [(f"item-{i:05d}", rng.choice([None, 0, 0, 0, 0, rng.randint(-50, 50)])) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v int").withColumn("v", F.col("v").cast("decimal(10,2)"))
    found = ranked(df, "v", "k", slices).withColumn("tile", tile(F.col("position"), F.lit(500), 7)).collect()
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [r.k for r in sorted(found, key=lambda r: r.position)] == [k for k, _ in order]
    assert sorted(r.position for r in found) == list(range(1, 501))
    sizes = Counter(r.tile for r in found)
    assert [sizes[t] for t in range(1, 8)] == [72] * 3 + [71] * 4


def test_more_tiles_than_rows(spark):
    df = spark.range(3).select((F.col("id") + 1).alias("p"))
    assert [r[0] for r in df.select(tile(F.col("p"), F.lit(3), 5)).collect()] == [1, 2, 3]


@pytest.mark.parametrize("slices", SLICES)
def test_quantiles_with_a_group_that_has_most_rows(spark, slices):
    rng = random.Random(6)
    rows = [(k, rng.choice([None, 7, 7, 7, rng.randint(0, 999)])) for k, _ in hot_rows(7, 600)] + [("nulls", None)]
    df = spark.createDataFrame(rows, "k string, v int")
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    found = {(r.k, r.share): (r["quantile"], r.members) for r in quantiles_by(df, ["k"], "v", shares, slices).collect()}
    wanted = {}
    for k in {k for k, _ in rows}:
        values = sorted(v for g, v in rows if g == k and v is not None)
        for share in shares if values else []:
            rank = next(i for i in range(1, len(values) + 1) if i >= share * len(values) - 1e-9)
            wanted[k, share] = (values[rank - 1], len(values))
    assert found == wanted
    assert quantiles_by(df.where("v IS NULL"), ["k"], "v", shares, slices).count() == 0


def test_levels(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["x", "y", None]), rng.choice([1, 2]), rng.choice("pq"), rng.choice(["c1", "c2", "c3", None]), rng.randint(0, 9)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b int, c string, who string, v int")
    found = all_levels(df, ["a", "b", "c"], ["v"], distinct="who")
    wanted = {(r.a, r.b, r.c, r.level): (r.v, r.n) for r in df.cube("a", "b", "c").agg(F.grouping_id().alias("level"), F.sum("v").alias("v"), F.count_distinct("who").alias("n")).collect()}
    got = found.collect()
    assert {(r.a, r.b, r.c, r.level): (r.v, r.n_who) for r in got} == wanted and len(got) == len(wanted)
    some = all_levels(df, ["a", "b", "c"], ["v"], sets=rollup_sets(["a", "b", "c"])).collect()
    assert {(r.a, r.b, r.c, r.level): r.v for r in some} == {k: v[0] for k, v in wanted.items() if k[3] in (0, 1, 3, 7)}


def scans(plan, table):
    """How often the final plan reads a table; reused shuffles do not count."""
    final = plan.split("== Initial Plan ==")[0]
    return final.count(f"{table}.parquet")


def test_all_levels_read_the_facts_once(spark):
    plan = executed(queries()["revenue_cube"](spark, SMALL))
    assert "Expand" not in plan and scans(plan, "lineitem") == 1


@pytest.mark.parametrize("name", ["stock_at_sale", "receipt_before_sale", "open_receivables_daily", "credit_exposure", "order_gaps", "moving_revenue", "customer_deciles", "payment_quantiles"])
def test_no_pairs_no_single_task_and_no_job_ahead(spark, name):
    derived = derived_tables(spark, SMALL)
    t = Tables(spark, {n: derived[n] for n in derived.names})
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"ahead-{name}", "building only")
    try:
        before = len(tracker.getJobIdsForGroup(f"ahead-{name}"))
        df = _PLAIN[name](t)
        assert len(tracker.getJobIdsForGroup(f"ahead-{name}")) == before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = executed(df)
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "RDDScan"):
        assert word not in plan


def test_credit_exposure_of_odd_invoices(make, rows):
    t = make(
        customers=[dict(customer_id="c", customer_name="C", credit_limit=100)],
        ar_ledger=[
            dict(invoice_id="i1", customer_id="c", invoice_amount=60, invoice_date=day(0), paid_date=day(5)),
            dict(invoice_id="i2", customer_id="c", invoice_amount=50, invoice_date=day(2), paid_date=day(2)),
            dict(invoice_id="i3", customer_id="c", invoice_amount=40, invoice_date=day(2)),
            dict(invoice_id="i4", customer_id="c", invoice_amount=10, invoice_date=day(5), paid_date=day(1)),
            dict(invoice_id="i5", customer_id="d", invoice_amount=10, invoice_date=day(5)),
            dict(invoice_id="i6", customer_id="c", invoice_amount=10),
        ],
    )
    found = {r["invoice_id"]: (r["open_amount"], r["open_invoices"], r["over_limit"]) for r in rows(timeline.credit_exposure(t))}
    assert found == {"i1": (0.0, 0, False), "i2": (60.0, 1, True), "i3": (60.0, 1, False), "i4": (40.0, 1, False), "i5": (0.0, 0, None)}
    daily = {r["day"]: (r["opened"], r["closed"], r["open_invoices"], r["open_amount"]) for r in rows(timeline.open_receivables_daily(t))}
    assert len(daily) == 6
    assert daily[day(0)] == (1, 0, 1, 60.0) and daily[day(1)] == (0, 0, 1, 60.0) and daily[day(2)] == (1, 0, 2, 100.0) and daily[day(5)] == (1, 1, 2, 50.0)


def test_changes_equal_except_all_both_ways(spark):
    rng = random.Random(9)
    row = lambda: (rng.choice([None, 1, 2]), rng.choice([None, "x", "y"]), rng.choice([None, 0.5, float("nan")]))
    schema = "a int, b string, c double"
    old, new = (spark.createDataFrame([row() for _ in range(120)], schema) for _ in "12")
    found = changes(old, new)
    text = lambda df: Counter(str(tuple(r)[:3]) for r in df.collect())
    counted = lambda kind: Counter({str(tuple(r)[:3]): r.copies for r in found.where(F.col("change") == kind).collect()})
    assert counted("added") == text(new.exceptAll(old)) and counted("removed") == text(old.exceptAll(new))
    assert changes(old, old).count() == 0 and changes(old.limit(0), old.limit(0)).count() == 0
    wider = changes(old, old.withColumn("d", F.lit(1)))
    assert wider.columns == ["a", "b", "c", "d", "change", "copies"] and wider.agg(F.sum("copies")).first()[0] == 240


def test_versions_of_a_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    customer = lambda *names: spark.createDataFrame([(f"c{i}", n) for i, n in enumerate(names)], "customer_id string, customer_name string")
    store.replace(customer("Ann", "Bob"), "customers")
    first = max(r.id for r in store.upload_log().collect())
    between = datetime.fromtimestamp(first / 1e6, timezone.utc).replace(tzinfo=None)
    then = store.tables()
    # Another writer on the same folder.
    Store(spark, str(tmp_path / "store")).replace(customer("Ann", "Bert", "Cy"), "customers")
    assert then["customers"].count() == 2 and store.tables()["customers"].count() == 3
    assert store.tables(first)["customers"].count() == store.tables(between)["customers"].count() == 2
    assert not store.tables(first - 1).has("customers")
    found = {(r.customer_id, r.customer_name, r.change) for r in store.changes("customers", first).collect()}
    assert found == {("c1", "Bob", "removed"), ("c1", "Bert", "added"), ("c2", "Cy", "added")}
    assert catalog.versions_as_of(store.tables(), first).first().row_count == 2
    assert [r.row_count for r in catalog.version_history(store.tables()).collect()] == [3, 2]


def test_daily_states(spark, tmp_path):
    derived = derived_tables(spark, SMALL)
    path = str(tmp_path / "sales")
    sales = derived["sales_transactions"].where("transaction_date >= DATE '2001-06-01'")
    cut = str(sales.agg(F.max("transaction_date")).first()[0])
    sales.where(F.col("transaction_date") != cut).write.partitionBy("transaction_date").parquet(path)
    others = {n: derived[n] for n in ("inventory_snapshot", "ar_ledger", "ap_ledger")}
    kept = DailyStates(spark, str(tmp_path / "states"))
    t = Tables(spark, {**others, "sales_transactions": spark.read.parquet(path)})
    kept.refresh(t)
    assert kept.kpi_summary().collect() == overview.kpi_summary(t).collect()
    added = sales.where(F.col("transaction_date") == cut)
    added.write.mode("append").partitionBy("transaction_date").parquet(path)
    assert days_of(added, "transaction_date") == [cut]
    t = Tables(spark, {**others, "sales_transactions": spark.read.parquet(path)})
    assert "PartitionFilters: [isnotnull(transaction_date" in executed(states.kpi_state(t.only("sales_transactions"), [cut]))
    kept.refresh(t, [cut, "1990-01-01"])
    assert kept.kpi_summary().collect() == overview.kpi_summary(t).collect() == states.kpi_summary_by_day(t).collect()
    plan = executed(kept.kpi_summary())
    assert path not in plan
    monthly = {r.period: (r.revenue, r.products) for r in states.trends_from_states(kept.sales_states()).collect()}
    assert monthly == {r.period: (r.revenue, r.skus) for r in demand.revenue_trends(t).collect()}
    # A day whose rows have gone is gone from the states as well.
    gone = Tables(spark, {**others, "sales_transactions": spark.read.parquet(path).where(F.col("transaction_date") != cut)})
    kept.refresh(gone, [cut])
    assert kept.kpi_summary().collect() == overview.kpi_summary(gone).collect()
    assert kept.sales_states().where(F.col("transaction_date") == cut).count() == 0


def test_sketches_of_a_million_values(spark):
    """Merged over days, the estimate stays within 2 % of a million different customers."""
    sales = spark.range(2_000_000).selectExpr(
        "date_add(date'2024-01-01', cast(id % 20 as int)) AS transaction_date", "'P' || id % 50 AS product_id",
        "'C' || (id * 7919) % 1000000 AS customer_id", "cast(1 as int) AS qty_sold", "cast(1 as decimal(18,4)) AS total_revenue",
    )
    merged = states.trends_from_states(states.sales_state(Tables(spark, {"sales_transactions": sales}))).first()
    assert merged.customers == pytest.approx(1_000_000, rel=0.02) and merged.products == 50 and merged.units == 2_000_000


def test_part_paths(spark):
    bom = [("a", "b", 2), ("a", "b", 1), ("b", "d", 4), ("a", "c", 5), ("c", "d", 1), ("d", "e", 2), ("a", "e", 1)]
    cycle = [("x", "y", 1), ("y", "z", 1), ("z", "x", 1), ("a", "x", 1), ("self", "self", 3)]
    df = spark.createDataFrame(bom + cycle, "component_id string, finished_id string, quantity int")
    found = {(r.component_id, r.finished_id): (r.quantity, r.paths, r.first_level, r.last_level) for r in all_uses(df).collect()}
    d = Decimal
    assert found == {
        ("a", "b"): (d(3), 1, 1, 1), ("a", "c"): (d(5), 1, 1, 1), ("b", "d"): (d(4), 1, 1, 1), ("c", "d"): (d(1), 1, 1, 1),
        ("d", "e"): (d(2), 1, 1, 1), ("a", "d"): (d(17), 2, 2, 2), ("a", "e"): (d(35), 3, 1, 3), ("b", "e"): (d(8), 1, 2, 2),
        ("c", "e"): (d(2), 1, 2, 2), ("a", "x"): (d(1), 1, 1, 1),
    }
    assert {tuple(r) for r in cyclic_uses(df).collect()} == {("x", "y"), ("y", "z"), ("z", "x"), ("self", "self")}
    assert all_uses(df.limit(0)).count() == 0


def test_a_hub_part_with_many_uses(spark):
    hub = spark.range(100_000).selectExpr("'hub' AS component_id", "'f' || id AS finished_id", "2 AS quantity")
    below = spark.createDataFrame([("raw", "hub", 3)], "component_id string, finished_id string, quantity int")
    found = all_uses(hub.unionByName(below))
    assert found.count() == 200_001
    assert found.where("component_id = 'raw' AND finished_id = 'f77'").first().quantity == 6
