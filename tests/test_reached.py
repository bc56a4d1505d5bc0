"""Everything that the products of a key go into, each level followed once per key."""

import collections

from ledgerloom.operators import supplier
from ledgerloom.plans.paths import all_uses, reached


def test_levels_hold_each_pair_once(spark):
    """Many products of a supplier meet in the same parts: a level has one row for them, not one per path."""
    uses = [(f"p{i}", f"q{j}") for i in range(40) for j in range(20)] + [(f"q{j}", "top") for j in range(20)]
    uses += [("top", "end"), ("x", "y"), ("y", "x"), ("p0", "x"), ("self", "self"), ("p0", None)]
    bom = spark.createDataFrame([(a, b, 1) for a, b in uses], "component_id string, finished_id string, quantity int")
    starts = [("s1", f"p{i}") for i in range(40)] + [("s2", "q0"), ("s2", None), (None, "top"), ("s3", "end")]
    levels = reached(spark.createDataFrame(starts, "supplier_id string, product_id string"), "supplier_id", bom)
    found = [sorted(map(tuple, level.collect()), key=str) for level in levels]
    assert [len(x) for x in found] == [len(set(x)) for x in found] == [24, 2, 1]
    above = {(r.component_id, r.finished_id) for r in all_uses(bom).collect()}
    assert {p for x in found for p in x} == {(s, f) for s, p in starts for c, f in above if c == p}
    assert reached(spark.createDataFrame(starts, "supplier_id string, product_id string"), "supplier_id", bom.limit(0)) == []


def test_suppliers_that_share_parts_share_rows(spark, make, monkeypatch):
    """A level has a row per part and block of suppliers, not one per part and supplier; the figures stay those of each supplier."""
    orders = [(f"S{i:03}", f"p{(i + k) % 7}") for i in range(130) for k in range(1 + i % 3)] * 2 + [("alone", "end"), ("", "p1"), (None, "p1"), ("S001", None)]
    uses = [(f"p{i}", f"q{j}") for i in range(6) for j in range(3)] + [(f"q{j}", "top") for j in range(3)]
    uses += [("top", "end"), ("p0", "end"), ("x", "y"), ("y", "x"), ("p2", "x"), ("p3", None), ("q1", "p6")]
    price = {"p0": 1.5, "p6": 2.25, "q1": 4, "top": 8, "x": 16, "far": 32}
    t = make(
        purchase_orders=[{"supplier_id": s, "product_id": p} for s, p in orders],
        sales_transactions=[{"product_id": p, "total_revenue": v} for p, v in price.items() for _ in range(2)],
    )
    counts, real = [], supplier.reached

    def counted(*args, **kwargs):
        levels = real(*args, **kwargs)
        counts.extend(level.count() for level in levels)
        return levels

    monkeypatch.setattr(supplier, "reached", counted)
    bom = spark.createDataFrame([(a, b, 1) for a, b in uses], "component_id string, finished_id string, quantity int")
    found = {r.supplier_id: (r.supplied, r.impacted, r.revenue_at_risk) for r in supplier.ripple_all_levels(t, bom).collect()}
    above, want = collections.defaultdict(set), collections.defaultdict(set)
    for r in all_uses(bom).collect():
        above[r.component_id].add(r.finished_id)
    own = {(s, p) for s, p in orders if s and p}
    for s, p in own:
        want[s] |= {p} | above[p]
    assert found == {s: (sum(x == s for x, _ in own), len(ps), 2 * sum(price.get(p, 0) for p in ps)) for s, ps in want.items()}
    # 131 suppliers are three blocks where one task numbers them; each of at most four tasks may begin one more.
    assert counts and all(n <= 7 * 6 for n in counts), counts


def test_small_sides_are_not_sent_through_the_driver(spark):
    """A level joins without a broadcast, however small a side is."""
    bom = spark.createDataFrame([("a", "b", 2), ("b", "c", 3)], "component_id string, finished_id string, quantity int")
    plans, real = [], type(bom).checkpoint

    def checkpoint(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *args, **kwargs)

    type(bom).checkpoint = checkpoint
    try:
        assert all_uses(bom).count() == 3
    finally:
        type(bom).checkpoint = real
    assert plans and not any("Broadcast" in p for p in plans)
