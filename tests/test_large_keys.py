"""Timelines of large keys are split over slices of time, those of others stay whole."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.plans.timeline import inside_slices, last_known, running, with_neighbours, with_slices


def _rows(spark):
    """A key (null) with a third of the rows, and many keys of a few."""
    rng = random.Random(8)
    keys = [None if i % 3 == 0 else f"k{rng.randrange(300)}" for i in range(3000)]
    return spark.createDataFrame([(k, rng.randrange(500), i) for i, k in enumerate(keys)], "k string, t int, id int")


def test_only_large_keys_are_split(spark):
    placed = with_slices(_rows(spark), ["k"], "t", slices=10)
    slices = {r.k: r.n for r in placed.groupBy("k").agg(F.count_distinct("_slice").alias("n")).collect()}
    assert slices.pop(None) == 10 and set(slices.values()) == {1}


def test_split_or_whole_the_results_are_the_same(spark):
    df = _rows(spark)
    whole = Window.partitionBy("k").orderBy("t", "id")
    for slices in (1, 10, 200):
        sums = running(df, ["k"], "t", {"s": F.col("id")}, [F.col("id")], slices=slices)
        assert sorted(map(str, sums.collect())) == sorted(map(str, df.withColumn("s", F.sum("id").over(whole)).collect()))
        near = with_neighbours(df, ["k"], "t", ["id"], before=2, after=1, slices=slices)
        order = inside_slices(["k"], "t", ["id"])
        near = near.withColumn("a", F.lag("id", 2).over(order)).withColumn("b", F.lead("id").over(order)).where("_own")
        expected = df.withColumn("a", F.lag("id", 2).over(whole)).withColumn("b", F.lead("id").over(whole))
        assert sorted(map(str, near.select("k", "t", "id", "a", "b").collect())) == sorted(map(str, expected.collect()))
        states = df.where("id % 7 = 0").groupBy("k", F.col("t").alias("at")).agg(F.max("id").alias("v"))
        for strict in (False, True):
            found = last_known(df, states, ["k"], "t", "at", ["v"], strict, slices=slices).collect()
            known = {}
            for r in states.collect():
                known.setdefault(r.k, []).append((r.at, r.v))
            for r in found:
                before = [x for x in known.get(r.k, []) if x[0] < r.t or (x[0] == r.t and not strict)]
                assert (r.at, r.v) == (max(before) if before else (None, None))
