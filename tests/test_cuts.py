"""Slices of values and times: binary search among cuts, and large keys split while others stay whole."""

import bisect
import random

from pyspark.sql import functions as F

from ledgerloom.plans.cuts import cuts_upto
from ledgerloom.plans.ranks import quantiles_by


def test_cuts_are_found_by_halving(spark):
    rng = random.Random(5)
    for n in (1, 2, 3, 7, 8, 100):
        cuts = sorted(rng.randrange(50) for _ in range(n))
        df = spark.createDataFrame([(x, cuts) for x in [*range(-1, 52), None]], "x int, cuts array<int>")
        rows = df.select("x", cuts_upto(F.col("cuts"), F.col("x"), n).alias("upto"), cuts_upto(F.col("cuts"), F.col("x"), n, strict=True).alias("below")).collect()
        for r in rows:
            assert r.upto == (0 if r.x is None else bisect.bisect_right(cuts, r.x))
            assert r.below == (0 if r.x is None else bisect.bisect_left(cuts, r.x))


def test_quantiles_over_many_slices(spark):
    """A row looks at the logarithm of the number of cuts: no function goes over all of them."""
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.randrange(1000)) for _ in range(3000)] + [("a", None), (None, 7)]
    found = quantiles_by(spark.createDataFrame(rows, "g string, v int"), ["g"], "v", [0.5, 0.9], slices=500)
    assert "filter(_cuts" not in found._jdf.queryExecution().analyzed().toString()
    for r in found.collect():
        of = sorted(v for g, v in rows if g == r.g and v is not None)
        assert r.members == len(of) and r.quantile == min(v for v in of if bisect.bisect_right(of, v) >= r.share * len(of))
