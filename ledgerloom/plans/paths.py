"""All ancestors in a directed graph of parts, with quantities multiplied along every path, or only what is reached.

Joins here ask for a merge join: a side that happens to be below the broadcast threshold would pass through the driver
again at every level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.lineage import materialize, stored

QUANTITY = "decimal(38,6)"


def cyclic_uses(bom: DataFrame) -> DataFrame:
    """The uses (component_id, finished_id) that lie on a cycle or between two: what is left when uses of parts that
    nothing goes into, and uses in parts that go into nothing, are taken away again and again."""
    left = materialize(bom.select("component_id", "finished_id").distinct())
    number = left.count()
    while number:
        made = left.select(F.col("finished_id").alias("component_id")).distinct()
        used = left.select(F.col("component_id").alias("finished_id")).distinct()
        left = materialize(left.join(made.hint("merge"), "component_id", "left_semi").join(used.hint("merge"), "finished_id", "left_semi").select("component_id", "finished_id"))
        before, number = number, left.count()
        if number == before:
            break
    return left


def all_uses(bom: DataFrame) -> DataFrame:
    """For every part and everything it goes into, directly or through others: ``quantity`` of the part in one of it,
    ``paths`` that lead there, ``first_level`` and ``last_level`` (the shortest and longest of them).

    ``bom`` has component_id, finished_id and quantity; repeated uses add up. Uses of ``cyclic_uses`` are left out. A
    level merges all paths that meet in a part before the next begins, so the work follows pairs, not paths; its rows are
    checkpointed, as the next level reads them twice.
    """
    uses = bom.groupBy("component_id", "finished_id").agg(F.sum(F.col("quantity").cast(QUANTITY)).cast(QUANTITY).alias("quantity"))
    uses = materialize(uses.join(cyclic_uses(bom).hint("merge"), ["component_id", "finished_id"], "left_anti"))
    step = uses.select(F.col("component_id").alias("_at"), F.col("finished_id").alias("_next"), F.col("quantity").alias("_by"))
    frontier = uses.withColumn("paths", F.lit(1).cast("bigint"))
    found, level = None, 1
    while not frontier.isEmpty():
        marked = frontier.withColumn("level", F.lit(level))
        found = marked if found is None else found.unionByName(marked)
        frontier = frontier.join(step.hint("merge"), F.col("finished_id") == F.col("_at")).groupBy("component_id", F.col("_next").alias("finished_id"))
        frontier = materialize(frontier.agg(F.sum((F.col("quantity") * F.col("_by")).cast(QUANTITY)).cast(QUANTITY).alias("quantity"), F.sum("paths").alias("paths")))
        level += 1
    if found is None:
        found = frontier.withColumn("level", F.lit(0))
    return found.groupBy("component_id", "finished_id").agg(
        F.sum("quantity").cast(QUANTITY).alias("quantity"), F.sum("paths").alias("paths"), F.min("level").alias("first_level"), F.max("level").alias("last_level")
    )


def reached(starts: DataFrame, key: str, bom: DataFrame, bits: str | None = None) -> list[DataFrame]:
    """For each level of ``bom`` the distinct (``key``, product_id) that the pairs of ``starts`` go into by that many uses;
    uses of ``cyclic_uses`` are left out.

    What several products of a key go into is followed once, so a level has at most keys times parts of that level, where
    pairing every start with everything above it would count each meeting path again. A level is written before the next.
    Rows may stand for several keys: those of the bits set in the column ``bits``. What meets in a part is then united.
    """
    uses = bom.select("component_id", "finished_id").distinct()
    uses = materialize(uses.join(cyclic_uses(bom).hint("merge"), ["component_id", "finished_id"], "left_anti"))
    step = uses.select(F.col("component_id").alias("_at"), F.col("finished_id").alias("_next"))
    carried = [] if bits is None else [bits]
    levels, frontier = [], starts.select(key, "product_id", *carried)
    while True:
        up = frontier.join(step.hint("merge"), F.col("product_id") == F.col("_at"))
        up = up.select(key, F.col("_next").alias("product_id"), *carried)
        frontier = stored(up.distinct() if bits is None else up.groupBy(key, "product_id").agg(F.bit_or(bits).alias(bits)))
        if frontier.isEmpty():
            return levels
        levels.append(frontier)
