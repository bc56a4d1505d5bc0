"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. On each level every child draws ``-ln(u) / weight`` from a hash of the row's key
and the child's name, and the smallest draw wins, so a child wins in proportion to its weight. The draws of the other
children do not depend on it: when a weight changes, rows move only to or from the subtree whose weight changed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.shared import stored

Tree = Mapping[str, "Tree | tuple[int, float]"]  # leaf: (shard number, weight)


def weight(node: Tree | tuple[int, float]) -> float:
    return float(node[1]) if isinstance(node, tuple) else sum(map(weight, node.values()))


def balanced_tree(shards: int, racks: int = 2, per_rack: int = 2) -> dict:
    """Regions of ``racks`` racks with ``per_rack`` shards of weight 1 each; the last region takes what is left."""
    tree: dict = {}
    for i in range(shards):
        rack, region = i // per_rack, i // (per_rack * racks)
        tree.setdefault(f"region{region}", {}).setdefault(f"rack{rack}", {})[f"shard{i}"] = (i, 1.0)
    return tree


def grown(tree: Tree, shard: int, weight: float = 1.0) -> dict:
    """``tree`` with one more shard in a region of its own: rows move into the new shard only, from everywhere."""
    return {**tree, f"region-of-{shard}": {f"rack-of-{shard}": {f"shard{shard}": (shard, weight)}}}


def _draw(key: Column, path: str, share: float) -> Column:
    # 52 bits of the hash, never zero.
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(path), key), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.lit(share)


def place(key: Column, tree: Tree, path: str = "") -> Column:
    """The shard number of ``key``. Nodes of weight 0 get nothing."""
    children = {f"{path}/{name}": node for name, node in tree.items() if weight(node) > 0}
    if not children:
        raise ValueError("a tree needs a shard with a weight above 0")
    inside = {p: F.lit(n[0]) if isinstance(n, tuple) else place(key, n, p) for p, n in children.items()}
    if len(inside) == 1:
        return next(iter(inside.values()))
    draws = [F.struct(_draw(key, p, weight(n)).alias("draw"), F.lit(i).alias("child")) for i, (p, n) in enumerate(children.items())]
    won = F.array_min(F.array(*draws))["child"]
    chosen = None
    for i, target in enumerate(inside.values()):
        chosen = F.when(won == i, target) if chosen is None else chosen.when(won == i, target)
    return chosen


def shard_rows(df: DataFrame, key: str, tree: Tree, larger: Tree | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``df``: key, the ``extra`` columns, shard, slot and, with a ``larger`` tree, grown_shard.

    The key alone decides the shard; rows with equal keys (null is a key too) share one. Slots count from 0 without gaps
    in each shard. They are numbered within (shard, scan task) and shifted by the counts of the tasks before, so a shard
    that holds most rows is still numbered by many tasks, and only narrow rows are shuffled.
    """
    hashed = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    columns = {key: F.col(key), **(extra or {})}
    placed = df.select(
        *[c.alias(n) for n, c in columns.items()],
        place(hashed, tree).cast("int").alias("shard"),
        (place(hashed, larger).cast("int") if larger else F.lit(None).cast("int")).alias("grown_shard"),
        F.spark_partition_id().alias("_task"),
        F.monotonically_increasing_id().alias("_row"),
    )
    placed = stored(placed, "shards")
    before = W.partitionBy("shard").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "_task")
        .count()
        .select("shard", "_task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(W.partitionBy("shard", "_task").orderBy("_row")) - 1
    return (
        placed.withColumn("_inside", inside)
        .join(offsets, ["shard", "_task"])
        .select(*columns, "shard", (F.col("_offset") + F.col("_inside")).alias("slot"), "grown_shard")
    )
