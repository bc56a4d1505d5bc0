"""For every item, the best members of a pool that the item does not have yet.

Comparing every item with the whole pool is avoided: an item lacks at least
``k`` of the first ``shortlist`` members unless it has nearly all of them, so
its bounded set of held positions decides. Items that do hold nearly all of
the shortlist are answered exactly from their positions in the whole pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.lineage import materialize
from ledgerloom.plans.order import global_rank
from ledgerloom.plans.totals import bounded


def best_absent(
    holdings: DataFrame,
    pool: DataFrame,
    order: list[Column],
    item: str,
    member: str,
    items: DataFrame | None = None,
    group: str | None = None,
    k: int = 5,
    shortlist: int = 512,
) -> DataFrame:
    """Rows of ``pool`` (plus ``item`` and ``choice`` 1..k) each item lacks, best first.

    ``holdings``: (item, member[, group]) pairs, repeats allowed.
    ``pool``: members with their attributes, unique per (group, member).
    ``items``: (item[, group]), unique by item; default: the items that hold something.
    ``order`` must be total per group.
    """
    by = [group] if group else []
    if shortlist < k:
        raise ValueError("the shortlist must hold at least k members")

    if group:
        first = Window.partitionBy(group).orderBy(*order)
        short = pool.withColumn("position", F.row_number().over(first)).where(F.col("position") <= shortlist)
        short = materialize(short)
        lookup, marks = short, short.select(group, member, "position")
    else:
        # At most `shortlist` rows, so one task may number them.
        short = pool.orderBy(*order).limit(shortlist)
        short = materialize(short.withColumn("position", F.row_number().over(Window.orderBy(*order))))
        lookup, marks = bounded(short, shortlist), bounded(short.select(member, "position"), shortlist)

    # Hashing removes repeats first, so an item gathers at most `shortlist`
    # numbers, however many holdings it has.
    held = (
        holdings.join(marks, [*by, member], "left")
        .select(*by, item, "position")
        .distinct()
        .groupBy(*by, item)
        .agg(F.collect_list("position").alias("held"))
    )
    if items is not None:
        none = F.array().cast("array<int>")
        held = items.join(held, [*by, item], "left").withColumn("held", F.coalesce("held", none))
    state = materialize(held)

    if group:
        sizes = short.groupBy(group).agg(F.max("position").cast("int").alias("listed"))
        state_sized = state.join(sizes, group)
    else:
        state_sized = state.withColumn("listed", short.agg(F.max("position").cast("int")).scalar())
    state_sized = state_sized.where(F.col("listed") >= 1)

    nearly_all = (F.col("listed") == shortlist) & (F.size("held") > shortlist - k)
    # Of the first (number held + k) positions at least k are free: no need to look further.
    reach = F.least(F.col("listed"), F.size("held") + k)
    free = F.slice(F.array_except(F.sequence(F.lit(1), reach), "held"), 1, k)
    simple = (
        state_sized.where(~nearly_all)
        .select(*by, item, F.posexplode(free).alias("choice", "position"))
        .withColumn("choice", F.col("choice") + 1)
        .join(lookup, [*by, "position"])
    )
    columns = [*by, item, "choice", *(c for c in pool.columns if c not in by)]
    simple = simple.select(*columns)
    rest = state_sized.where(nearly_all).select(*by, item)
    if rest.isEmpty():
        return simple
    exact = _from_whole_pool(holdings, pool, rest, order, item, member, by, k, shortlist)
    return simple.unionByName(exact.select(*columns))


def _from_whole_pool(holdings, pool, items, order, item, member, by, k, block_size) -> DataFrame:
    """The exact way for items holding almost the whole shortlist.

    Positions are grouped into blocks of ``block_size``. Per item and block the
    free positions are known from a bounded set; blocks the item holds nothing
    of are free as a whole. The window per item sees blocks, not holdings.
    """
    ranked = global_rank(pool, [*(F.col(g).asc() for g in by), *order])
    if by:
        starts = ranked.groupBy(*by).agg(F.min("position").alias("_start"), F.count(F.lit(1)).alias("_size"))
        ranked = ranked.join(starts, by).withColumn("position", F.col("position") - F.col("_start") + 1).drop("_start")
    else:
        ranked = ranked.withColumn("_size", pool.agg(F.count(F.lit(1))).scalar())

    block = F.floor((F.col("position") - 1) / block_size)
    held = (
        holdings.join(items, [*by, item], "left_semi")
        .select(*by, item, member)
        .distinct()
        .join(ranked.select(*by, member, "position", "_size"), [*by, member])
        .groupBy(*by, item, "_size", block.alias("_block"))
        .agg(F.collect_list("position").alias("_held"))
    )

    def positions(number: Column) -> Column:
        return F.sequence(number * block_size + 1, F.least((number + 1) * block_size, F.col("_size")))

    none = F.array().cast("array<bigint>")
    in_order = Window.partitionBy(*by, item).orderBy("_block")
    current, previous = F.col("_block"), F.col("_previous")
    free = (
        held.withColumn("_free", F.array_except(positions(current), "_held"))
        .select(
            *by,
            item,
            "_size",
            "_block",
            "_free",
            F.lag("_block", 1, -1).over(in_order).alias("_previous"),
            F.lead("_block").over(in_order).alias("_next"),
            F.sum(F.size("_free")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)).alias("_found"),
        )
        .where(F.coalesce("_found", F.lit(0)) < k)
    )
    untouched_before = F.when(current > previous + 1, positions(previous + 1))
    untouched_after = F.when(
        F.col("_next").isNull() & ((current + 1) * block_size < F.col("_size")), positions(current + 1)
    )
    candidates = F.concat(
        *(F.slice(F.coalesce(part, none), 1, k) for part in (untouched_before, F.col("_free"), untouched_after))
    )
    best_first = Window.partitionBy(*by, item).orderBy("position")
    chosen = (
        free.select(*by, item, F.explode(candidates).alias("position"))
        .withColumn("choice", F.row_number().over(best_first))
        .where(F.col("choice") <= k)
    )
    return chosen.join(ranked.drop("_size"), [*by, "position"])
