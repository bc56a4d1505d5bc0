"""Ordered computations per key over time, with every key split over slices of time.

A window per key puts all rows of a key into one task, however many it has. Here a row of a large key (one with more rows
than a slice has on average) belongs to (key, slice), where slices are cut at quantiles of the time over all rows, and what
crosses a slice border is handed over as additional rows: the state or sum before a slice, or a key's neighbouring rows.
Those are computed from one row per large key and slice that occur. All other keys fit into a task and stay whole, so that
nothing is handed over for them. No checkpoint is needed: the cuts and the large keys are one scalar that a plan computes
once. The large keys come from a sketch; whether a key is split makes no difference to the result.

Times are dates, timestamps or numbers without nulls; rows without a time belong to no timeline and are left out.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.plans.cuts import cuts_upto


def slices_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _number(time: Column, kind: str) -> Column:
    """A time as a number in the same order."""
    if kind == "date":
        return F.unix_date(time).cast("long")
    return F.unix_micros(time) if kind == "timestamp" else time


def with_slices(df: DataFrame, keys: list[str], time: str, slices: int | None = None) -> DataFrame:
    """``df`` with ``_hot``, whether the row's key is large, and ``_slice``: for large keys how many of the cuts are not
    after the row's time, for others 0. Cuts are quantiles of all rows."""
    n = slices or slices_of(df)
    at = _number(F.col(time), df.schema[time].dataType.typeName())
    df = df.where(F.col(time).isNotNull())
    if n < 2:
        return df.withColumn("_hot", F.lit(False)).withColumn("_slice", F.lit(0))
    shares = [i / n for i in range(1, n)]
    accuracy = max(10_000, 20 * n)
    # Keys are told apart by a hash here: two that share one are merely split together.
    key = F.xxhash64(*keys) if keys else F.lit(0).cast("long")
    tracked = min(1_000_000, accuracy)
    seen = df.select(at.alias("at"), key.alias("key")).agg(
        F.percentile_approx("at", shares, accuracy).alias("cuts"),
        F.expr(f"approx_top_k(key, {min(n, tracked)}, {tracked})").alias("top"),
        F.count(F.lit(1)).alias("rows"),
    )
    large = F.transform(F.filter("top", lambda x: x["count"] > F.col("rows") / n), lambda x: x["item"])
    found = seen.select(F.struct("cuts", large.alias("hot")).alias("found")).scalar()
    df = df.withColumn("_hot", F.coalesce(F.array_contains(found["hot"], key), F.lit(False))).withColumn("_cuts", found["cuts"])
    return df.withColumn("_slice", F.when(F.col("_hot"), cuts_upto(F.col("_cuts"), at, n - 1)).otherwise(0)).drop("_cuts")


def _before(keys: list[str], first: int | None = None) -> Window:
    """The earlier slices of a key: at most one row per slice."""
    return Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding if first is None else -first, -1)


def last_known(
    events: DataFrame,
    states: DataFrame,
    keys: list[str],
    event_time: str,
    state_time: str,
    values: list[str],
    strict: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """As-of join: every row of ``events`` with ``state_time`` and ``values`` of its key's last state not after it.

    With ``strict`` only states before the event count. Events without a state get nulls, events without a time too.
    Among states of one key and time the greatest ``values`` count. Both tables are merged in one order, so events
    and states meet in a single shuffle by key and slice; a null key is a key like any other.
    """
    state = F.struct(F.col(state_time).alias("_known"), *values)
    own = F.struct(*(F.col(c) for c in events.columns))
    nothing = F.lit(None)
    # Where times agree, states stand before events, or behind them if only earlier ones count.
    placed = events.select(*keys, F.col(event_time).alias("_time"), F.lit(0).alias("_rank"), own.alias("_event"), nothing.cast(states.select(state).schema[0].dataType).alias("_state"))
    known = states.select(*keys, F.col(state_time).alias("_time"), F.lit(1 if strict else -1).alias("_rank"), nothing.cast(events.select(own).schema[0].dataType).alias("_event"), state.alias("_state"))
    merged = with_slices(placed.unionByName(known), keys, "_time", slices)
    # The greatest state struct of a slice is its last: the time comes first in it.
    heads = merged.where("_hot").groupBy(*keys, "_slice").agg(F.max("_state").alias("_own"))
    carried = heads.withColumn("_state", F.last("_own", ignorenulls=True).over(_before(keys))).where("_state IS NOT NULL")
    carried = carried.select(
        *keys, F.lit(None).cast(merged.schema["_time"].dataType).alias("_time"), F.lit(-2).alias("_rank"),
        F.lit(None).cast(merged.schema["_event"].dataType).alias("_event"), "_state", "_slice",
    )
    order = [F.col("_time").asc_nulls_first(), F.col("_rank"), F.col("_state").asc_nulls_first()]
    so_far = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = merged.drop("_hot").unionByName(carried).withColumn("_state", F.last("_state", ignorenulls=True).over(so_far))
    found = found.where("_event IS NOT NULL").select("_event.*", F.col("_state._known").alias(state_time), *(F.col(f"_state.{v}").alias(v) for v in values))
    timeless = events.where(F.col(event_time).isNull())
    return found.unionByName(timeless, allowMissingColumns=True)


def _wide(df: DataFrame, amount: Column) -> T.DataType:
    """A type for sums of ``amount`` that do not outgrow it."""
    kind = df.select(amount).schema[0].dataType
    if isinstance(kind, T.DecimalType):
        return T.DecimalType(38, kind.scale)
    return T.LongType() if isinstance(kind, T.IntegralType) else T.DoubleType()


def running(
    df: DataFrame,
    keys: list[str],
    time: str,
    sums: Mapping[str, Column],
    ties: list[Column] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """``df`` with running sums per key in the order of ``time`` and ``ties``; rows that agree in both are in any order.

    ``sums`` maps a name to what is added up. Each slice of a large key starts from one row that holds the sums before it.
    """
    ties = ties or []
    amounts = {f"_a_{name}": amount.cast(_wide(df, amount)) for name, amount in sums.items()}
    rows = with_slices(df, keys, time, slices)
    rows = rows.select(*df.columns, "_hot", "_slice", *(a.alias(n) for n, a in amounts.items()), *(c.alias(f"_t{i}") for i, c in enumerate(ties)), F.lit(1).alias("_own"))
    heads = rows.where("_hot").groupBy(*keys, "_slice").agg(*(F.sum(n).alias(f"{n}_slice") for n in amounts))
    carried = heads.select(*keys, "_slice", *(F.sum(f"{n}_slice").over(_before(keys)).cast(rows.schema[n].dataType).alias(n) for n in amounts), F.lit(0).alias("_own"))
    order = ["_own", time, *(f"_t{i}" for i in range(len(ties)))]
    so_far = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    merged = rows.drop("_hot").unionByName(carried, allowMissingColumns=True)
    merged = merged.select(*df.columns, "_own", *(F.coalesce(F.sum(f"_a_{name}").over(so_far), F.lit(0)).alias(name) for name in sums))
    return merged.where("_own = 1").drop("_own")


def with_neighbours(df: DataFrame, keys: list[str], time: str, ties: list[str], before: int = 0, after: int = 0, slices: int | None = None) -> DataFrame:
    """``df`` with ``_slice`` and ``_own``, and next to each slice of a large key copies (``_own`` false) of the key's last
    ``before`` rows ahead of it and first ``after`` rows behind it.

    Any window partitioned by the keys and ``_slice``, ordered by ``time`` and ``ties`` (which must be a total order), that
    looks no further than that is then right for the rows with ``_own``.
    """
    placed = with_slices(df, keys, time, slices).withColumn("_own", F.lit(True))
    rows, split = placed.drop("_hot"), placed.where("_hot").drop("_hot")
    inside = Window.partitionBy(*keys, "_slice")
    out, order = rows, [time, *ties]
    row = F.struct(*order, *(c for c in df.columns if c not in order)).alias("_row")
    for forward, k in ((True, before), (False, after)):
        if not k:
            continue
        sort = [F.col(c).desc() if forward else F.col(c).asc() for c in order]
        edge = split.withColumn("_n", F.row_number().over(inside.orderBy(*sort))).where(F.col("_n") <= k)
        # At most k rows per key and slice; each occurring slice has one, so k slices hold all that is needed.
        edges = edge.groupBy(*keys, "_slice").agg(F.collect_list(row).alias("_edge"))
        near = Window.partitionBy(*keys).orderBy("_slice" if forward else F.desc("_slice")).rowsBetween(-k, -1)
        gathered = edges.withColumn("_near", F.sort_array(F.flatten(F.collect_list("_edge").over(near)), asc=not forward))
        handed = gathered.select("_slice", F.explode(F.slice("_near", 1, k)).alias("_row")).select("_slice", "_row.*", F.lit(False).alias("_own"))
        out = out.unionByName(handed)
    return out


def inside_slices(keys: list[str], time: str, ties: list[str]) -> Window:
    """The window for what ``with_neighbours`` returns."""
    return Window.partitionBy(*keys, "_slice").orderBy(time, *ties)
