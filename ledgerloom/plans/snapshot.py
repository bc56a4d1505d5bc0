"""The current state of a periodic snapshot table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_snapshot(inventory: DataFrame) -> DataFrame:
    """Rows of the newest ``snapshot_date``.

    The scalar subquery becomes a partition filter at run time when the table
    is partitioned by that column; the maximum itself reads no data columns.
    """
    newest = inventory.agg(F.max("snapshot_date")).scalar()
    return inventory.where(F.col("snapshot_date") == newest)
