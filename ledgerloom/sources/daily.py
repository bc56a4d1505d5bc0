"""Daily states on disk: one partition per day, of which only the days that changed are computed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.states import KPI_STATE, SOURCES, kpi_from_states, kpi_state, sales_state
from ledgerloom.tables import Tables


class DailyStates:
    """Kept states below ``path``: ``kpi`` (what each day adds to the headline figures) and ``sales`` (sums and sketches).

    A refresh replaces the partitions of its days and leaves all others; days that have no rows any more are replaced by
    nothing. One refresh runs at a time; readers should start after it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _replace(self, states: DataFrame, name: str, by: list[str], days: list[str] | None) -> None:
        writer = states.write.mode("overwrite").partitionBy(*by)
        if days is not None:
            writer = writer.option("partitionOverwriteMode", "dynamic")
        writer.parquet(f"{self.path}/{name}")

    def refresh(self, t: Tables, days: list[str] | None = None) -> None:
        """Computes the states of ``days`` (all days without it) and stores them. Facts are filtered by date first, so a
        table that is partitioned by its date reads those days only. A ledger without dates has one state without a day,
        which only a refresh of all days renews."""
        kpi, sales = kpi_state(t, days), None
        if t.has("sales_transactions"):
            facts = t["sales_transactions"]
            chosen = facts if days is None else facts.where(F.col("transaction_date").isin([F.lit(d).cast("date") for d in days]))
            sales = sales_state(Tables(self.spark, {"sales_transactions": chosen}))
        if days is not None:
            # A day without rows becomes an empty state, which replaces what was there.
            spine = self.spark.createDataFrame([(d,) for d in days], "day string").select(F.col("day").cast("date"))
            sources = F.array(*(F.lit(s) for s in SOURCES if t.has(s)))
            kpi = spine.withColumn("source", F.explode(sources)).join(kpi, ["source", "day"], "left")
            kpi = kpi.withColumn("row_count", F.coalesce("row_count", F.lit(0).cast("bigint")))
            if sales is not None:
                sales = spine.withColumnRenamed("day", "transaction_date").join(sales, "transaction_date", "left")
        self._replace(kpi, "kpi", ["source", "day"], days)
        if sales is not None:
            self._replace(sales, "sales", ["transaction_date"], days)

    def kpi_states(self) -> DataFrame:
        found = self.spark.read.schema(KPI_STATE).parquet(f"{self.path}/kpi")
        return found.where("row_count > 0")

    def sales_states(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/sales").where("products IS NOT NULL")

    def kpi_summary(self) -> DataFrame:
        """The cash conversion cycle from the stored states; no fact is read."""
        return kpi_from_states(self.kpi_states())


def days_of(rows: DataFrame, column: str) -> list[str]:
    """The days that uploaded rows touch, for ``refresh``; at most one a calendar day."""
    days = rows.select(F.col(column).cast("date").cast("string").alias("day")).where("day IS NOT NULL").distinct()
    return sorted(r["day"] for r in days.collect())
