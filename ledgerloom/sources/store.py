"""A folder of parquet tables where every upload is a new version.

A version becomes visible by its line in the upload log, which is written
last: readers see the old table or the new one, never half of either.
"""

from __future__ import annotations

import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.catalog import database_status, versions_as_of
from ledgerloom.operators.overview import kpi_record
from ledgerloom.plans.difference import changes
from ledgerloom.schema import KPI_HISTORY, LEGACY_TABLES, TABLES, UPLOAD_LOG
from ledgerloom.sources.files import BAD_CELLS, CORRUPT, RejectedFile, bad_row, check_required, file_size, read_csv, table_spec
from ledgerloom.tables import Tables


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- paths ---------------------------------------------------------------

    @property
    def _log_path(self) -> str:
        return f"{self.root}/_uploads"

    @property
    def _kpi_path(self) -> str:
        return f"{self.root}/_kpi_daily"

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), target

    def _exists(self, path: str) -> bool:
        fs, target = self._fs(path)
        return fs.exists(target)

    def _delete(self, path: str) -> None:
        fs, target = self._fs(path)
        fs.delete(target, True)

    # -- writing -------------------------------------------------------------

    def replace(self, df: DataFrame, category: str, filename: str = "") -> int:
        """Makes ``df`` the content of a table; returns its number of rows.

        ``REBALANCE`` gathers the rows of a partition value into few files, and
        splits a value that holds many rows over several tasks.
        """
        return self._write(df, category, filename, bad=F.lit(False), on_error="fail")

    def ingest_csv(
        self, path: str, category: str, filename: str | None = None, on_error: str = "fail", multi_line: bool = False
    ) -> int:
        """Loads a CSV file. ``on_error``: 'fail' rejects the file if any cell or
        line does not fit, 'null' keeps such rows with those cells empty."""
        if on_error not in ("fail", "null"):
            raise ValueError("on_error must be 'fail' or 'null'")
        table_spec(category)
        df = read_csv(self.spark, path, category, multi_line)
        return self._write(df, category, filename or path.rsplit("/", 1)[-1], bad_row(), on_error)

    def _write(self, df: DataFrame, category: str, filename: str, bad, on_error: str) -> int:
        spec = table_spec(category)
        check_required(df, category)
        version = time.time_ns() // 1000
        target = f"{self.root}/{category}/version={version}-{uuid.uuid4().hex[:8]}"
        seen = Observation(f"ingest-{category}-{version}")
        counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad"))
        kept = counted.drop(BAD_CELLS, CORRUPT)
        partition = [c for c in spec.partition_by if c in kept.columns]
        if partition:
            kept = kept.hint("rebalance", *(F.col(c) for c in partition))
        kept.write.partitionBy(*partition).parquet(target)
        rows, wrong = seen.get["rows"], seen.get["bad"]
        if wrong and on_error == "fail":
            self._delete(target)
            raise RejectedFile(f"{category}: {wrong} of {rows} rows do not fit the declared types")
        self._log(category, filename, rows, target)
        return rows

    def _log(self, category: str, filename: str, rows: int, path: str) -> None:
        # The line is numbered and dated when the rows are all there: a version never becomes visible before its time.
        now = time.time_ns() // 1000
        line = (now, category, filename, datetime.fromtimestamp(now / 1e6, timezone.utc), rows, "uploaded", path)
        self.spark.createDataFrame([line], UPLOAD_LOG).coalesce(1).write.mode("append").parquet(self._log_path)

    def append_kpi(self, date: str | None = None) -> None:
        """Adds today's (or a given day's) headline figures to the KPI history."""
        kpi_record(self.tables(), date).write.mode("append").parquet(self._kpi_path)

    # -- reading -------------------------------------------------------------

    def upload_log(self) -> DataFrame | None:
        return self.spark.read.schema(UPLOAD_LOG).parquet(self._log_path) if self._exists(self._log_path) else None

    def kpi_history(self) -> DataFrame | None:
        return self.spark.read.schema(KPI_HISTORY).parquet(self._kpi_path) if self._exists(self._kpi_path) else None

    def _paths(self, as_of: datetime | int | None = None) -> dict[str, str]:
        """Where each table's version lies that was the newest at ``as_of`` (a time or the id of an upload; now without
        it). The log is read once, so the versions belong together however many uploads run meanwhile."""
        log = self.upload_log()
        if log is None:
            return {}
        # At most one row per category.
        newest = versions_as_of(Tables(self.spark, {}, log), as_of, path=True).collect()
        return {r["file_category"]: r["storage_path"] for r in newest}

    def tables(self, as_of: datetime | int | None = None) -> Tables:
        """The newest version of every uploaded table, or the newest at a time or upload."""
        frames = {n: (lambda p=p: self.spark.read.parquet(p)) for n, p in self._paths(as_of).items()}
        return Tables(self.spark, frames, self.upload_log())

    def changes(self, category: str, old: datetime | int, new: datetime | int | None = None) -> DataFrame:
        """Rows a table gained and lost between two times or uploads (see ``plans.difference.changes``)."""
        return changes(self.tables(old)[category], self.tables(new)[category])

    def size_bytes(self) -> int:
        """Bytes of the current versions."""
        return sum(file_size(self.spark, p) for p in self._paths().values())

    def status(self) -> DataFrame:
        """Totals over the current versions, their size included."""
        return database_status(self.tables(), self.size_bytes())

    def reset(self, confirm: bool = False) -> None:
        """Deletes every table, the log and the KPI history."""
        if not confirm:
            raise ValueError("reset deletes all tables; pass confirm=True")
        # The log goes first, so that nothing half deleted stays visible.
        for path in (self._log_path, self._kpi_path, *(f"{self.root}/{n}" for n in TABLES)):
            if self._exists(path):
                self._delete(path)


# -- catalog tables ------------------------------------------------------------


def table_ddl(database: str | None = None, legacy: bool = False) -> list[str]:
    """CREATE TABLE statements for the declared tables, the upload log and the KPI history."""
    prefix = f"`{database}`." if database else ""
    registry = LEGACY_TABLES if legacy else TABLES
    schemas = [(spec.name, spec.schema, spec.partition_by) for spec in registry.values()]
    schemas += [
        (name, T.StructType.fromDDL(ddl), ()) for name, ddl in (("file_uploads", UPLOAD_LOG), ("kpi_daily", KPI_HISTORY))
    ]
    statements = []
    for name, schema, partition in schemas:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by = f" PARTITIONED BY ({', '.join(partition)})" if partition else ""
        statements.append(f"CREATE TABLE IF NOT EXISTS {prefix}`{name}` ({columns}) USING parquet{by}")
    return statements


def create_tables(spark: SparkSession, database: str | None = None, legacy: bool = False) -> None:
    for statement in table_ddl(database, legacy):
        spark.sql(statement)


def save_table(df: DataFrame, category: str, database: str | None = None) -> None:
    """Replaces a catalog table by ``df``."""
    spec = table_spec(category)
    check_required(df, category)
    partition = [c for c in spec.partition_by if c in df.columns]
    if partition:
        df = df.hint("rebalance", *(F.col(c) for c in partition))
    writer = df.write.mode("overwrite").format("parquet").partitionBy(*partition)
    writer.saveAsTable(f"`{database}`.`{category}`" if database else f"`{category}`")


def drop_tables(spark: SparkSession, database: str | None = None, confirm: bool = False) -> list[str]:
    """Drops the declared tables that exist; returns their names."""
    if not confirm:
        raise ValueError("this drops tables; pass confirm=True")
    prefix = f"`{database}`." if database else ""
    found = [n for n in (*TABLES, "file_uploads", "kpi_daily") if spark.catalog.tableExists(f"{prefix}`{n}`")]
    for name in found:
        spark.sql(f"DROP TABLE IF EXISTS {prefix}`{name}`")
    return found
