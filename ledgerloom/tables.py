"""Access to the nine tables by name, whatever they are stored in."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.schema import TABLE_NAMES


class MissingTable(LookupError):
    """A question needs a table that has not been loaded."""


class Tables:
    """The loaded subset of the nine tables.

    A value is a DataFrame or a function returning one; functions are called
    at first use, so a question touches only the tables it reads.
    """

    def __init__(
        self,
        spark: SparkSession,
        frames: Mapping[str, DataFrame | Callable[[], DataFrame]],
        upload_log: DataFrame | None = None,
    ):
        unknown = set(frames) - set(TABLE_NAMES)
        if unknown:
            raise ValueError(f"unknown tables {sorted(unknown)}; expected some of {list(TABLE_NAMES)}")
        self.spark = spark
        self.upload_log = upload_log
        self._frames = dict(frames)

    def has(self, name: str) -> bool:
        return name in self._frames

    @property
    def names(self) -> list[str]:
        return [n for n in TABLE_NAMES if n in self._frames]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            raise MissingTable(f"table {name!r} is not loaded; loaded: {self.names}")
        frame = self._frames[name]
        if not isinstance(frame, DataFrame):
            frame = self._frames[name] = frame()
        return frame

    def only(self, *names: str) -> Tables:
        """The same tables restricted to some names."""
        return Tables(self.spark, {n: self._frames[n] for n in names if n in self._frames}, self.upload_log)

    def without(self, *names: str) -> Tables:
        """The same tables with some left out."""
        return self.only(*(n for n in self._frames if n not in names))

    def create_views(self) -> None:
        """Registers every loaded table as a temporary view of its own name."""
        for name in self.names:
            self[name].createOrReplaceTempView(name)

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str | None = None) -> Tables:
        prefix = f"`{database}`." if database else ""
        loaded = [n for n in TABLE_NAMES if spark.catalog.tableExists(f"{prefix}`{n}`")]
        return cls(spark, {n: (lambda n=n: spark.table(f"{prefix}`{n}`")) for n in loaded})

    @classmethod
    def from_paths(cls, spark: SparkSession, paths: Mapping[str, str]) -> Tables:
        """Tables kept as parquet folders, one path per table."""
        return cls(spark, {n: (lambda p=p: spark.read.parquet(p)) for n, p in paths.items()})
