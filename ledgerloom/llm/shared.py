"""Intermediate tables in the cluster's shared folder, and helpers that several operators use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; only a local session without it gets a folder of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-llm-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """A query made and run inside frees its shuffle files when it ends; otherwise they stay until the driver happens to
    collect its garbage. A frame made inside should run once only: to run it again means to shuffle again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, name: str, group_bytes: int = 128 << 20) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: computed once, and safe when executors are lost.

    A task holds ``group_bytes`` of rows before it writes them. What the query shuffled is freed with its end.
    """
    path = new_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.option("parquet.block.size", group_bytes).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files of a ``stored`` frame that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def width(spark: SparkSession) -> int:
    """The session's shuffle partitions: how finely it wants data dealt out."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_rows(docs: DataFrame, decide: Callable, decision: str) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, and what ``decide`` says of it (columns ``decision``): whatever ids or
    other columns a row has, its decision stays with it, and nothing is shuffled."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), *T.StructType.fromDDL(decision)])
    return rows.mapInArrow(decide, schema)


def remainder(doc_id: Column | str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``: the fold of a document. A null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % divisor


def quantiles(df: DataFrame, column: str, n: int) -> list:
    """At most ``n - 1`` ascending cut values that deal ``column`` into about equal ranges; a frequent value repeats."""
    if n < 2:
        return []
    cuts = F.percentile_approx(column, [i / n for i in range(1, n)], max(10_000, 20 * n))
    return list(df.agg(cuts.alias("cuts")).first().cuts or [])
