"""Materialising an intermediate result where the rest of the plan must not recompute it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _with_folder(df: DataFrame) -> None:
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="ledgerloom-checkpoint-")
        sc.setCheckpointDir(folder)


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names in ``spark.checkpoint.dir``.

    Files outlive executors, so a lost executor never forces a recomputation
    that could place rows differently. Only a local session without the
    setting gets a folder of its own.
    """
    _with_folder(df)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``materialize``, but as a table of compressed columns, for results with as many rows as the facts."""
    _with_folder(df)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
