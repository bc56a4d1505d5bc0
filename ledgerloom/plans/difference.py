"""What changed between two versions of a table, as multisets of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that ``new`` has more often than ``old`` (``change`` 'added') or less often ('removed'), with ``copies``: how
    many more or less. The same rows as EXCEPT ALL in both directions, each once.

    Both versions are reduced to counts per 128-bit row hash, so unchanged rows move as two numbers. Only rows whose
    hash count differs are compared column by column. Nulls equal nulls. Columns are matched by name; a column that only
    one version has is null in the other.
    """
    names = [*old.columns, *(c for c in new.columns if c not in old.columns)]
    both = old.withColumn("_sign", F.lit(-1)).unionByName(new.withColumn("_sign", F.lit(1)), allowMissingColumns=True)
    # A field that is null leaves a row hash as it is, so which ones are null is hashed too.
    nulls = [F.col(f"`{c}`").isNull() for c in names]
    columns = [F.col(f"`{c}`") for c in names]
    both = both.withColumn("_h1", F.xxhash64(*columns, *nulls)).withColumn("_h2", F.xxhash64(F.lit("second"), *nulls, *reversed(columns)))
    differing = both.groupBy("_h1", "_h2").agg(F.sum("_sign").alias("_n")).where("_n != 0").select("_h1", "_h2")
    rows = both.join(differing, ["_h1", "_h2"], "left_semi")
    counted = rows.groupBy(*columns).agg(F.sum("_sign").alias("_n")).where("_n != 0")
    return counted.select(*columns, F.when(F.col("_n") > 0, "added").otherwise("removed").alias("change"), F.abs("_n").alias("copies"))
