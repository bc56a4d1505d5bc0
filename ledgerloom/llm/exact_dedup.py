"""Exact duplicates: equal texts after white space has been made uniform. DataFrame functions only.

Rows are grouped by a 128-bit content hash (the first half of the SHA-256 of the normalised text), the row with the
smallest id of a group stays, and the bytes inside groups are compared: the different normalised texts of a hash are
counted, after each task has merged its own copies, so a text held by very many rows moves once per task. A hash that
stands for several texts would be taken apart by the texts themselves.

Texts move once, for the comparison. Everything else works on one row of 48 bytes per document, which is written to the
shared folder first, with a row number: a number must not change when a task runs again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import stored

SPACE = r"[\x09-\x0D\x20]{2,}|[\x09-\x0D]"  # what one space replaces; a single space already is one
KEY_BYTES = 16
BROADCAST_KEYS = 100_000
LARGE = 4096


def normalised(text: Column) -> Column:
    """Every run of the six ASCII white-space characters as one space; null as empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def _judged(facts: DataFrame, by: list[str]) -> DataFrame:
    """The class of every row: rows that agree in the columns ``by``. Copies are merged before they are moved.

    Groups with at least one row in ``LARGE`` go to the rows as a broadcast of at most ``LARGE`` groups, so no task gets
    all rows of a large group; the rows of smaller ones move to their group.
    """
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    groups = facts.groupBy(*by).agg(first, F.count(F.lit(1)).alias("group_size"))
    large = F.broadcast(groups.where(F.col("group_size") * LARGE >= F.lit(facts.count())))
    placed = facts.join(large, by).unionByName(facts.join(large.select(*by), by, "left_anti").join(groups, by))
    return placed.select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("content")).alias("text_sha256"),
    )


def exact_classes(docs: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and all empty or white-space texts are copies of each other where they normalise alike
    (a text of white space only becomes one space, which differs from the empty text). Rows without an id stay only where
    no copy has one. Of rows that repeat the smallest id, or of several without any, one row stays: the first in the
    order of reading. Very long texts are compared whole. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    rows = rows.withColumn("content", F.unhex(F.sha2(F.encode("norm", "UTF-8"), 256)))
    key = F.substring("content", 1, key_bytes).alias("key")
    facts = stored(rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "content"), "exact-facts").select("*", key)
    texts = rows.select(key, "norm").distinct()
    collided = stored(texts.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("key"), "exact-collided")
    number = collided.count()
    if not number:
        return _judged(facts, ["key"])
    apart = F.broadcast(collided) if number <= BROADCAST_KEYS else collided
    mixed = rows.select("doc_id", "norm", "content", key).join(apart, "key", "left_semi")
    mixed = stored(mixed.withColumn("row", F.monotonically_increasing_id()), "exact-mixed")
    return _judged(facts.join(apart, "key", "left_anti"), ["key"]).unionByName(_judged(mixed, ["key", "norm"]))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_classes(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256)
    rows = docs.withColumn("_own", sha)
    found = rows.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_sha")), "left_semi")
    # Rows that repeat id and text are alike for the join; one of them stays.
    return found.dropDuplicates(["doc_id", "_own"]).select(*docs.columns)
