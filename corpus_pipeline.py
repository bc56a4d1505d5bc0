"""A training corpus from raw documents: language, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of
the next one. All but the last return the columns of ``documents``. Decisions belong to rows, not to ids: rows without an
id, or with the same one, are judged each by its own text; of equal rows one stays. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import language, toxicity
from ledgerloom.llm.jaccard import jaccard_components
from ledgerloom.llm.packing import pack
from ledgerloom.llm.queries import WORD_TOKENIZER
from ledgerloom.llm.shared import documents, remainder, stored

SURE = 0.5  # a language with a smaller share is no decision


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows in a language the labelled ones have; text without letters, or null, goes."""
    model = language.train(docs.where(remainder(F.col("doc_id").cast("long"), 4) != 2))
    found = language.predict_rows(docs, model)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURE)).select("row.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows that are not predicted toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = toxicity.score_rows(docs, toxicity.train(toxicity.labelled(docs, labels)))
    return found.where("predicted = 0").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, the first of the table, of each group linked by 0.8 of their five-word shingles."""
    # Rows are numbered once, in a table: numbers given anew could change when executors are lost.
    number = "_row" + "_" * max(map(len, docs.columns))
    numbered = stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = jaccard_components(numbered.select(F.col(number).alias("doc_id"), "text"), words=5, percent=80)
    copies = found.where("doc_id != component_id").select(F.col("doc_id").alias(number))
    return numbered.join(copies, number, "left_anti").select(*(f"`{c}`" for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all kept documents in windows of at most 4096 tokens."""
    # Workers and heap come from the stages before with what those left in them, so each worker takes less text at a time.
    return pack(docs, public_tokenizers.path(WORD_TOKENIZER), end_id=2, text_bytes=1 << 20)


STAGES = [("languages", languages), ("toxic", toxic), ("near_duplicates", near_duplicates), ("packing", packing)]

# Tokens, kernels and windows are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
