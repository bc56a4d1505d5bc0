"""The registered queries of this package: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.byte_bpe import encode_texts
from ledgerloom.llm.exact_dedup import exact_classes
from ledgerloom.llm.forest import near_duplicates
from ledgerloom.llm.jaccard import jaccard_components
from ledgerloom.llm.language import identify
from ledgerloom.llm.order_minhash import fingerprints
from ledgerloom.llm.packing import pack
from ledgerloom.llm.periodic_runs import digest, periodic_runs
from ledgerloom.llm.sharding import balanced_tree, grown, shard_rows
from ledgerloom.llm.shared import documents, new_path
from ledgerloom.llm.simple8b import read_ids, write_ids
from ledgerloom.llm.toxicity import judge
from ledgerloom.llm.trie_lm import score_texts
from ledgerloom.llm.vector_codes import compress

WORD_TOKENIZER = "word_bpe_49k.json"
SHARDS = 8


def op1_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    extra = {"size": (F.octet_length("text") + 1).cast("long"), "text_crc32": F.crc32(text), "law": F.lit("key")}
    extra["size"] = F.coalesce(extra["size"], F.lit(1).cast("long"))
    tree = balanced_tree(SHARDS)
    rows = shard_rows(documents(spark, sf_dir), "doc_id", tree, grown(tree, SHARDS), extra)
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "simple8b")
    write_ids(documents(spark, sf_dir), path, public_tokenizers.path(WORD_TOKENIZER), end_id=1)
    return read_ids(spark, path)


def op5_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path(WORD_TOKENIZER), end_id=2)


def op3_adaptive_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), words=3, percent=90)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_texts(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op4_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_word_backoff_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op8_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir), divisor=5, held_out=1)


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op10_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.93)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors: 16 parts, 64 entries a part, two rounds."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=16, entries=64, rounds=2)


def _repeats_itself(doc_id: int | None, words: int) -> tuple[int, int] | None:
    """Which documents repeat themselves from which word on, and with which period; a row without an id does not."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10:
        return None
    g = h // 10
    return g % words, 1 + (words - g % words) // (3 + g % 8)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in all documents, a tenth of which are made to repeat themselves."""
    return digest(periodic_runs(documents(spark, sf_dir), edit=_repeats_itself))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of equal texts of every document."""
    return exact_classes(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_hash_tree_sharding,
        op2_simple8b_ids,
        op3_adaptive_jaccard,
        op4_string_kernel_toxicity,
        op5_differencing_packing,
        op6_word_backoff_language,
        op7_order_minhash,
        op8_elias_fano_lm,
        op9_byte_bpe,
        op10_projection_forest,
        op11_vector_codes,
        op12_periodic_runs,
        op13_exact_dedup,
    )
}
_EXACT = r"""
    WITH norm AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
         classes AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM norm JOIN classes USING (t)
"""


def _nearest(name: str, books: str) -> str:
    return f"""
    {name}_far AS (SELECT vec_id, p, e, list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) ** 2)) AS d FROM parts JOIN {books} USING (p)),
    {name} AS (SELECT vec_id, p, arg_min(e, (d, e)) AS e, CAST(min(d) AS BIGINT) AS d FROM {name}_far GROUP BY vec_id, p)"""


def _renewed(name: str, books: str, nearest: str) -> str:
    return f"""
    {name}_sums AS (SELECT p, e, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS x
                    FROM parts JOIN {nearest} USING (vec_id, p), range(1, 1 + (SELECT max(len(v)) FROM parts)) AS t(i) GROUP BY p, e, i),
    {name}_used AS (SELECT p, e, list(x ORDER BY i) AS c FROM {name}_sums GROUP BY p, e),
    {name} AS (SELECT p, e, coalesce({name}_used.c, {books}.c) AS c FROM {books} LEFT JOIN {name}_used USING (p, e))"""


_CODES = f"""
    WITH whole AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x) AS BIGINT)) AS z FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS (SELECT vec_id, p, z[p * (len(z) // 16) + 1 : (p + 1) * (len(z) // 16)] AS v FROM whole, range(16) AS t(p)),
    seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM whole ORDER BY vec_id LIMIT 64),
    b0 AS (SELECT p, e, v AS c FROM parts JOIN seeds USING (vec_id)),
    {_nearest("n0", "b0")}, {_renewed("b1", "b0", "n0")}, {_nearest("n1", "b1")}, {_renewed("b2", "b1", "n1")}, {_nearest("n2", "b2")},
    coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM n2 GROUP BY vec_id)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
           (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
    FROM coded JOIN whole USING (vec_id)
"""
# Tokenizers, learned models, sets of links, runs and positions within tasks are beyond SQL; the tests hold those queries
# against brute force, a round trip or held-out accuracy.
ORACLE_SQL: dict[str, str] = {"op11_vector_codes": _CODES, "op13_exact_dedup": _EXACT}
