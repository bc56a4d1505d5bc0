"""Product codes of vectors with integer codebooks, by per-dimension value dictionaries.

Components become integers. A vector is cut into consecutive parts, and a part is coded by the nearest of its position's
codebook entries. Within a batch every dimension has a dictionary of its distinct integers; the squared differences of
each of them to all entries are tabulated once, and the distance of a part is gathered from those tables by dictionary
code and added up. All sums are exact integers, so neither partitioning nor repetition changes a result.

The codebooks start from the vectors with the smallest ids and are refined over all vectors: each task adds up its own
vectors per part and entry, the sums are combined by a shuffle, and the driver receives one row per part and entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.shared import stored

SCALE = 256.0
LARGEST = 1 << 26  # integers saturate here, so that the squares of a part of 512 dimensions fit 64 bits
ROWS = 2048  # vectors whose distances a task holds at a time


def as_integers(vectors: pa.Array, dims: int) -> np.ndarray:
    """floor(256 x) of vectors of ``dims`` components without nulls."""
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64)


class Codebooks:
    """``entries[part]``: an array (entry, position) of integers."""

    def __init__(self, entries: list[np.ndarray], dims: int):
        self.entries, self.dims = entries, dims
        widths = [e.shape[1] for e in entries]
        self.starts = np.concatenate([[0], np.cumsum(widths)]).astype(int)

    @classmethod
    def of(cls, vectors: np.ndarray, parts: int) -> Codebooks:
        """Every vector's parts as entries."""
        return cls([np.ascontiguousarray(p) for p in np.array_split(vectors, parts, axis=1)], vectors.shape[1])

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances), both (vector, part): the nearest entries, ties to the lower index."""
        codes = np.zeros((len(vectors), len(self.entries)), np.int64)
        best = np.zeros_like(codes)
        for part, entries in enumerate(self.entries):
            lookups = []
            for j in range(entries.shape[1]):
                values, places = np.unique(vectors[:, self.starts[part] + j], return_inverse=True)
                lookups.append(((values[:, None] - entries[None, :, j]) ** 2, places))
            for a in range(0, len(vectors), ROWS):
                b = min(a + ROWS, len(vectors))
                distance = np.zeros((b - a, len(entries)), np.int64)
                for table, places in lookups:
                    distance += table[places[a:b]]
                codes[a:b, part] = distance.argmin(axis=1)
                best[a:b, part] = distance[np.arange(b - a), codes[a:b, part]]
        return codes, best

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The integers that codes (vector, part) stand for."""
        return np.concatenate([e[codes[:, p]] for p, e in enumerate(self.entries)], axis=1)

    def sha256(self) -> str:
        listed = np.concatenate([e.ravel() for e in self.entries]) if self.entries else np.zeros(0, np.int64)
        return hashlib.sha256(",".join(map(str, listed.tolist())).encode()).hexdigest()


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null and holds finite numbers only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vectors.where(F.col(vector).isNotNull() & F.coalesce(F.forall(F.col(vector).cast("array<double>"), finite), F.lit(False)))


def _of_length(column: pa.Array, dims: int) -> np.ndarray:
    return pc.equal(pc.list_value_length(column), dims).to_numpy(zero_copy_only=False)


def _sums(books: Codebooks):
    """Per part and entry that a task used: number of parts and their sum, position by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        sums = [np.zeros(e.shape, np.int64) for e in books.entries]
        for batch in batches:
            column = batch.column(0)
            rows = as_integers(column.filter(pa.array(_of_length(column, books.dims))), books.dims)
            codes, _ = books.assign(rows)
            for p, total in enumerate(sums):
                counts[p] += np.bincount(codes[:, p], minlength=len(total))
                np.add.at(total, codes[:, p], rows[:, books.starts[p] : books.starts[p + 1]])
        out = [(p, e, int(c[e]), sums[p][e].tolist()) for p, c in enumerate(counts) for e in np.flatnonzero(c).tolist()]
        columns = list(zip(*out, strict=True)) or [()] * 4
        types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "entry", "n", "sums"])

    return run


def train(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks | None:
    """Codebooks from the ``entries`` usable vectors with the smallest keys (null keys last, ties by content), refined
    over all usable vectors; None where there is none. An entry that no part chose stays. Vectors of another length than
    the first are left out. Where ``parts`` does not divide the length, the first parts are one longer."""
    rows = usable(vectors, vector).select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_vector"))
    first = rows.orderBy(F.col("_key").asc_nulls_last(), "_vector").limit(1).collect()
    if not first:
        return None
    dims = len(first[0]["_vector"])
    rows = rows.where(F.size("_vector") == dims)
    seeds = rows.orderBy(F.col("_key").asc_nulls_last(), "_vector").limit(entries).collect()
    start = pa.array([r["_vector"] for r in seeds], pa.list_(pa.float64()))
    books = Codebooks.of(as_integers(start, dims) if dims else np.zeros((len(seeds), 0), np.int64), parts)
    for _ in range(rounds):
        partial = rows.select("_vector").mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
        longest = max(e.shape[1] for e in books.entries)
        totals = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(longest)))
        renewed = [e.copy() for e in books.entries]
        # At most parts x entries rows.
        for r in totals.collect():
            at = renewed[r["part"]]
            at[r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(at.shape[1])]
        books = Codebooks(renewed, dims)
    return books


def _coded(books: Codebooks):
    hexadecimal = np.array([f"{i:02x}" for i in range(max(len(e) for e in books.entries))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            own = _of_length(column, books.dims)
            codes, distances = books.assign(as_integers(column.filter(pa.array(own)), books.dims))
            code, error = np.full(len(own), None, object), np.zeros(len(own), np.int64)
            code[own] = ["".join(row) for row in hexadecimal[codes].tolist()]
            error[own] = distances.sum(axis=1)
            arrays = [pa.array(code, pa.string()), pa.array(error, mask=~own)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(1, batch.num_columns)), *arrays], [*batch.schema.names[1:], "code", "error"]
            )

    return run


def encode(vectors: DataFrame, books: Codebooks, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """Usable vectors as the columns ``keep`` with ``code`` (two hex digits a part) and ``error`` (squared distance to
    what the code stands for); both null for a vector of another length."""
    rows = usable(vectors, vector).select(F.col(vector).cast("array<double>").alias("_vector"), *keep)
    fields = [f for f in rows.schema.fields if f.name != "_vector"]
    schema = T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return rows.mapInArrow(_coded(books), schema)


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """Per usable row of ``vectors`` (vec_id, embedding, label): vec_id, code, error, label_error (error summed over its
    label, nulls together) and codebooks_sha256. Rows without a usable vector are dropped; repeated rows and null ids are
    coded like others; other columns are ignored; an empty table gives no rows. Codes are written once to the shared
    folder and read for the sums and for the rows."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    books = train(vectors, parts=parts, entries=entries, rounds=rounds)
    if books is None:
        empty = "CAST(NULL AS STRING) AS code", "CAST(0 AS BIGINT) AS error", "CAST(0 AS BIGINT) AS label_error", "'' AS codebooks_sha256"
        return vectors.limit(0).selectExpr("vec_id", *empty)
    coded = stored(encode(vectors, books, keep=("vec_id", "label")), "vector-codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )
