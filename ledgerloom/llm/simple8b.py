"""Token ids as Simple-8b words in files.

A 64-bit word holds a selector in its upper 4 bits and 1 to 60 ids of equal bit width in the other 60. Selector 15 is an
escape: its word holds the position of an id of more than 60 bits in a list of plain 64-bit ids. Every ``SPAN`` ids start
a new word, and the words of each span are counted, so decoding may start at any span and runs over whole arrays.

A file is a Parquet table of blocks. A block's ``payload`` is, little-endian: the magic ``S8B1``, the numbers of
documents, spans, words and escapes (4 x uint32), then doc ids (int64), flags for a null id (uint8), numbers of ids
(int64), words per span (uint16), words (uint64) and escapes (uint64).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import quantiles, width
from ledgerloom.llm.words import WordTokenizer, slices

# Fixed values of the coding: ids per word and bits per id, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15
SPAN = 256
MAGIC = b"S8B1"
BLOCK_IDS = 1 << 18


def _selectors(needed: np.ndarray) -> np.ndarray:
    """For each place of each span, the selector with most ids that a word starting there can use.

    ``needed``: selector number by the width of each id, 14 for an escape, 99 behind the end.
    """
    spans, length = needed.shape
    powers = {1: needed}
    while max(powers) * 2 <= 60:
        n = max(powers)
        low = powers[n]
        wider = np.full_like(needed, 99)
        if length > n:
            wider[:, : length - n] = np.maximum(low[:, : length - n], low[:, n:])
        powers[2 * n] = wider
    best = np.full((spans, length), 13, np.uint8)
    for selector in range(13, -1, -1):
        n = int(COUNTS[selector])
        p = 1 << (n.bit_length() - 1)
        most = powers[p]
        if n > p:
            shifted = np.full_like(needed, 99)
            if length > n - p:
                shifted[:, : length - (n - p)] = most[:, n - p :]
            most = np.maximum(most, shifted)
        best[most <= selector] = selector
    best[needed == 14] = ESCAPE
    return best


def encode(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes documents ``ids[bounds[i]:bounds[i + 1]]``: (words, words per span, spans per document, escapes).

    Spans never cross documents, nor do words. Escapes are numbered from 0 over all given documents.
    """
    ids = ids.astype(np.uint64)
    lengths = np.diff(bounds)
    per_doc = -(-lengths // SPAN)
    first = np.repeat(bounds[:-1], per_doc) + SPAN * (np.arange(per_doc.sum()) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc))
    sizes = np.minimum(SPAN, np.repeat(bounds[1:], per_doc) - first)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16), per_doc, np.zeros(0, np.uint64)
    limits = np.array([1 << b for b in BITS.tolist()], np.uint64)
    need = np.searchsorted(limits, ids, side="right").astype(np.uint8)
    table = np.full((len(first), int(sizes.max())), 99, np.uint8)
    inside = np.arange(table.shape[1]) < sizes[:, None]
    table[inside] = need[(first[:, None] + np.arange(table.shape[1]))[inside]]
    best = _selectors(table)
    steps = np.append(COUNTS, [1, 1])
    at, live, chosen, places = np.zeros(len(first), np.int64), np.arange(len(first)), [], []
    while len(live):
        s = best[live, at[live]]
        chosen.append((live, s))
        places.append(at[live])
        at[live] += steps[s]
        live = live[at[live] < sizes[live]]
    span = np.concatenate([c[0] for c in chosen])
    selector = np.concatenate([c[1] for c in chosen])
    start = first[span] + np.concatenate(places)
    order = np.argsort(start, kind="stable")
    span, selector, start = span[order], selector[order], start[order]
    words = selector.astype(np.uint64) << np.uint64(60)
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        if s == ESCAPE:
            words[rows] |= np.arange(len(rows), dtype=np.uint64)
            continue
        for k in range(int(COUNTS[s])):
            words[rows] |= ids[start[rows] + k] << np.uint64(k * int(BITS[s]))
    return words, np.bincount(span, minlength=len(first)).astype(np.uint16), per_doc, ids[start[selector == ESCAPE]]


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """All ids of consecutive words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.append(COUNTS, [1, 1])[selector]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - counts
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[starts[rows]] = escapes[(words[rows] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(int(COUNTS[s])):
            out[starts[rows] + k] = (words[rows] >> np.uint64(k * int(BITS[s]))) & mask
    return out


def _tokenised(tokenizer: str, end_id: int, cuts: list):
    """Documents with their coded ids and the range of ``cuts`` they belong to. Rows of one frequent id are spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokenizer.open(tokenizer)
        limits = np.array(cuts, np.int64)
        for batch in batches:
            for part in slices(batch):
                bounds, ids = coder.encode(part.column("text"))
                n = len(bounds) - 1
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(n + 1)
                words, per_span, spans, escapes = encode(ids, bounds)
                word_ends = np.concatenate([[0], np.cumsum(per_span, dtype=np.int64)])[np.concatenate([[0], np.cumsum(spans)])]
                span_ends = np.concatenate([[0], np.cumsum(spans)])
                escaped = np.concatenate([[0], np.cumsum(words >> np.uint64(60) == ESCAPE)])[word_ends]
                doc = part.column("doc_id")
                null = np.asarray(doc.is_null())
                keys = doc.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                crcs = [zlib.crc32(words[a:b]) for a, b in zip(word_ends[:-1], word_ends[1:], strict=True)]
                left, right = np.searchsorted(limits, keys, "left"), np.searchsorted(limits, keys, "right")
                bucket = np.where(right > left, left + 1 + np.array(crcs) % np.maximum(1, right - left), right)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket.astype(np.int32)),
                        pa.array(keys, mask=null),
                        pa.array(np.array(crcs, np.int64)),
                        pa.array(np.diff(bounds)),
                        pa.array([words[a:b].tobytes() for a, b in zip(word_ends[:-1], word_ends[1:], strict=True)], pa.binary()),
                        pa.array([per_span[a:b].tobytes() for a, b in zip(span_ends[:-1], span_ends[1:], strict=True)], pa.binary()),
                        pa.array([escapes[a:b].tobytes() for a, b in zip(escaped[:-1], escaped[1:], strict=True)], pa.binary()),
                    ],
                    ["bucket", "doc_id", "tie", "n_ids", "words", "per_span", "escapes"],
                )
                pa.default_memory_pool().release_unused()

    return run


_CODED = "bucket int, doc_id long, tie long, n_ids long, words binary, per_span binary, escapes binary"
_BLOCKS = "bucket int, block int, first_id long, n_docs long, n_ids long, start long, payload binary"


def _payload(docs: list[tuple]) -> bytes:
    words = [np.frombuffer(d[3], np.uint64) for d in docs]
    escapes = [np.frombuffer(d[5], np.uint64) for d in docs]
    shifts = np.cumsum([0] + [len(e) for e in escapes])
    for i, e in enumerate(escapes):
        if len(e) and shifts[i]:
            words[i] = np.where(words[i] >> np.uint64(60) == ESCAPE, words[i] + np.uint64(shifts[i]), words[i])
    per_span = b"".join(d[4] for d in docs)
    head = struct.pack("<4s4I", MAGIC, len(docs), len(per_span) // 2, sum(map(len, words)), int(shifts[-1]))
    ids = np.array([0 if d[0] is None else d[0] for d in docs], np.int64).tobytes()
    null = np.array([d[0] is None for d in docs], np.uint8).tobytes()
    lengths = np.array([d[2] for d in docs], np.int64).tobytes()
    return b"".join([head, ids, null, lengths, per_span, *[w.tobytes() for w in words], *[e.tobytes() for e in escapes]])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted documents gathered into blocks of about ``BLOCK_IDS`` ids; a longer document is a block of its own."""
    bucket, block, start, held, size = None, 0, 0, [], 0

    def flush() -> pa.RecordBatch:
        row = [bucket, block, held[0][0], len(held), size, start, _payload(held)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], _NAMES)

    for batch in batches:
        for part in slices(batch, "words"):
            for row in zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True):
                if held and (row[0] != bucket or size + row[3] > BLOCK_IDS):
                    yield flush()
                    start, block, held, size = (start + size, block + 1, [], 0) if row[0] == bucket else (0, 0, [], 0)
                elif row[0] != bucket:
                    start, block = 0, 0
                bucket = row[0]
                held.append(row[1:])
                size += row[3]
            pa.default_memory_pool().release_unused()
    if held:
        yield flush()


_NAMES = ["bucket", "block", "first_id", "n_docs", "n_ids", "start", "payload"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Writes the ids of every text, closed by ``end_id``, to files at ``path`` in ascending doc_id order.

    Ids are dealt by ranges of doc_id, and range k becomes partition and file k, so reading the files in the order of their
    names is reading in id order; a null id comes first. Rows with equal ids keep an order by their content. A null or
    empty text has the end id only; a text of any length is one document; an empty table gives files without rows. One
    shuffle moves the coded ids; texts stay where they are read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = quantiles(docs, "doc_id", width(spark))
    coded = docs.mapInArrow(_tokenised(tokenizer, end_id, cuts), _CODED)
    dealt = coded.repartitionById(width(spark), F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "tie")
    dealt.mapInArrow(_blocks, _BLOCKS).write.parquet(path)


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's (doc ids, null flags, bounds, ids)."""
    magic, docs, spans, words, escapes = struct.unpack_from("<4s4I", payload)
    if magic != MAGIC:
        raise ValueError("no block of Simple-8b ids")
    at, out = struct.calcsize("<4s4I"), []
    for kind, n in ((np.int64, docs), (np.uint8, docs), (np.int64, docs), (np.uint16, spans), (np.uint64, words), (np.uint64, escapes)):
        out.append(np.frombuffer(payload, kind, n, at))
        at += out[-1].nbytes
    ids = decode(out[4], out[5])
    return out[0], out[1].astype(bool), np.concatenate([[0], np.cumsum(out[2])]), ids


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            bucket, start, payload = (batch.column(n)[i].as_py() for n in ("bucket", "start", "payload"))
            doc, null, bounds, ids = unpack(payload)
            small = ids.astype("<u4")
            crcs = [zlib.crc32(small[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(doc), bucket, np.int32)),
                    pa.array(doc, mask=null),
                    pa.array(start + bounds[:-1]),
                    pa.array(np.diff(bounds)),
                    pa.array(np.array(crcs, np.int64)),
                ],
                ["bucket", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files at ``path``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema(_BLOCKS).parquet(path)
    sums = files.groupBy("bucket").agg(F.sum("n_ids").alias("ids"))
    # As many rows as there are ranges: the running sum over ranges is small.
    bases = sums.selectExpr("bucket", "coalesce(sum(ids) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base")
    found = files.select("bucket", "start", "payload").mapInArrow(
        _digests, "bucket int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    return found.join(bases, "bucket").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
