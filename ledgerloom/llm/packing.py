"""Packing token sequences into near-equal windows by Karmarkar-Karp multiway differencing.

Documents longer than a window fill whole windows; the rest of each document is cut once more, below a multiple of
``GRAIN``, which gives the differencing small pieces to level with. Pieces are dealt at random into groups of about
``WINDOWS`` windows. In a group, every piece starts as a partition with one used window; the two partitions with the
largest imbalance are merged, largest window onto smallest, until one is left. If a window then exceeds the capacity, the
group gets one window more and is differenced again.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import stored
from ledgerloom.llm.words import SLICE_BYTES, WordTokenizer, give_back, slices

CAPACITY = 4096
GRAIN = 256
WINDOWS = 256
PIECES = 1 << 16  # of a group, about; groups of short texts have fewer windows


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k - 1) of each piece, with near-equal sums.

    A piece is a partition with one used window, written out only when it is merged; a merged partition keeps the order
    of its windows, and its sums only until it is merged itself.
    """
    n = len(sizes)
    if not n:
        return np.zeros(0, np.int64)
    heap = [(-size, i) for i, size in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}  # from large to small
    merged: list[tuple[int, int, np.ndarray]] = []  # (left, right, order) of partition n, n + 1, ...
    kind = np.uint8 if k <= 256 else np.uint32

    def take(node: int) -> np.ndarray:
        if node >= n:
            return sums.pop(node)
        alone = np.zeros(k, np.int64)
        alone[0] = sizes[node]
        return alone

    while len(heap) > 1:
        left, right = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = take(left) + take(right)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        merged.append((left, right, order.astype(kind)))
        node = n + len(merged) - 1
        sums[node] = both - both[-1]
        heapq.heappush(heap, (-int(sums[node][0]), node))
    out, todo = np.empty(n, np.int64), [(heap[0][1], np.arange(k))]
    while todo:
        node, windows = todo.pop()
        if node < n:
            out[node] = windows[0]
            continue
        left, right, order = merged[node - n]
        unsorted = np.empty(k, np.int64)
        unsorted[order] = windows
        todo += [(left, unsorted), (right, unsorted[::-1])]
    return out


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each piece; as few windows as the differencing can fill without exceeding ``capacity``."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = difference(sizes, k)
        if not len(sizes) or np.bincount(found, sizes, k).max() <= capacity:
            return found
        k += 1


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cut(tokenizer: str, end_id: int, capacity: int, grain: int, with_ids: bool, text_bytes: int = SLICE_BYTES):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        coder = WordTokenizer.open(tokenizer)
        for batch in batches:
            for part in slices(batch, most=text_bytes):
                bounds, ids = coder.encode(part.column("text"))
                ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
                bounds = bounds + np.arange(len(bounds))
                sizes = np.diff(bounds)
                full, rest = sizes // capacity, sizes % capacity
                coarse, fine = rest // grain * grain, rest % grain
                lengths = [[capacity] * f + [x for x in (c, r) if x] for f, c, r in zip(full.tolist(), coarse.tolist(), fine.tolist(), strict=True)]
                row = np.repeat(np.arange(len(sizes)), list(map(len, lengths)))
                length = np.array([x for some in lengths for x in some], np.int64)
                at = np.cumsum(length) - length
                pieces = [ids[a : a + n] for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                doc = part.column("doc_id").take(pa.array(row))
                columns = [doc, at - bounds[row], length, np.array(list(map(zlib.crc32, pieces)), np.int64), sizes[row]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.array([p.tobytes() for p in pieces], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
        give_back()

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    capacity: int = CAPACITY,
    grain: int = GRAIN,
    windows_per_group: int = WINDOWS,
    with_ids: bool = False,
    text_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` if asked for.

    A null or empty text is one piece with the end id. Rows with equal or null ids are packed like any others. Every
    group is bounded whatever the ids are, as it is drawn by position, not by id; only pieces' digests (or their ids,
    if asked for) are shuffled. A worker codes ``text_bytes`` of text at a time: fewer take less memory and more time.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = _PIECES + (", ids binary" if with_ids else "")
    pieces = stored(
        docs.mapInArrow(_cut(tokenizer, end_id, capacity, grain, with_ids, text_bytes), schema).withColumn("_row", F.monotonically_increasing_id()),
        "pieces",
    )
    whole, rest = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    size = rest.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("pieces")).first()
    groups = max(1, -(-size.tokens // (capacity * windows_per_group)), -(-size.pieces // PIECES))
    names = [f.name for f in pieces.schema if f.name != "_row"]

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_row", ignore_index=True)
        window = windows(frame["length"].to_numpy(np.int64), capacity)
        frame["sequence_id"] = 2 * ((frame["_group"].to_numpy(np.int64) << 20) + window) + 1
        frame["offset"] = frame.groupby("sequence_id")["length"].cumsum() - frame["length"]
        return frame[[*names, "sequence_id", "offset"]]

    result = f"{schema}, sequence_id long, offset long"
    grouped = rest.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups))).groupBy("_group").applyInPandas(packed, result)
    return whole.select(*names, (F.col("_row") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).unionByName(grouped)
