"""Byte-level BPE over whole corpora by a global shuffle of distinct words.

Texts are cut before every space, where the pattern of the rank files always ends a match too (texts with runs of white
space are cut only before a space that a word follows). A chunk of documents becomes positions: for each word its number
in the chunk's own list of distinct words. The lists are dealt out by hash; whoever owns a word encodes it once for all
chunks and answers each chunk with the ids. The chunk then puts ids in the place of positions, and decoding puts the
bytes of the token table, which has a fixed size, in the place of ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import width
from ledgerloom.llm.words import gather, slices

# White space as Unicode lists it, and the separators that Python adds.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CHUNK = 12 << 20  # bytes of text; the larger, the fewer lists a frequent word is in
_RUN = rf"{_SPACE} (?:{_SPACE}|\z)"


class Ranks:
    """A rank file of the ``tiktoken`` library: encoding of words, and the table of token bytes."""

    _open: dict[tuple[str, str], "Ranks"] = {}

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        self.table = pa.array(table, pa.large_binary())
        self.kind = np.uint16 if len(table) <= 1 << 16 else np.uint32

    @classmethod
    def open(cls, path: str, pattern: str) -> "Ranks":
        if (path, pattern) not in cls._open:
            cls._open[path, pattern] = cls(path, pattern)
        return cls._open[path, pattern]


def cut(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(bounds, index, distinct words): row i consists of ``words[index[bounds[i]:bounds[i + 1]]]``, one behind another."""
    text = pc.fill_null(text, "")
    lists = pc.split_pattern(text, " ")
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values, counts = lists.values, np.diff(offsets)
    runs = np.flatnonzero(pc.match_substring_regex(text, _RUN).to_numpy(zero_copy_only=False))
    if len(runs):
        parts, at = [], 0
        for row in runs.tolist():
            own = re.split(r" (?=\S)", text[row].as_py())
            parts += [values.slice(at, offsets[row] - at), pa.array(own, values.type)]
            at, counts[row] = offsets[row + 1], len(own)
        values = pa.concat_arrays([*parts, values.slice(at, offsets[-1] - at)])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    coded = values.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = [" " + w for w in coded.dictionary.to_pylist()]
    # The first word of a text has no space before it.
    first = values.take(pa.array(bounds[:-1])).dictionary_encode()
    index[bounds[:-1]] = first.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(words)
    return bounds, index, words + first.dictionary.to_pylist()


def _small(numbers: np.ndarray) -> bytes:
    """Numbers below 2**28 with 7 bits a byte, the last byte of each without the upper bit."""
    sizes = 1 + sum((numbers >= 1 << (7 * k)).astype(np.int64) for k in (1, 2, 3))
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(4):
        some = sizes > k
        out[(ends - 1 - k)[some]] = ((numbers[some] >> (7 * k)) & 127) | (128 if k else 0)
    return out.tobytes()


def _large(coded: bytes) -> np.ndarray:
    bytes_ = np.frombuffer(coded, np.uint8)
    ends = np.flatnonzero(bytes_ < 128)
    sizes = np.diff(ends, prepend=-1)
    out = np.zeros(len(ends), np.int64)
    for k in range(4):
        some = sizes > k
        out[some] |= (bytes_[ends[some] - k].astype(np.int64) & 127) << (7 * k)
    return out


def _chunks(part: pa.RecordBatch, owners: int):
    """A chunk's key, and its words by owner: those of owner p are ``words[order][bounds[p]:bounds[p + 1]]``."""
    bounds, index, words = cut(part.column("text"))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    owner = (hashes % np.uint64(owners)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    docs = part.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
    key = xxhash.xxh3_64(docs.tobytes())
    key.update(bounds.tobytes())
    key.update(hashes.tobytes())
    return np.uint64(key.intdigest()).astype(np.int64), bounds, index, words, order, np.searchsorted(owner[order], np.arange(owners + 1))


def _asked(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=CHUNK):
                key, _, _, words, order, ends = _chunks(part, owners)
                some = [p for p in range(owners) if ends[p] < ends[p + 1]]
                blobs = []
                for p in some:
                    own = [words[i].encode() for i in order[ends[p] : ends[p + 1]].tolist()]
                    lengths = _small(np.array(list(map(len, own)), np.int64))
                    blobs.append(len(own).to_bytes(4, "little") + len(lengths).to_bytes(4, "little") + lengths + b"".join(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), key)), pa.array(np.array(some, np.int32)), pa.array(blobs, pa.binary())], ["chunk", "owner", "blob"]
                )

    return run


def _answered(path: str, pattern: str):
    """Encodes the distinct words that meet in this task once, and answers every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, asked, words = Ranks.open(path, pattern), [], []
        for batch in batches:
            for chunk, owner, blob in zip(*(batch.column(c).to_pylist() for c in ("chunk", "owner", "blob")), strict=True):
                n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
                ends = np.cumsum(_large(blob[8 : 8 + size]))
                offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64))
                words.append(pa.LargeStringArray.from_buffers(n, offsets, pa.py_buffer(blob[8 + size :])))
                asked.append((chunk, owner, n))
        if not asked:
            return
        coded = pa.concat_arrays(words).dictionary_encode()
        ids = [ranks.encode(w) for w in coded.dictionary.to_pylist()]
        lengths = np.array(list(map(len, ids)), np.int64)
        flat, starts = np.array([x for some in ids for x in some], np.int64), np.cumsum(lengths) - lengths
        index, at = coded.indices.to_numpy(zero_copy_only=False), 0
        for chunk, owner, n in asked:
            own = index[at : at + n]
            at += n
            sizes = _small(lengths[own])
            blob = len(sizes).to_bytes(4, "little") + sizes + gather(starts[own], lengths[own], flat).astype(ranks.kind).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([owner], pa.int32()), pa.array([blob], pa.binary())], ["chunk", "owner", "blob"])

    return run


def _positions(owners: int):
    """Chunks as positions: frequent words get small numbers; the blob also says which number is which answered word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=CHUNK):
                key, bounds, index, words, order, _ = _chunks(part, owners)
                often = np.argsort(-np.bincount(index, minlength=len(words)), kind="stable")
                rank = np.empty(len(words), np.int64)
                rank[often] = np.arange(len(words))
                answered = np.empty(len(words), np.int64)
                answered[order] = np.arange(len(words))
                doc = part.column("doc_id")
                columns = [
                    doc.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
                    np.asarray(doc.is_null()).astype(np.uint8).tobytes(),
                    _small(np.diff(bounds)),
                    _small(answered[often]),
                    _small(rank[index]),
                ]
                blob = np.array([len(c) for c in columns], np.int64).tobytes() + b"".join(columns)
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([-1], pa.int32()), pa.array([blob], pa.binary())], ["chunk", "owner", "blob"])

    return run


def _assembled(path: str, pattern: str, with_ids: bool):
    def rows(blob: bytes, answers: list[bytes], ranks: Ranks) -> pa.RecordBatch:
        sizes = np.frombuffer(blob, np.int64, 5)
        ends = np.cumsum(sizes) + 40
        doc, null, counts, often, positions = (blob[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True))
        cuts = [int.from_bytes(a[:4], "little") for a in answers]
        lengths = np.concatenate([np.zeros(0, np.int64), *(_large(a[4 : 4 + c]) for a, c in zip(answers, cuts, strict=True))])
        flat = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(a[4 + c :], ranks.kind) for a, c in zip(answers, cuts, strict=True))])
        word = _large(often)[_large(positions)]
        if len(word) and word.max() >= len(lengths):
            raise RuntimeError("words of a chunk were not answered: its texts changed between two reads")
        bounds = np.concatenate([[0], np.cumsum(_large(counts))])
        starts, of_word = np.cumsum(lengths) - lengths, lengths[word]
        ids = gather(starts[word], of_word, flat).astype("<u4")
        bounds = np.concatenate([[0], np.cumsum(of_word)])[bounds]
        text = ranks.table.take(pa.array(ids))
        at = text.buffers()[1]
        at = np.frombuffer(at, np.int64, len(ids) + 1, text.offset * 8)[bounds] if len(ids) else np.zeros(len(bounds), np.int64)
        data = memoryview(text.buffers()[2]) if len(ids) and text.buffers()[2] is not None else memoryview(b"")
        spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        arrays = [
            pa.array(np.frombuffer(doc, np.int64), mask=np.frombuffer(null, np.uint8).astype(bool)),
            pa.array(np.diff(bounds)),
            pa.array([hashlib.sha256(ids[a:b]).hexdigest() for a, b in spans], pa.string()),
            pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string()),
        ]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            arrays.append(pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, blobs, answers, current, last = Ranks.open(path, pattern), [], [], None, None
        for batch in batches:
            for chunk, owner, found in zip(*(batch.column(c).to_pylist() for c in ("chunk", "owner", "blob")), strict=True):
                if blobs and chunk != current:
                    yield from (rows(blob, answers, ranks) for blob in blobs)
                    blobs, answers, last = [], [], None
                current = chunk
                # Chunks with equal rows share a key: each comes with its positions, and is answered alike.
                if owner == -1:
                    blobs.append(found)
                elif owner != last:
                    answers.append(found)
                    last = owner
        yield from (rows(blob, answers, ranks) for blob in blobs)

    return run


def encode_texts(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, and ``ids`` (little-endian uint32) if asked for.

    A null text is empty. Texts are read twice, for words and for positions; what is shuffled are distinct words, their
    ids, and positions. A word's owner sees it once per chunk, however often it occurs there.
    """
    n = width(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "chunk long, owner int, blob binary"
    answers = docs.mapInArrow(_asked(n), schema).repartition(n, "owner").mapInArrow(_answered(path, pattern), schema)
    positions = docs.mapInArrow(_positions(n), schema)
    met = positions.unionByName(answers).repartition(n, "chunk").sortWithinPartitions("chunk", "owner")
    result = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else "")
    return met.mapInArrow(_assembled(path, pattern, with_ids), result)
