"""Language-model scores from an Elias-Fano n-gram trie in shards.

The model is a bigram model with Witten-Bell smoothing over a unigram model: p(w|u) = (c(u,w) + k t(u) p(w)) / (c(u) + k t(u)),
where t(u) is the number of distinct successors of u and k weights the smoothing. Texts become (context, successor)
pairs, dealt out by context; the pairs of a very frequent context are spread by successor, after its distinct successors
have been counted. Whoever owns a context builds its part of the trie from the pairs of training documents, and scores
the pairs of all documents with it, so every pair is shuffled once; only pairs whose successor is not among the words
that every task knows first go to the owner of that word for its count. Scores go back as sums per document.

A shard of the trie is one memory-mapped file. Its levels are Elias-Fano sequences: the sorted hashes of contexts,
pointers to their first successors, and the successors, relative to their context and made monotone by its number. Next
to them stand one byte per successor for its smoothed log-probability and one per context for its backoff weight.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import remainder, stored, width
from ledgerloom.llm.words import Words, give_back, mix, slices

LISTED = 1 << 19  # most frequent words whose counts every task knows, the others' owners are asked; bounds the broadcast to 8 MB
SPREAD = 200_000  # pairs of one context in a shard, about
SHARD = 600_000  # training pairs of a shard, about: their number grows with the corpus
SMOOTHING = 8.0
BITS = 40  # of a successor's hash within its context
# A word cannot contain a space.
END, START = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (" end", " start"))
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_SELECT = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    for _r, _i in enumerate([i for i in range(8) if _b >> i & 1]):
        _SELECT[_b, _r] = _i


class EliasFano:
    """A monotone sequence of uint64 in about 2 + log2(universe / n) bits per value; all methods take arrays."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.low_bits = int(parts["head"][0]), int(parts["head"][1])
        self.low, self.high, self.ranks = parts["low"], parts["high"], parts["ranks"]

    @staticmethod
    def build(values: np.ndarray) -> dict[str, np.ndarray]:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = values & np.uint64((1 << bits) - 1)
        words = np.zeros((n * bits + 63) // 64 + 2, np.uint64)
        if n and bits:
            at = np.arange(n, dtype=np.int64) * bits
            for word, part in ((at >> 6, low << (at & 63).astype(np.uint64)), ((at >> 6) + 1, (low >> np.uint64(1)) >> (63 - (at & 63)).astype(np.uint64))):
                starts = np.flatnonzero(np.diff(word, prepend=-1))
                words[word[starts]] |= np.bitwise_or.reduceat(part, starts)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (int(ones[-1]) if n else 0) + 2
        flags = np.zeros(-(-size // 64) * 64, np.uint8)
        flags[ones] = 1
        high = np.packbits(flags, bitorder="little")
        counts = _ONES[high].reshape(-1, 8).sum(axis=1, dtype=np.int64)
        ranks = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return {"head": np.array([n, bits], np.int64), "low": words, "high": high, "ranks": ranks}

    def _lows(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low_bits
        off = (at & 63).astype(np.uint64)
        both = (self.low[at >> 6] >> off) | ((self.low[(at >> 6) + 1] << np.uint64(1)) << (np.uint64(63) - off))
        return both & np.uint64((1 << self.low_bits) - 1)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The place of the k-th bit that is set (or not set)."""
        ranks = self.ranks if one else 64 * np.arange(len(self.ranks)) - self.ranks
        word = np.searchsorted(ranks, k, side="right") - 1
        left, at = k - ranks[word], word * 8
        for _ in range(7):
            byte = self.high[at]
            count = _ONES[byte if one else ~byte].astype(np.int64)
            step = left >= count
            left, at = np.where(step, left - count, left), at + step
        byte = self.high[at]
        return at * 8 + _SELECT[byte if one else ~byte, left]

    def get(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._lows(i)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, or -1: the values that share its upper part stand together, their lower parts sorted."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        zeros = 8 * len(self.high) - self.n
        live = np.flatnonzero(high < zeros)
        high, low = high[live], values[live] & np.uint64((1 << self.low_bits) - 1)
        first = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - high + 1, 0)
        last = np.minimum(self._select(high, False) - high, self.n)
        end = last
        while (some := first < last).any():
            middle = (first + last) // 2
            less = some & (self._lows(np.minimum(middle, self.n - 1)) < low)
            first, last = np.where(less, middle + 1, first), np.where(some & ~less, middle, last)
        found = (first < end) & (self._lows(np.minimum(first, self.n - 1)) == low)
        out[live[found]] = first[found]
        return out


def save(path: str, levels: dict[str, np.ndarray]) -> None:
    """Arrays behind one another, 8 bytes aligned, with a table of contents in front."""
    names = list(levels)
    arrays = [np.ascontiguousarray(levels[n]) for n in names]
    toc, at = [], 4096
    for name, a in zip(names, arrays, strict=True):
        toc.append(f"{name} {a.dtype.str} {len(a)} {at}")
        at += -(-a.nbytes // 8) * 8
    with open(path, "wb") as file:
        file.write("\n".join(toc).encode().ljust(4096))
        for a in arrays:
            file.write(a.tobytes() + b"\0" * (-a.nbytes % 8))


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory."""
    with open(path, "rb") as file:
        toc = [line.split() for line in file.read(4096).decode().strip().split("\n")]
    data = np.memmap(path, np.uint8, "r")
    out = {}
    for name, kind, n, at in toc:
        size = int(n) * np.dtype(kind).itemsize
        out[name] = data[int(at) : int(at) + size].view(kind)
    return out


class Trie:
    """A shard: contexts, their successors, and quantised log10 probabilities (negative, in steps of ``step``)."""

    def __init__(self, path: str, step: float):
        levels, self.step = load(path), step
        part = lambda name: EliasFano({k.split(".")[1]: v for k, v in levels.items() if k.startswith(name)})
        self.contexts, self.pointers, self.successors = part("contexts"), part("pointers"), part("successors")
        self.probability, self.backoff = levels["probability"], levels["backoff"]

    @staticmethod
    def build(path: str, context: np.ndarray, start: np.ndarray, successor: np.ndarray, probability: np.ndarray, backoff: np.ndarray) -> None:
        """Sorted contexts; context i has the sorted successors ``start[i]`` to ``start[i + 1]``."""
        number = np.repeat(np.arange(len(context), dtype=np.uint64), np.diff(start))
        levels = {"probability": probability, "backoff": backoff}
        for name, values in (("contexts", context), ("pointers", start.astype(np.uint64)), ("successors", (number << np.uint64(BITS)) | successor)):
            levels |= {f"{name}.{k}": v for k, v in EliasFano.build(values).items()}
        save(path, levels)

    def score(self, context: np.ndarray, at: np.ndarray, successor: np.ndarray, unigram: np.ndarray) -> np.ndarray:
        """log10 p of ``successor[i]`` behind ``context[at[i]]``, whose unigram code is ``unigram[i]``."""
        number = self.contexts.find(context)
        weight = np.where(number >= 0, self.backoff[np.maximum(number, 0)] if len(self.backoff) else 0, 0)
        first = np.zeros(len(number), np.uint64)
        last = np.zeros(len(number), np.uint64)
        known = number >= 0
        first[known], last[known] = self.pointers.get(number[known]), self.pointers.get(number[known] + 1)
        own = number[at]
        place = np.full(len(at), -1, np.int64)
        some = own >= 0
        place[some] = self.successors.find((own[some].astype(np.uint64) << np.uint64(BITS)) | successor[some])
        inside = (place >= 0) & (place >= first[at].astype(np.int64)) & (place < last[at].astype(np.int64))
        seen = self.probability[np.maximum(place, 0)] if len(self.probability) else np.zeros(len(at), np.uint8)
        return -self.step * np.where(inside, seen, weight[at] + unigram.astype(np.int64))


def _counted(shards: int):
    """Words of training documents, each text closed by an end, as counts by range of their hash."""

    def flush(values: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        value, count = np.concatenate(values), np.concatenate(counts)
        order = np.argsort(value, kind="stable")
        value, count = value[order], count[order]
        starts = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        value, count = value[starts], np.add.reduceat(count, starts)
        value, count = value[count > 0], count[count > 0]
        owner = (value % np.uint64(shards)).astype(np.int32)
        order = np.argsort(owner, kind="stable")
        value, count, owner = value[order], count[order], owner[order]
        cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        ends = np.append(cuts[1:], len(owner))
        blobs = [value[a:b].tobytes() + count[a:b].astype(np.int64).tobytes() for a, b in zip(cuts, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(owner[cuts]), pa.array(blobs, pa.binary())], ["shard", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts, size = [], [], 0
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                values += [words.hashes(), np.array([END])]
                counts += [np.bincount(words.index, minlength=len(words.unique)), np.array([part.num_rows])]
                size += len(values[-2])
                if size > 1_500_000:
                    yield flush(values, counts)
                    values, counts, size = [], [], 0
        if values:
            yield flush(values, counts)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    values, counts, shards = [], [], {}
    for batch in batches:
        for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            n = len(blob) // 16
            shards.setdefault(shard, []).append((np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.int64, n, 8 * n)))
    for shard, found in shards.items():
        value, count = (np.concatenate(x) for x in zip(*found, strict=True))
        value, at = np.unique(value, return_inverse=True)
        count = np.bincount(at, count).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([value.tobytes() + count.tobytes()], pa.binary())], ["shard", "blob"])


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words have how many occurrences."""
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            times, words = np.unique(np.frombuffer(blob, np.int64, len(blob) // 16, len(blob) // 2), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(times), pa.array(words)], ["times", "words"])


def _at_least(times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                n = len(blob) // 16
                value, count = np.frombuffer(blob, np.int64, n), np.frombuffer(blob, np.int64, n, 8 * n)
                yield pa.RecordBatch.from_arrays([pa.array(value[count >= times]), pa.array(count[count >= times])], ["word", "count"])

    return run


def _codes(counts: np.ndarray, z: float, step: float) -> np.ndarray:
    """Quantised unigram log-probabilities of words that occur so often."""
    return np.round(-np.log10((counts + 0.5) / z) / step).astype(np.uint8)


def _shard(context: np.ndarray, times: np.ndarray, successor: np.ndarray, shards: int, spread: int) -> np.ndarray:
    """Where pairs belong: with their context, and where that occurs very often with their successor."""
    salt = mix(successor) % np.where(times > spread, -(-times // spread), 1).astype(np.uint64)
    return (mix(context + salt) % np.uint64(shards)).astype(np.int64)


def _tokens(words: Words, docs: int, end: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, the token before each, bounds of the texts): a text is followed by an end, its first pair begins with a start."""
    token = np.insert(words.index, words.bounds[1:], end)
    bounds = words.bounds + np.arange(docs + 1)
    before = np.roll(token, 1)
    before[bounds[:-1]] = start
    return token, before, bounds


def _paired(owners: int, shards: int, listed: np.ndarray, counts: np.ndarray, complete: bool, z: float, step: float, spread: int, asking: bool):
    """Texts to (context, successor) pairs by shard (kind 0) and documents (kind 2).

    With ``asking`` instead, only the pairs whose successor's count is not known, by the owner of that word (kind 1).
    ``complete``: words that are not listed have not been seen in training.
    """
    other = 0 if complete else -1
    starts = int(counts[np.searchsorted(listed, END)]) if END in listed else other

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield from chunk(part)
        give_back()

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "chunk", "kind", "blob"])

    def chunk(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = Words(part.column("text"))
        docs = part.num_rows
        hashes = np.concatenate([words.hashes(), [END, START]])
        n = len(hashes)
        at = np.minimum(np.searchsorted(listed, hashes), max(0, len(listed) - 1))
        known = listed[at] == hashes if len(listed) else np.zeros(n, bool)
        times = np.where(known, counts[at] if len(listed) else 0, other)
        # A successor is written as its place in the list; words that were never learned share the place behind it.
        place = np.where(known, at, len(listed))
        times[-1] = starts
        token, before, bounds = _tokens(words, docs, n - 2, n - 1)
        doc = np.repeat(np.arange(docs), np.diff(bounds))
        trained = np.asarray(part.column("train")).astype(np.int64)

        ids = part.column("doc_id")
        key = xxhash.xxh3_64(bounds.tobytes())
        for x in (hashes, token, ids.fill_null(-1).to_numpy(zero_copy_only=False)):
            key.update(x.tobytes())
        key = np.uint64(key.intdigest()).astype(np.int64)
        rows: list[tuple] = []

        listed_token = times[token] >= 0
        if asking:
            rest = np.flatnonzero(~listed_token)
            asked = [hashes[token[rest]], hashes[before[rest]], times[before[rest]].astype(np.int64), (doc * 2 + trained[doc])[rest].astype(np.uint32)]
            owner = (asked[0] % np.uint64(owners)).astype(np.int64)
            by = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[by], np.arange(owners + 1))
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                own = by[cuts[s] : cuts[s + 1]]
                rows.append((s, key, 1, _squeezed(np.int64(docs).tobytes() + b"".join(c[own].tobytes() for c in asked))))
            if rows:
                yield packed(rows)
            return
        logs = np.where(listed_token, np.log10((np.maximum(times[token], 0) + 0.5) / z), 0.0)
        base = np.bincount(doc, logs, docs)
        known_tokens = np.bincount(doc, times[token] > 0, docs).astype(np.int64)
        doc_train = (doc * 2 + trained[doc])[listed_token]
        before, token = before[listed_token], token[listed_token]
        successor = hashes[token] >> np.uint64(64 - BITS)
        shard = _shard(hashes[before], times[before], successor, shards, spread)
        order = np.lexsort((before, shard))
        shard, before, token = shard[order], before[order], token[order]
        doc_train = doc_train[order]
        small = np.uint16 if docs < 1 << 15 else np.uint32
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[s], cuts[s + 1]
            own = before[a:b]
            firsts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            context = own[firsts]
            columns = [
                hashes[context],
                times[context].astype(np.int64),
                np.diff(np.append(firsts, b - a)).astype(np.uint32),
                (place[token[a:b]] & 0xFFFF).astype(np.uint16),
                (place[token[a:b]] >> 16).astype(np.uint8),
                doc_train[a:b].astype(small),
            ]
            head = np.array([len(context), b - a, docs, np.dtype(small).itemsize], np.int64).tobytes()
            rows.append((s, key, 0, _squeezed(head + b"".join(c.tobytes() for c in columns))))
        null = np.asarray(ids.is_null()).astype(np.uint8)
        columns = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), null, trained.astype(np.uint8), np.diff(bounds), known_tokens, base]
        rows.append((int(np.uint64(key) % np.uint64(shards)) if key >= 0 else 0, key, 2, np.int64(docs).tobytes() + b"".join(c.tobytes() for c in columns)))
        yield packed(rows)

    return run


def _sums(docs: int, doc: np.ndarray, values: list[np.ndarray]) -> bytes:
    """Sums per document of a chunk: for all of them, or for those that occur."""
    found = np.flatnonzero(np.bincount(doc, minlength=docs))
    return np.int64(len(found)).tobytes() + found.astype(np.uint32).tobytes() + b"".join(np.bincount(doc, v, docs)[found].tobytes() for v in values)


def _squeezed(columns: bytes) -> bytes:
    """Columns of pairs as they are stored and shuffled: entropy-coded, as most bytes of a column are far from random."""
    return np.int64(len(columns)).tobytes() + pa.Codec("zstd", compression_level=1).compress(columns, asbytes=True)


def _loosened(blob: bytes) -> bytes:
    return pa.Codec("zstd").decompress(blob[8:], int(np.frombuffer(blob, np.int64, 1)[0]), asbytes=True)


def _by_place(words: np.ndarray, counts: np.ndarray, z: float, step: float) -> tuple[np.ndarray, np.ndarray]:
    """(hash, unigram code) of a successor by its place in the list; words that were never learned share one hash, of no word."""
    hashes = words >> np.uint64(64 - BITS)
    free = np.setdiff1d(np.arange(len(hashes) + 1, dtype=np.uint64), hashes)[:1]
    return np.append(hashes, free), np.append(_codes(counts, z, step), _codes(np.zeros(1), z, step)).astype(np.uint8)


def _columns(blob: bytes, by_place: tuple[np.ndarray, np.ndarray]) -> tuple[int, list[np.ndarray]]:
    """(documents, columns) of pairs: contexts, their occurrences and pairs; successors in two parts, codes, documents."""
    blob = _loosened(blob)
    k, n, docs, width_ = np.frombuffer(blob, np.int64, 4).tolist()
    at, columns = 32, []
    kinds = (np.uint64, np.int64, np.uint32, np.uint16, np.uint8, np.uint16 if width_ == 2 else np.uint32)
    for kind, m in zip(kinds, (k, k, k, n, n, n), strict=True):
        columns.append(np.frombuffer(blob, kind, m, at))
        at += columns[-1].nbytes
    context, times, pairs, low, high, doc_train = columns
    place = low.astype(np.uint32) | (high.astype(np.uint32) << np.uint32(16))
    successor = by_place[0][place]
    parts = (successor & np.uint64(0xFFFFFFFF)).astype(np.uint32), (successor >> np.uint64(32)).astype(np.uint8)
    return docs, [context, times, pairs, *parts, by_place[1][place], doc_train]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """(chunk, kind, blob) of each row, one at a time."""
    for i in range(batch.num_rows):
        yield tuple(batch.column(c)[i].as_py() for c in ("chunk", "kind", "blob"))


def _flat(blob: bytes, kinds: tuple, front: int = 0) -> list[np.ndarray]:
    """Columns of equal length that stand behind one another, after ``front`` bytes."""
    n, at, columns = (len(blob) - front) // sum(np.dtype(k).itemsize for k in kinds), front, []
    for kind in kinds:
        columns.append(np.frombuffer(blob, kind, n, at))
        at += columns[-1].nbytes
    return columns


ASKED = (np.uint64, np.uint64, np.int64, np.uint32)  # successor, context, its occurrences, document
TOLD = (np.uint64, np.int64, np.uint64, np.int64, np.int64, np.uint32, np.uint8)  # context, its occurrences, successor, chunk, documents, document, code


def _told(shards: int, z: float, step: float, spread: int):
    """Pairs of kind 1, after the vocabulary of their successors (kind 3): the pairs by shard with codes (kind 4), and the base score (kind 1)."""

    def dealt(held: list[list[np.ndarray]]) -> Iterator[tuple[int, int, int, bytes]]:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        shard = _shard(columns[0], columns[1], columns[2], shards, spread)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            own = order[cuts[s] : cuts[s + 1]]
            yield s, 0, 4, _squeezed(b"".join(c[own].astype(k).tobytes() for c, k in zip(columns, TOLD, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
        out = lambda row: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["shard", "chunk", "kind", "blob"])
        vocabulary: list[tuple[np.ndarray, np.ndarray]] = []
        value, count, ready, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), False, [], 0
        for batch in batches:
            for chunk, kind, blob in _rows(batch):
                if kind == 3:
                    n = len(blob) // 16
                    vocabulary.append((np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.int64, n, 8 * n)))
                    continue
                if not ready and vocabulary:
                    value, count = (np.concatenate(x) for x in zip(*vocabulary, strict=True))
                    order = np.argsort(value)
                    value, count = value[order], count[order]
                blob = _loosened(blob)
                ready, docs = True, int(np.frombuffer(blob, np.int64, 1)[0])
                word, context, times, doc_train = _flat(blob, ASKED, 8)
                at = np.minimum(np.searchsorted(value, word), max(0, len(value) - 1))
                c = np.where(value[at] == word, count[at], 0) if len(value) else np.zeros(len(word), np.int64)
                sums = _sums(docs, (doc_train >> 1).astype(np.int64), [np.log10((c + 0.5) / z), (c > 0).astype(np.float64)])
                yield out((chunk % shards, chunk, 1, sums))
                full = np.full(len(word), 1, np.int64)
                held.append([context, times, word >> np.uint64(64 - BITS), full * chunk, full * docs, doc_train, _codes(c, z, step)])
                size += len(word)
                if size > 500_000:
                    yield from map(out, dealt(held))
                    held, size = [], 0
        if held:
            yield from map(out, dealt(held))
        del vocabulary, value, count, held
        give_back()

    return run


def _successors(shards: int, hot: np.ndarray):
    """Texts to distinct training pairs of the contexts ``hot`` (sorted hashes), by shard: its context's number and its successor."""

    def pairs(part: pa.RecordBatch) -> np.ndarray:
        words = Words(part.column("text"))
        hashes = np.concatenate([words.hashes(), [END, START]])
        token, before, _ = _tokens(words, part.num_rows, len(hashes) - 2, len(hashes) - 1)
        at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
        number = np.where(hot[at] == hashes, at, -1)[before]
        some = number >= 0
        return np.unique((number[some].astype(np.uint64) << np.uint64(BITS)) | (hashes[token[some]] >> np.uint64(64 - BITS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.zeros(0, np.uint64)], 0
        for batch in batches:
            for part in slices(batch):
                held.append(pairs(part))
                size += len(held[-1])
                if size > 2_000_000:
                    held = [np.unique(np.concatenate(held))]
                    size = len(held[0])
                if size > 1_000_000:
                    yield flush(held)
                    held, size = [np.zeros(0, np.uint64)], 0
        yield flush(held)
        give_back()

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        pair = np.unique(np.concatenate(held))
        owner = (mix(pair) % np.uint64(shards)).astype(np.int32)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(shards + 1))
        some = np.flatnonzero(np.diff(cuts))
        blobs = [pair[order[cuts[s] : cuts[s + 1]]].tobytes() for s in some]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    return run


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many distinct pairs each context's number has in this task."""
    held, size = [np.zeros(0, np.uint64)], 0
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            held.append(np.frombuffer(blob, np.uint64))
            size += len(held[-1])
            if size > 4_000_000:
                held, size = [np.unique(np.concatenate(held))], 0
    number, kinds = np.unique(np.unique(np.concatenate(held)) >> np.uint64(BITS), return_counts=True)
    yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int64)), pa.array(kinds.astype(np.int64))], ["number", "kinds"])


def _scored(z: float, step: float, smoothing: float, hot: np.ndarray, kinds_of_hot: np.ndarray, by_place: tuple[np.ndarray, np.ndarray]):
    """One task's shards: builds the trie from training pairs, and answers each chunk with sums per document.

    Contexts ``hot`` (sorted hashes) have as many distinct successors over all tasks as ``kinds_of_hot`` says.
    """

    def told(blobs: list[bytes]) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """(chunk, documents, columns) of pairs of kind 4, by chunk."""
        context, times, successor, chunk, docs, doc_train, code = (np.concatenate(c) for c in zip(*(_flat(_loosened(b), TOLD) for b in blobs), strict=True))
        order = np.argsort(chunk, kind="stable")
        low, high = (successor & np.uint64(0xFFFFFFFF)).astype(np.uint32), (successor >> np.uint64(32)).astype(np.uint8)
        cuts = np.flatnonzero(np.append(True, np.diff(chunk[order]) != 0))
        for own in np.split(order, cuts[1:]):
            one = np.ones(len(own), np.uint32)
            yield int(chunk[own[0]]), int(docs[own[0]]), [context[own], times[own], one, low[own], high[own], code[own], doc_train[own]]

    def pairs(direct: list[tuple[int, bytes]], asked: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        parts: list[list[np.ndarray]] = [[] for _ in range(7)]
        blocks, sizes, shape = [], [], []
        for chunk, docs, columns in [*((chunk, *_columns(blob, by_place)) for chunk, blob in direct), *(told(asked) if asked else ())]:
            for part, column in zip(parts, columns, strict=True):
                part.append(column)
            blocks.append(chunk)
            sizes.append(len(columns[-1]))
            shape.append(docs)
        direct.clear()
        asked.clear()
        context, number = np.unique(np.concatenate(parts[0]), return_inverse=True)
        number = number.astype(np.int64)
        times = np.full(len(context), -1, np.int64)
        times[number] = np.concatenate(parts[1])
        of = np.repeat(number, np.concatenate(parts[2]))
        successor = np.concatenate(parts[3]).astype(np.uint64) | (np.concatenate(parts[4]).astype(np.uint64) << np.uint64(32))
        code = np.concatenate(parts[5])
        doc_train = np.concatenate([p.astype(np.uint32) for p in parts[6]])
        del parts, part, column, columns, number
        # Distinct pairs, in the order of the trie.
        key = (of.astype(np.uint64) << np.uint64(BITS)) | successor
        del of, successor
        pa.default_memory_pool().release_unused()
        order = np.argsort(key, kind="stable")
        key = key[order]
        firsts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        run_of = np.empty(len(order), np.int32)
        run_of[order] = np.repeat(np.arange(len(firsts), dtype=np.int32), np.diff(np.append(firsts, len(key))))
        count = np.add.reduceat((doc_train[order] & 1).astype(np.uint8), firsts, dtype=np.int64)
        owner, follower, unigram = (key[firsts] >> np.uint64(BITS)).astype(np.int64), key[firsts] & np.uint64((1 << BITS) - 1), code[order[firsts]]
        del key, order, code, firsts
        seen = count > 0
        total = np.bincount(owner, count, len(context))
        total = np.where(times >= 0, times, total)
        distinct = np.bincount(owner[seen], minlength=len(context))
        if len(hot):
            place = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
            distinct = np.where(hot[place] == context, kinds_of_hot[place], distinct)
        distinct = smoothing * distinct
        trained = np.flatnonzero(distinct > 0)
        new = np.full(len(context), -1)
        new[trained] = np.arange(len(trained))
        p = 10.0 ** (-step * unigram[seen])
        p = (count[seen] + distinct[owner[seen]] * p) / (total[owner[seen]] + distinct[owner[seen]])
        weight = distinct[trained] / (total[trained] + distinct[trained])
        quantised = lambda x: np.clip(np.round(-np.log10(x) / step), 0, 255).astype(np.uint8)
        start = np.concatenate([[0], np.cumsum(np.bincount(new[owner[seen]], minlength=len(trained)))])
        with tempfile.TemporaryDirectory() as folder:
            path = os.path.join(folder, "trie")
            Trie.build(path, context[trained], start, follower[seen], quantised(p), quantised(weight))
            trie, score = Trie(path, step), np.empty(len(owner))
            for at in range(0, len(owner), 1 << 19):
                # Pairs stand in the order of their contexts.
                own = slice(at, at + (1 << 19))
                low, high = owner[own][0], owner[own][-1] + 1
                score[own] = trie.score(context[low:high], owner[own] - low, follower[own], unigram[own])
            del trie
        at = 0
        for chunk, n, docs in zip(blocks, sizes, shape, strict=True):
            yield chunk, 0, _sums(docs, (doc_train[at : at + n] >> 1).astype(np.int64), [score[run_of[at : at + n]]])
            at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 4: []}
        kinds = (pa.int64(), pa.int32(), pa.binary())
        out = lambda row: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["chunk", "kind", "blob"])
        for batch in batches:
            for chunk, kind, blob in _rows(batch):
                if kind in (1, 2):
                    yield out((chunk, kind, blob))
                else:
                    held[kind].append(blob if kind == 4 else (chunk, blob))
        if held[0] or held[4]:
            yield from map(out, pairs(held[0], held[4]))
        give_back()

    return run


def _gathered(total: int):
    """Sums of all shards to the documents of each chunk. Chunks of equal rows share a key and the sums of all of them."""

    def rows(heads: list[bytes], sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for blob in heads:
            n = int(np.frombuffer(blob, np.int64, 1)[0])
            at, columns = 8, []
            for kind in (np.int64, np.uint8, np.uint8, np.int64, np.int64, np.float64):
                columns.append(np.frombuffer(blob, kind, n, at))
                at += columns[-1].nbytes
            doc, null, train, tokens, known, base = columns
            score, more, also = (s / len(heads) for s in (sums[0], sums[1], sums[2]))
            arrays = [
                pa.array(doc, mask=null.astype(bool)),
                pa.array(train == 0),
                pa.array(tokens),
                pa.array(known + np.round(also).astype(np.int64)),
                pa.array(np.full(n, total)),
                pa.array(base + more),
                pa.array(score),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, heads, sums = None, [], {}
        for batch in batches:
            for chunk, kind, blob in _rows(batch):
                if chunk != current:
                    if heads:
                        yield from rows(heads, sums)
                    current, heads = chunk, []
                if kind == 2:
                    # Kind 2 sorts first: the number of documents is known before sums come.
                    if not heads:
                        sums = {k: np.zeros(int(np.frombuffer(blob, np.int64, 1)[0])) for k in range(3)}
                    heads.append(blob)
                    continue
                if not heads:
                    raise RuntimeError("the texts came in another order when they were read again; store them as a table first")
                n = int(np.frombuffer(blob, np.int64, 1)[0])
                doc = np.frombuffer(blob, np.uint32, n, 8)
                sums[kind][doc] += np.frombuffer(blob, np.float64, n, 8 + 4 * n)
                if kind == 1:
                    sums[2][doc] += np.frombuffer(blob, np.float64, n, 8 + 12 * n)
        if heads:
            yield from rows(heads, sums)

    return run


def score_texts(docs: DataFrame, divisor: int = 5, held_out: int = 1, smoothing: float = SMOOTHING) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Tokens are the words of the text, A-Z lower-cased, and one end; a null or empty text is an end alone. The model
    learns from documents whose crc32(doc_id) modulo ``divisor`` is not ``held_out``. ``base_score`` is the add-half
    unigram score from exact counts, ``score`` that of the quantised bigram trie. Words are told apart by 64-bit hashes.
    Pairs are made anew from the texts wherever they are needed and never stored: ``docs`` must be a table or files, which
    give the same rows in the same order each time; rows in another order raise an error.
    """
    n = width(docs.sparkSession)
    train = (remainder(F.col("doc_id").cast("long"), divisor) != held_out).alias("train")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), train)
    counted = docs.where("train").select("text").mapInArrow(_counted(n), "shard int, blob binary").repartition(n, "shard")
    vocabulary = stored(counted.mapInArrow(_merged, "shard int, blob binary"), "vocabulary")
    times = vocabulary.select("blob").mapInArrow(_histogram, "times long, words long").groupBy("times").agg(F.sum("words").alias("words"))
    # One row per number of occurrences; the most frequent words are listed as far as the list goes.
    row = times.selectExpr("sum(times * words) AS total", "sum(words) AS words").first()
    total, distinct = int(row.total or 0), int(row.words or 0)
    running = times.selectExpr("times", "sum(words) OVER (ORDER BY times DESC) AS upto").where(F.col("upto") <= LISTED)
    least = running.agg(F.min("times").alias("t")).first().t
    listed = vocabulary.select("blob").mapInArrow(_at_least(least if least is not None else 1 << 62), "word long, count long").toPandas()
    words = listed["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    words, counts = words[order], listed["count"].to_numpy(np.int64)[order]
    z = total + 0.5 * (distinct + 1)
    step = max(1e-3, float(np.log10(2 * z)) / 255)
    complete = len(words) == distinct

    # A shard's trie and pairs are held by one task.
    shards = max(n, -(-total // SHARD))
    schema = "shard int, chunk long, kind int, blob binary"
    paired = docs.mapInArrow(_paired(n, shards, words, counts, complete, z, step, SPREAD, False), schema)
    by_place = _by_place(words, counts, z, step)
    hot = words[counts > SPREAD]
    hot = np.sort(np.append(hot, START)) if END in hot else hot
    kinds_of_hot = np.zeros(len(hot), np.int64)
    if len(hot):
        found = docs.where("train").select("text").mapInArrow(_successors(n, hot), "shard int, blob binary").repartition(n, "shard")
        found = found.select("blob").mapInArrow(_distinct, "number long, kinds long").groupBy("number").agg(F.sum("kinds").alias("kinds")).toPandas()
        kinds_of_hot[found["number"].to_numpy(np.int64)] = found["kinds"].to_numpy(np.int64)
    if not complete:
        known = vocabulary.selectExpr("shard", "0L AS chunk", "3 AS kind", "blob")
        asked = docs.mapInArrow(_paired(n, shards, words, counts, complete, z, step, SPREAD, True), schema)
        asked = asked.unionByName(known).repartition(n, "shard").sortWithinPartitions(F.desc("kind"))
        paired = paired.unionByName(asked.select("chunk", "kind", "blob").mapInArrow(_told(shards, z, step, SPREAD), schema))
    scored = _scored(z, step, smoothing, hot, kinds_of_hot, by_place)
    sums = paired.repartition(shards, "shard").select("chunk", "kind", "blob").mapInArrow(scored, "chunk long, kind int, blob binary")
    met = sums.repartition(n, "chunk").sortWithinPartitions("chunk", F.desc("kind"))
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return met.mapInArrow(_gathered(total), result)
