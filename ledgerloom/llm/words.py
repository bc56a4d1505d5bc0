"""Splitting Arrow columns of text into words, and coding words with a public tokenizer, inside tasks."""

from __future__ import annotations

import ctypes
import os
import sys
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2 << 20
# Letters with punctuation behind them, which tokenizers' patterns split; an apostrophe may begin a suffix.
SPLIT = r"^(?P<core>\p{L}+)(?P<tail>[.,;:!?]*)$"


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of ``batch`` with at most ``most`` bytes of text each, or a single longer row.

    What the work on a piece took and has freed is given back before the next one.
    """
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(start, end - start)
        give_back()
        start = end


def with_texts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``batch`` with a column of texts; a column ``row`` of whole rows holds them itself."""
    if "text" in batch.schema.names:
        return batch
    row = batch.column(0)
    return pa.RecordBatch.from_arrays([row, row.field("text").cast(pa.string())], ["row", "text"])


def strings(array: pa.Array) -> list[str]:
    """The values as Python strings; several times as fast as ``to_pylist``."""
    return array.to_numpy(zero_copy_only=False).tolist()


class Words:
    """The words of a piece of text column: ``index[bounds[i]:bounds[i + 1]]`` are those of row i, in ``unique``."""

    def __init__(self, text: pa.Array, lower: bool = True):
        text = pc.fill_null(text, "")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
        coded = lists.values.dictionary_encode()
        self.unique = coded.dictionary
        self.index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.bounds = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        base = self.bounds[0] if len(self.bounds) else 0
        self.bounds = self.bounds - base
        self.index = self.index[: self.bounds[-1]] if len(self.bounds) else self.index
        # White space at either end leaves an empty word behind.
        empty = np.flatnonzero(pc.binary_length(self.unique).to_numpy(zero_copy_only=False) == 0)
        if len(empty):
            real = self.index != empty[0]
            self.bounds = np.concatenate([[0], np.cumsum(real)])[self.bounds]
            self.index = self.index[real]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def rows(self) -> np.ndarray:
        """For each word the row it stands in."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the unique words."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, strings(self.unique)), np.uint64, len(self.unique))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (fixed multipliers of a published finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gather(starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Concatenation of ``flat[starts[i] : starts[i] + lengths[i]]``."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class WordTokenizer:
    """Ids of whole texts from a vocabulary file of the ``tokenizers`` library, with a bounded cache of words.

    For tokenizers that drop white space, as the word vocabulary does, the ids of a text are those of its words, and the
    ids of a run of letters with punctuation behind it are those of the two parts.
    """

    CACHED = 450_000
    _open: dict[str, "WordTokenizer"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = True
        vocabulary = self.coder.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, int] = {}
        self.starts, self.lengths, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.flat = np.zeros(0, np.uint32)

    @classmethod
    def open(cls, path: str) -> "WordTokenizer":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _shrink(self) -> None:
        """Keeps the half of the cache that has been used most."""
        kept = np.sort(np.argsort(-self.used, kind="stable")[: self.CACHED // 2])
        words = list(self.known)
        self.known = {words[i]: n for n, i in enumerate(kept.tolist())}
        self.flat = gather(self.starts[kept], self.lengths[kept], self.flat)
        self.lengths, self.used = self.lengths[kept], self.used[kept] // 2
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _learn(self, words: list[str]) -> None:
        """Codes new words: runs of letters many at a time, others one by one."""
        letters = [w for w in words if w.isalpha() and len(w) < 100]
        flat, lengths, done = [], [], []
        for i in range(0, len(letters), 256):
            some = letters[i : i + 256]
            ids = np.array(self.coder.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                flat.append(ids)
                lengths.append(np.diff(cuts, prepend=0))
                done += some
        seen = set(done)
        rest = [w for w in words if w not in seen]
        for i in range(0, len(rest), 1024):
            coded = [x.ids for x in self.coder.encode_batch(rest[i : i + 1024], add_special_tokens=False)]
            lengths.append(np.array(list(map(len, coded)), np.int64))
            flat.append(np.array([x for ids in coded for x in ids], np.uint32))
        done += rest
        n = len(self.known)
        self.known.update(zip(done, range(n, n + len(done)), strict=True))
        self.lengths = np.concatenate([self.lengths, *lengths])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.concatenate([self.flat, *flat])
        self.used = np.concatenate([self.used, np.zeros(len(done), np.int64)])

    def _places(self, words: pa.Array) -> np.ndarray:
        """The place of each word in the cache, after learning the new ones."""
        coded = words.dictionary_encode()
        unique = strings(coded.dictionary)
        place = np.fromiter(map(self.known.get, unique, repeat(-1)), np.int64, len(unique))
        new = np.flatnonzero(place < 0)
        if len(new):
            words = [unique[i] for i in new.tolist()]
            self._learn(words)
            place[new] = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.used[place] += 1
        return place[coded.indices.to_numpy(zero_copy_only=False)]

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, ids): row i has ``ids[bounds[i]:bounds[i + 1]]``; a null text has none."""
        words = Words(text, lower=False)
        if len(self.known) > self.CACHED:
            self._shrink()
        parts = pc.extract_regex(words.unique, SPLIT)
        core = pc.coalesce(pc.struct_field(parts, "core"), words.unique)
        # Only ASCII is lower-cased here: elsewhere the order of lower-casing and composition matters.
        core = pc.if_else(pc.string_is_ascii(core), pc.ascii_lower(core), core)
        tail = pc.fill_null(pc.struct_field(parts, "tail"), "")
        n = len(words.unique)
        both = self._places(pa.concat_arrays([core, tail]))
        both = np.stack([both[:n], both[n:]], axis=1).ravel()
        lengths = self.lengths[both]
        flat = gather(self.starts[both], lengths, self.flat)
        lengths = lengths.reshape(-1, 2).sum(axis=1)
        starts = np.cumsum(lengths) - lengths
        lengths = lengths[words.index]
        ids = gather(starts[words.index], lengths, flat)
        return np.concatenate([[0], np.cumsum(lengths)])[words.bounds], ids


def give_back() -> None:
    """Returns unused memory of this worker process, which serves many tasks, to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)


def frugal(run: Callable) -> Callable:
    """``run`` for the batches of a task, with unused memory given back before and after it. The caches of tokenizers that
    other operators left in this worker process go first; ``run`` must not use one."""

    def task(batches: Iterator) -> Iterator:
        WordTokenizer._open.clear()
        give_back()
        yield from run(batches)
        give_back()

    return task


def letters(words: pa.Array) -> pa.Array:
    """Words in lower case without anything but letters."""
    return pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}]+", "")


class Cached:
    """Rows of numbers for words, computed once for a word as long as the bounded cache holds it."""

    def __init__(self, compute, columns: int, most: int = 500_000):
        self.compute, self.columns, self.most = compute, columns, most
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, columns))

    def get(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known, self.rows = {}, np.zeros((0, self.columns))
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        n = len(self.known)
        self.known.update(zip(new, range(n, n + len(new)), strict=True))
        self.rows = np.concatenate([self.rows, self.compute(new)]) if new else self.rows
        return self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]
