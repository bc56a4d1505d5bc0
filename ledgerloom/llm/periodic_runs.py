"""Periodic runs of words, by an online sparse dynamic programme over lags (diagonals).

Cell (i, q) of the programme is the number of words up to word i that agree one by one with the words q before them. A
word's earlier occurrences are the cells it can lengthen; where a diagonal ends and was long enough, it is a run of period
q. Two facts keep the cells few, so a text of one word costs no more than another:

- A run of period q has at least 3q matches in a row (5 if q = 1). So in the class of lags 2^k to 2^(k+1) - 1 a cell is
  active only once ``b = max(5, 3 * 2^k)`` words in a row match: an earlier occurrence counts with the b words up to it.
- Within a class only the nearest such occurrence counts. Inside a run of smallest period q the last b >= q words occur
  at no smaller lag than q (the root of the run is primitive), and a stretch of a smaller period is the run of that one.

A text of n words therefore has at most n cells in each of log2(n / 4) classes. Words are compared by dictionary number,
blocks of b words by the pair of numbers of two overlapping shorter blocks, so every comparison is exact. Words whose five
last words occur once in their text are left out before blocks are numbered; in plain prose hardly any others remain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import Words, mix, slices, strings

LEAST_WORDS, LEAST_TIMES = 6, 4  # a run has this many words, and this many times its period
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _numbered(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs, equal for equal pairs, and for each the index of the nearest earlier equal one (or -1)."""
    pairs = first * np.int64(second.max() + 1 if len(second) else 1) + second
    order = np.argsort(pairs, kind="stable")
    new = np.diff(pairs[order], prepend=-1) != 0
    number, before = np.empty(len(pairs), np.int64), np.full(len(pairs), -1, np.int64)
    number[order] = np.cumsum(new) - 1
    same = np.flatnonzero(~new)
    before[order[same]] = order[same - 1]
    return number, before


class _Blocks:
    """Numbers of the blocks of ``length`` words that end at the indexes ``at`` (ascending)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, at: np.ndarray):
        # Each text's words are numbered apart, so no block agrees with one of another text.
        self.rows, self.at, self.length = rows, at, 1
        self.number, _ = _numbered(rows[at], ids[at])
        self.lag = np.zeros(len(at), np.int64)

    def grow(self, length: int) -> None:
        """Blocks of up to twice the length, each with the lag to the nearest earlier equal one (or 0); those with no
        equal one in their text fall out, and so do all that contain them."""
        if not len(self.at):
            self.length = length
            return
        shift = length - self.length
        place = np.minimum(np.searchsorted(self.at, self.at - shift), len(self.at) - 1)
        whole = (self.at[place] == self.at - shift) & (self.at >= length - 1)
        here = np.flatnonzero(whole)
        here = here[self.rows[self.at[here]] == self.rows[self.at[here] - length + 1]]
        number, before = _numbered(self.number[here], self.number[place[here]])
        at = self.at[here]
        lag = np.where(before >= 0, at - at[before], 0)
        again = np.bincount(number, minlength=1)[number] > 1
        self.at, self.number, self.lag, self.length = at[again], number[again], lag[again], length


def _repeated_fives(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which words stand in five words in a row that may occur again in their text (by hash, so none is missed)."""
    n = len(ids)
    if n < LEAST_WORDS:
        return np.zeros(n, bool)
    coded = mix(ids.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    value = mix(rows[4:].astype(np.uint64) + np.uint64(0x51ED270B))
    for k in range(5):
        value = value + coded[k : n - 4 + k] * _ODD[k]
    value = mix(value)
    ordered = np.sort(value)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    found = np.zeros(n, bool)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, value), len(twice) - 1)
        hit = (twice[at] == value) & (rows[4:] == rows[: n - 4])
        for k in range(5):
            found[k : n - 4 + k] |= hit
    return found


def runs_of(ids: np.ndarray, rows: np.ndarray, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> np.ndarray:
    """All runs in texts given as word numbers ``ids`` and ascending text numbers ``rows``: an array of
    (text, first index into ``ids``, length, period), by text, start and period."""
    if least_times < 4 or least_words < 6:
        raise ValueError("the programme is made for runs of at least 6 words and 4 periods")
    kept = np.flatnonzero(_repeated_fives(ids, rows))
    if not len(kept):
        return np.zeros((0, 4), np.int64)
    blocks = _Blocks(ids, rows, kept)
    found, longest = [], int(np.bincount(rows).max())

    def emit(low: int, high: int) -> None:
        """Diagonals of the class: cells of consecutive words with one lag, ended where the next word has another."""
        active = np.flatnonzero((blocks.lag >= low) & (blocks.lag < high))
        at, lag = blocks.at[active], blocks.lag[active]
        if not len(at):
            return
        ends = np.flatnonzero(np.append((np.diff(at) != 1) | (np.diff(lag) != 0), True))
        starts = np.append(0, ends[:-1] + 1)
        matches = at[ends] - at[starts] + blocks.length
        period = lag[ends]
        length = matches + period
        enough = length >= np.maximum(least_words, least_times * period)
        first = at[ends] - length + 1
        found.append(np.stack([rows[at[ends]], first, length, period], axis=1)[enough])

    blocks.grow(2)
    blocks.grow(3)
    threes = blocks.at, blocks.number
    blocks.grow(5)
    emit(1, 2)
    # Six words are two blocks of three; the fives only serve lag 1.
    (blocks.at, blocks.number), blocks.length = threes, 3
    low = 2
    while low * least_times <= longest and len(blocks.at):
        blocks.grow(3 * low)
        emit(low, 2 * low)
        low *= 2
    if not found:
        return np.zeros((0, 4), np.int64)
    found = np.concatenate(found)
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stand in no run behind its first period; runs as (start, length, period)."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:n]) == 0


Edit = Callable[[int | None, int], tuple[int, int] | None]


def _detected(edit: Edit | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield _slice(part, edit)
                pa.default_memory_pool().release_unused()

    return run


def _slice(part: pa.RecordBatch, edit: Edit | None) -> pa.RecordBatch:
    words = Words(part.column("text"), lower=False)
    ids, bounds = words.index, words.bounds
    keys = part.column("doc_id").to_pylist()
    edited = set()
    for r, key in enumerate(keys):
        n = int(bounds[r + 1] - bounds[r])
        change = edit(key, n) if edit and n else None
        if change:
            a, p = change
            own = ids[bounds[r] : bounds[r + 1]].copy()
            ids[bounds[r] + a : bounds[r + 1]] = own[a + np.arange(n - a) % p]
            edited.add(r)
    rows = words.rows()
    found = runs_of(ids, rows)
    cuts = np.searchsorted(found[:, 0], np.arange(part.num_rows + 1))
    found[:, 1] -= bounds[found[:, 0]]
    # Plain texts are joined as Arrow columns; those with runs word by word.
    plain = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words.unique.take(pa.array(ids)))
    texts = pc.binary_join(plain, " ")
    touched = np.flatnonzero(np.diff(cuts))
    if len(touched):
        out = {}
        for r in touched.tolist():
            own = ids[bounds[r] : bounds[r + 1]][_kept(int(bounds[r + 1] - bounds[r]), found[cuts[r] : cuts[r + 1], 1:])]
            out[r] = " ".join(strings(words.unique.take(pa.array(own))))
        mask = np.zeros(part.num_rows, bool)
        mask[touched] = True
        texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([out[r] for r in touched.tolist()], texts.type))
    runs = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), runs), texts],
        ["doc_id", "n_words", "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, n_words, runs (start, length and period in
    words, by start and period) and collapsed, the text with each run cut to its first period and single spaces.

    ``edit`` may name, for an id and a number of words, a place and a period from which on the text repeats itself. A
    null or empty text, or one of white space, has no words, no runs and an empty collapsed text. Rows without an id or
    with a repeated one are treated alike, each by its own text. A text is held as a whole in one task, whatever its
    length; memory grows in proportion to it. Overlapping runs of different periods are all listed.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_detected(edit), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """Of what ``periodic_runs`` returns, per row: the number of runs, that with the greatest exponent, and hashes."""
    nothing = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    # Fractions are compared by cross products, so exactly; the runs' order decides ties.
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = found.withColumn("best", F.aggregate("runs", nothing, better))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
