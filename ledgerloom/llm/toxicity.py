"""Toxicity by a subsequence string kernel machine on words, with Nystrom landmarks.

The kernel of two words is the sum over subsequences of four characters they share, each weighted with DECAY to the
length it spans (at most SPAN) in either word, over the words' norms; so a word still resembles an insult when characters
are left out or inserted. Ends of words are characters too. Landmarks are words from toxic and from clean texts; a linear
support vector machine is trained on the Nystrom features they give. Its decision is one weight per subsequence, so
scoring a word takes as long as the word is.

Training texts are labelled as a whole. Words that stand in significantly more toxic than clean texts, near copies
set aside, are positive; words of clean texts are negative. Rounds of training add the clean words that come out highest. A text scores as
its highest word; runs of single letters also count as one word, so spaced-out insults do too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.jaccard import shingle_sets
from ledgerloom.llm.shared import remainder, stored, whole_rows
from ledgerloom.llm.words import Cached, Words, frugal, letters, slices, with_texts

TOXIC_TEXTS, CLEAN_TEXTS = 6_000, 18_000  # about so many are learned from, drawn by a hash of the id
POSITIVES, NEGATIVES = 3_000, 15_000  # words to train on
LANDMARKS = 320
DECAY, SPAN = 0.6, 6
TERMS = 1 << 20  # subsequences are hashed to so many numbers
THRESHOLD = 0.3
ROUNDS = 3
COST = 10.0
_OFFSETS = [(i, j, k) for k in range(3, SPAN) for j in range(2, k) for i in range(1, j)]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words with their ends, and SPAN zeros between; starts)."""
    gap = "\0" * SPAN
    text = "".join(f"\1{w}\2{gap}" for w in words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2 + SPAN
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64), np.cumsum(lengths) - lengths


def _norms(words: list[str]) -> np.ndarray:
    """The norm of a word's subsequences if none repeats; the kernel is scaled by it."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    squares = sum(np.maximum(lengths - k, 0) * DECAY ** (2 * (k + 1)) for _, _, k in _OFFSETS)
    return np.sqrt(np.maximum(squares, 1e-12))


def _terms(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each shape of a subsequence: its number at every place where it starts, and its weight. 0: not within a word."""
    a = codes * np.uint64(0x9E3779B97F4A7C15)
    b, c, d = (codes * np.uint64(m) for m in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
    real = codes > 0
    for i, j, k in _OFFSETS:
        n = len(codes) - k
        hashed = a[:n] ^ b[i : n + i] ^ c[j : n + j] ^ d[k:]
        hashed ^= hashed >> np.uint64(32)
        within = real[:n] & real[i : n + i] & real[j : n + j] & real[k:]
        yield np.where(within, 1 + ((hashed * np.uint64(0x94D049BB133111EB)) >> np.uint64(33)) % np.uint64(TERMS - 1), 0).astype(np.int64), DECAY ** (k + 1)


def weighed(words: list[str], weights: np.ndarray) -> np.ndarray:
    """<features of each word, weights> over the norm; weights[0] is 0."""
    if not words:
        return np.zeros(0)
    codes, starts = _codes(words)
    sums = np.zeros(len(codes))
    for at, weight in _terms(codes):
        sums[: len(at)] += weight * weights[at]
    return np.add.reduceat(sums, starts) / _norms(words)


def _features(word: str) -> np.ndarray:
    """One word's scaled features, dense."""
    out = np.zeros(TERMS)
    for at, weight in _terms(_codes([word])[0]):
        np.add.at(out, at, weight)
    out[0] = 0.0
    return out / _norms([word])[0]


def _kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    codes, starts = _codes(words)
    terms = list(_terms(codes))
    out = np.empty((len(words), len(landmarks)))
    for column, landmark in enumerate(landmarks):
        weights, sums = _features(landmark), np.zeros(len(codes))
        for at, weight in terms:
            sums[: len(at)] += weight * weights[at]
        out[:, column] = np.add.reduceat(sums, starts)
    return out / _norms(words)[:, None]


@dataclass
class Model:
    weights: np.ndarray  # float32, by number of a subsequence
    bias: float
    cut: float  # decision value that stands for THRESHOLD
    slope: float

    def words(self, words: list[str]) -> np.ndarray:
        return weighed(words, self.weights) + self.bias

    def score(self, decision: np.ndarray) -> np.ndarray:
        """0 to 1; THRESHOLD at the cut."""
        return 1 / (1 + np.exp(-np.clip(self.slope * (decision - self.cut), -60, 60)) * (1 - THRESHOLD) / THRESHOLD)


def fit(positive: list[str], negative: list[str], landmarks: list[str]) -> tuple[np.ndarray, float]:
    """(weights by subsequence, bias) of a squared-hinge support vector machine on Nystrom features."""
    words = [*positive, *negative]
    values, vectors = np.linalg.eigh(_kernel(landmarks, landmarks))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    x = np.column_stack([_kernel(words, landmarks) @ root, np.ones(len(words))])
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    cost = np.where(y > 0, COST * max(1.0, len(negative) / max(1, len(positive)) / 10), COST)
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps on the active set
        active = y * (x @ w) < 1
        a = x[active] * cost[active, None]
        ridge = np.eye(len(w))
        ridge[-1, -1] = 1e-6
        new = np.linalg.solve(ridge + a.T @ x[active], a.T @ y[active])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    weights = sum(share * _features(landmark) for share, landmark in zip(root @ w[:-1], landmarks, strict=True))
    return weights, float(w[-1])


def _units(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row, index, words): the words of texts as letters, and runs of three or more single letters as words of their own."""
    words = Words(text, lower=False)
    plain = letters(words.unique).to_pylist()
    row, index = words.rows(), words.index
    single = np.array([len(w) == 1 for w in plain], bool)[index]
    inside = single & (np.append(row[1:], -1) == row) & np.append(single[1:], False)
    starts = np.flatnonzero(inside & ~np.insert(inside[:-1], 0, False)) if len(inside) else np.zeros(0, int)
    more_row, more, number = [], [], {}
    for at in starts.tolist():
        end = at
        while inside[end]:
            end += 1
        if end - at >= 2:
            run = "".join(plain[i] for i in index[at : end + 1].tolist())
            more_row.append(row[at])
            more.append(len(plain) + number.setdefault(run, len(number)))
    row = np.concatenate([row, np.array(more_row, np.int64)])
    index = np.concatenate([index, np.array(more, np.int64)])
    return row, index, plain + list(number)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean texts words stand."""
    for batch in batches:
        for part in slices(batch):
            row, index, words = _units(part.column("text"))
            coded = pa.array(words, pa.string()).dictionary_encode()
            index = coded.indices.to_numpy(zero_copy_only=False)[index]
            toxic = np.asarray(part.column("toxic")).astype(np.int64)
            pairs = np.unique(row * len(words) + index) if len(row) else np.zeros(0, np.int64)
            row, index = pairs // max(1, len(words)), pairs % max(1, len(words))
            n = len(coded.dictionary)
            positive, total = np.bincount(index, toxic[row], n).astype(np.int64), np.bincount(index, minlength=n)
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(positive), pa.array(total - positive)], ["word", "pos", "neg"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the least and the largest hash of their three-word shingles, which near copies mostly share."""
    for batch in batches:
        for part in slices(batch):
            sets = shingle_sets(part.column("text"), 3)
            ends = [pa.array([int(s[i]) % (1 << 62) if len(s) else 0 for s in sets], pa.int64()) for i in (0, -1)]
            yield pa.RecordBatch.from_arrays([part.column("text"), part.column("toxic"), *ends], ["text", "toxic", "least", "most"])


def _hard(model: Model, floor: float):
    """Clean words that the model puts above ``floor``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            frame["decision"] = model.words(frame["word"].tolist())
            yield frame[frame["decision"] > floor]

    return run


def train(texts: DataFrame) -> Model | None:
    """Learns from columns doc_id, text and toxic (0 or 1). None where nothing toxic stands out from what is clean.

    About TOXIC_TEXTS and CLEAN_TEXTS rows are drawn by a hash of the id; the words of these are all counted, and
    what reaches the driver is bounded by POSITIVES and NEGATIVES.
    """
    texts = texts.where("toxic IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("toxic").cast("int").alias("toxic")
    )
    sizes = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    shares = {k: min(1.0, most / max(1, sizes.get(k, 0))) for k, most in ((1, TOXIC_TEXTS), (0, CLEAN_TEXTS))}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_000))
    drawn = texts.where(((F.col("toxic") == 1) & (draw < int(1e6 * shares[1]))) | ((F.col("toxic") == 0) & (draw < int(1e6 * shares[0]))))
    # Copies of a text would make all of its words stand out: one of them stays.
    parts = max(1, min(24, int((sizes.get(0, 0) * shares[0] + sizes.get(1, 0) * shares[1]) // 500)))
    drawn = drawn.select("text", "toxic").mapInArrow(frugal(_keyed), "text string, toxic int, least long, most long")
    drawn = stored(drawn.dropDuplicates(["toxic", "least"]).dropDuplicates(["toxic", "most"]).repartition(parts), "toxic-texts")
    counts = drawn.mapInArrow(frugal(_counted), "word string, pos long, neg long").where("length(word) > 0")
    counts = stored(counts.groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "toxic-words")
    kept = {r.toxic: r["count"] for r in drawn.groupBy("toxic").count().collect()}
    toxic, clean, n = kept.get(1, 0), kept.get(0, 0), counts.count()
    if not toxic or not clean or not n:
        return None
    rate = toxic / (toxic + clean)
    excess = F.col("pos") * F.log(F.col("pos") / ((F.col("pos") + F.col("neg")) * rate)) + F.when(
        F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / ((F.col("pos") + F.col("neg")) * (1 - rate)))
    ).otherwise(0.0)
    lifted = (F.col("pos") / toxic > 5 * F.col("neg") / clean) & (excess > float(np.log(n)) + 3)
    candidates = counts.where("pos > 0").where(lifted).orderBy(F.desc(excess), "word").limit(POSITIVES).toPandas()
    positive = candidates["word"].tolist()
    if not positive:
        return None
    negatives = counts.where("neg > 0").where(~F.col("word").isin(positive))
    often = negatives.orderBy(F.desc("neg"), "word").limit(NEGATIVES // 3)
    drawn_words = negatives.where(F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < int(1e6 * min(1.0, NEGATIVES * 0.6 / n)))
    negative = often.unionByName(drawn_words).select("word").distinct().toPandas()["word"].tolist()
    negative.sort()
    rng = np.random.default_rng(0)
    chosen = [str(w) for w in rng.permutation(negative)[: LANDMARKS // 2]]
    hard: list[str] = []
    for _ in range(ROUNDS):
        landmarks = list(dict.fromkeys([*positive[: LANDMARKS // 2], *hard[: LANDMARKS // 4], *chosen]))[:LANDMARKS]
        weights, bias = fit(positive, [*negative, *hard], landmarks)
        model = Model(weights.astype(np.float32), bias, 0.0, 6.0)
        found = negatives.select("word").mapInPandas(frugal(_hard(model, -0.5)), "word string, decision double")
        found = found.orderBy(F.desc("decision"), "word").limit(NEGATIVES // 10).toPandas()
        known = {*negative, *hard}
        new = [w for w in found["word"] if w not in known]
        hard += new
        if not new:
            break
    # Between the highest clean word and what most positive words reach; never beyond the latter.
    top = float(found["decision"].max()) if len(found) else -0.5
    reach = float(np.quantile(model.words(positive), 0.05))
    model.cut = min(reach, max(0.0, 0.5 * (top + reach)))
    return model


def _scored(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cached(lambda words: model.words(words)[:, None], 1) if model else None
        for batch in batches:
            for part in slices(with_texts(batch)):
                best = np.full(part.num_rows, -5.0)
                if model:
                    row, index, words = _units(part.column("text"))
                    decisions = np.where([bool(w) for w in words], cache.get(words)[:, 0], -5.0) if words else np.zeros(0)
                    np.maximum.at(best, row, decisions[index])
                score = model.score(best) if model else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], [part.schema.names[0], "score"])

    return run


def score_texts(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row: doc_id, score (0 to 1), predicted (1 from THRESHOLD on). Without a model, or without letters, near or at 0."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.mapInArrow(frugal(_scored(model)), "doc_id long, score double")
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def score_rows(docs: DataFrame, model: Model | None) -> DataFrame:
    """``score_texts`` with whole rows: row (a struct of all columns of ``docs``), score, predicted."""
    found = whole_rows(docs, frugal(_scored(model)), "score double")
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def labelled(docs: DataFrame, labels: DataFrame, divisor: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, text and toxic of the documents to learn from: those whose crc32(doc_id) modulo ``divisor`` is not ``held_out``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    marks = marks.where(remainder("doc_id", divisor) != held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.join(marks, "doc_id").where(remainder("doc_id", divisor) != held_out)


def judge(docs: DataFrame, labels: DataFrame, divisor: int = 4, held_out: int = 2) -> DataFrame:
    """``score_texts`` for all rows of ``docs``, with held_out."""
    found = score_texts(docs, train(labelled(docs, labels, divisor, held_out)))
    return found.select("doc_id", (remainder("doc_id", divisor) == held_out).alias("held_out"), "score", "predicted")
