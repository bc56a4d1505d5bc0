"""Language identification, words first.

A known word counts with its log-frequency in each language. An unseen word falls back to its character n-grams (with its
ends marked): the longest n of which the model knows one, and the mean of the known ones' log-frequencies. A text's
languages are weighed by the sum over its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import remainder, whole_rows
from ledgerloom.llm.words import Cached, Words, frugal, letters, slices, with_texts

TRAIN_DOCS = 16_000  # about so many labelled documents are learned from, drawn by a hash of the id within each language
WORDS = 150_000  # known words, most frequent first
GRAMS = 100_000  # known character n-grams
LONGEST = 4
UNKNOWN = "und"


def grams(word: str, n: int) -> list[str]:
    marked = f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1) if marked[i : i + n] != " "]


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray

    def logs(self, words: list[str]) -> np.ndarray:
        """A row of log-frequencies per word; zeros where nothing is known of it."""
        out = np.zeros((len(words), len(self.languages)))
        row, at = [], []
        for i, word in enumerate(words):
            found = self.words.get(word)
            if found is not None:
                out[i] = self.word_logs[found]
                continue
            for n in range(LONGEST, 0, -1):
                known = [g for g in map(self.grams.get, grams(word, n)) if g is not None]
                if known:
                    row += [i] * len(known)
                    at += known
                    break
        if row:
            counts = np.bincount(row, minlength=len(words))
            for k in range(out.shape[1]):
                sums = np.bincount(row, self.gram_logs[at, k], len(words))
                out[:, k] += sums / np.maximum(counts, 1)
        return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (kind 0) and n-grams of words (kind 1) by language."""
    totals: dict[tuple[str, int], Counter] = {}
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column("text"), lower=False)
            plain = letters(words.unique).to_pylist()
            langs = part.column("lang").to_pylist()
            for lang in set(langs):
                rows = np.array([x == lang for x in langs])
                counts = np.bincount(words.index[rows[words.rows()]], minlength=len(plain))
                for i in np.flatnonzero(counts).tolist():
                    if plain[i]:
                        totals.setdefault((lang, 0), Counter())[plain[i]] += int(counts[i])
    for (lang, _), words in list(totals.items()):
        own = totals[lang, 1] = Counter()
        for word, count in words.items():
            for n in range(1, LONGEST + 1):
                for gram in grams(word, n):
                    own[gram] += count
    for (lang, kind), counts in totals.items():
        terms = list(counts)
        for i in range(0, len(terms), 50_000):
            some = terms[i : i + 50_000]
            values = pa.array([counts[t] for t in some], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([kind] * len(some), pa.int32()), pa.array(some), values], ["lang", "kind", "term", "n"])


def _logs(table, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    terms = table["term"].drop_duplicates().tolist()
    number = {t: i for i, t in enumerate(terms)}
    counts = np.zeros((len(terms), len(languages)))
    counts[table["term"].map(number), table["lang"].map({x: i for i, x in enumerate(languages)})] = table["n"]
    # Witten-Bell: as many chances of a new term as a language has terms, shared out by the frequency in all languages.
    # So a term that no language but one has is likelier there, however little was learned of the others.
    overall = (counts.sum(axis=1) + 0.5) / (counts.sum() + 0.5 * (len(terms) + 1))
    kinds = np.maximum((counts > 0).sum(axis=0), 1)
    return number, np.log((counts + kinds * overall[:, None]) / (counts.sum(axis=0) + kinds))


def train(docs: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Learns from columns doc_id, text, lang. ``most`` bounds the sample, of which every language gets an equal share, or
    all its documents if they are fewer (what those leave over goes to the others); tables are bounded by WORDS and GRAMS."""
    docs = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    sizes = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").toPandas()
    total = max(1, int(sizes["count"].sum()))
    languages = sorted(sizes["lang"])
    left, share = most, {}
    for place, (lang, size) in enumerate(reversed(list(zip(sizes["lang"], sizes["count"], strict=True)))):
        quota = min(size, left / (len(sizes) - place))
        share[lang], left = quota / size, left - quota
    bound = F.lit(0)
    if share:
        bound = F.create_map(*(F.lit(x) for lang, s in share.items() for x in (lang, round(1_000_000 * s))))[F.col("lang")]
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1_000_000)) < bound)
    counts = drawn.select("text", "lang").mapInArrow(frugal(_counted), "lang string, kind int, term string, n long").groupBy("lang", "kind", "term").agg(F.sum("n").alias("n"))
    terms = counts.groupBy("kind", "term").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by"))
    tables = []
    for kind, bound in ((0, WORDS), (1, GRAMS)):
        top = terms.where(F.col("kind") == kind).orderBy(F.desc("total"), "term").limit(bound)
        tables.append(top.select("term", F.inline("by")).toPandas())
    words, word_logs = _logs(tables[0], languages)
    pieces, gram_logs = _logs(tables[1], languages)
    prior = sizes.set_index("lang")["count"].reindex(languages).to_numpy(float) / total
    return Model(languages, prior, words, word_logs, pieces, gram_logs)


def _predicted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cached(model.logs, len(model.languages))
        names = np.array([*model.languages, UNKNOWN])
        for batch in batches:
            for part in slices(with_texts(batch)):
                words = Words(part.column("text"), lower=False)
                plain = letters(words.unique).to_pylist()
                real = np.array([bool(w) for w in plain], bool)
                logs = cache.get(plain) * real[:, None] if plain and model.languages else np.zeros((len(plain), len(model.languages)))
                n, rows = part.num_rows, words.rows()
                sums = np.stack([np.bincount(rows, logs[words.index, k], n) for k in range(logs.shape[1])], axis=1) if logs.shape[1] else np.zeros((n, 0))
                some = np.bincount(rows, real[words.index], n) > 0 if len(rows) else np.zeros(n, bool)
                if not model.languages:
                    best, score = np.zeros(n, int), np.zeros(n)
                else:
                    sums = sums + np.log(model.prior)
                    sums -= sums.max(axis=1, keepdims=True)
                    shares = np.exp(sums) / np.exp(sums).sum(axis=1, keepdims=True)
                    best = np.where(some, shares.argmax(axis=1), len(model.languages))
                    score = np.where(some, shares.max(axis=1), 0.0)
                arrays = [part.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(arrays, [part.schema.names[0], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred, score. ``und`` with score 0 where the text is null or has no letter, or nothing was learned."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(frugal(_predicted(model)), "doc_id long, lang_pred string, score double")


def predict_rows(docs: DataFrame, model: Model) -> DataFrame:
    """``predict`` with whole rows: row (a struct of all columns of ``docs``), lang_pred, score."""
    return whole_rows(docs, frugal(_predicted(model)), "lang_pred string, score double")


def identify(docs: DataFrame, divisor: int = 4, held_out: int = 2) -> DataFrame:
    """``predict`` for all rows of ``docs``, learned from those whose crc32(doc_id) modulo ``divisor`` is not ``held_out``."""
    model = train(docs.where(remainder(F.col("doc_id").cast("long"), divisor) != held_out))
    found = predict(docs, model)
    return found.select("doc_id", (remainder("doc_id", divisor) == held_out).alias("held_out"), "lang_pred", "score")
