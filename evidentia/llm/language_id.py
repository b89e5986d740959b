"""Language identification by words first, then by ever shorter character n-grams.

A text's words are its runs of letters, lower-cased. A known word scores each
language by the log of its smoothed relative frequency there. An unseen word is
scored by its longest character n-grams (with its borders, ``LONGEST`` down to
one) of which any is known: the mean of their log frequencies. A text's score of
a language is the sum over its words, and the confidence of the best language is
its share after softmax.

The model is fitted on at most ``PER_LANGUAGE`` documents of each language (those
with the smallest hash of their id) outside the held-out fold, and knows at most
``MAX_WORDS`` words and ``MAX_GRAMS`` n-grams of each length, the most frequent
ones; so its size is bounded and it is broadcast.

Edge cases: a null text or one without a letter is ``und`` with score 0; so is
every text if no language could be learned; words of which not even a single
character is known say nothing, and a text of such words only takes the language
with the most words learned; of equal languages the alphabetically first wins; a
null id is neither held out nor learned from; repeated rows are predicted one by
one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, query, staged, table
from .columns import slices, texts

FOLDS, HELD_FOLD = 4, 2
PER_LANGUAGE = 5_000
MAX_WORDS = 200_000
MAX_GRAMS = 50_000
LONGEST = 5
SMOOTH = 0.5
FLUSH = 300_000  # distinct words that a task holds before it reports
CACHE = 200_000
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams_of(word: str, length: int) -> list[str]:
    edged = f" {word} "
    return [edged[i : i + length] for i in range(len(edged) - length + 1)] if length > 1 else list(word)


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: list[dict[str, int]]  # by length, longest first
    gram_scores: list[np.ndarray]
    prior: np.ndarray
    cache: dict[str, np.ndarray] = field(default_factory=dict)

    def unseen(self, word: str) -> np.ndarray:
        """Scores of a word that the model doesn't know."""
        for length, known, scores in zip(range(LONGEST, 0, -1), self.grams, self.gram_scores, strict=True):
            rows = [known[g] for g in grams_of(word, length) if g in known]
            if rows:
                return scores[rows].mean(axis=0)
        return np.zeros(len(self.languages))

    def predict(self, rows: list[str | None]) -> tuple[list[str], list[float]]:
        split = [words_of(t) for t in rows]
        distinct = list({w for s in split for w in s})
        if not self.languages or not distinct:
            return [UNKNOWN] * len(rows), [0.0] * len(rows)
        at = {w: i for i, w in enumerate(distinct)}
        scores = np.empty((len(distinct), len(self.languages)))
        place = np.array([self.words.get(w, -1) for w in distinct])
        scores[place >= 0] = self.word_scores[place[place >= 0]]
        for i in np.flatnonzero(place < 0).tolist():
            word = distinct[i]
            found = self.cache.get(word)
            if found is None:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                found = self.unseen(word)
                if len(word) < 64:
                    self.cache[word] = found
            scores[i] = found
        names, shares = [], []
        for s in split:
            if not s:
                names.append(UNKNOWN)
                shares.append(0.0)
                continue
            total = self.prior + scores[[at[w] for w in s]].sum(axis=0)
            best = int(total.argmax())
            names.append(self.languages[best])
            shares.append(float(1 / np.exp(total - total[best]).sum()))
        return names, shares


def _fold(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS, F.lit(-1))


def _scores(rows: list, column: dict[str, int]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Numbers of the entries, smoothed log frequencies, and totals by language; rows are ``entry, language, n``."""
    names = sorted({r[0] for r in rows})
    number = {x: i for i, x in enumerate(names)}
    counts = np.zeros((len(names), len(column)))
    for entry, language, n in rows:
        counts[number[entry], column[language]] += n
    total = counts.sum(axis=0)
    logs = np.log(counts + SMOOTH) - np.log(total + SMOOTH * (len(names) + 1))
    return number, logs, total


def _most(counts: DataFrame, entry: str, at_most: int) -> DataFrame:
    """The rows of the most frequent entries; their input is already bounded by the sample."""
    top = counts.groupBy(entry).agg(F.sum("n").alias("all")).orderBy(F.desc("all"), entry).limit(at_most).select(entry)
    return counts.join(top, entry, "left_semi").select(entry, "lang", "n")


def train(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model:
    """The model of all learnable documents, at most ``PER_LANGUAGE`` of each language."""
    usable = documents.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull() & F.col(id_column).isNotNull() & (_fold(id_column) != HELD_FOLD))
    sizes = {r[0]: r[1] for r in usable.groupBy(lang_column).agg(F.count("*")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], {}, np.zeros((0, 0)), [{}] * LONGEST, [np.zeros((0, 0))] * LONGEST, np.zeros(0))
    share = F.create_map(*[x for name, n in sizes.items() for x in (F.lit(name), F.lit(min(1.0, PER_LANGUAGE / n) * 2**31))])
    sample = usable.where(F.shiftrightunsigned(F.xxhash64(id_column), 33) < share[F.col(lang_column)]).select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"))

    def report(counts: Counter) -> pa.RecordBatch:
        keys = list(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], ["lang", "entry", "n"]
        )

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches, "text"):
            for language, text in zip(texts(batch, "lang").to_pylist(), texts(batch, "text").to_pylist(), strict=True):
                for word, n in Counter(words_of(text)).items():
                    counts[language, word] += n
            if len(counts) > FLUSH:
                yield report(counts)
                counts = Counter()
        yield report(counts)

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for language, word, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for length in range(1, LONGEST + 1):
                    for gram in grams_of(word, length):
                        counts[language, f"{length}{gram}"] += times
                if len(counts) > FLUSH:
                    yield report(counts)
                    counts = Counter()
        yield report(counts)

    schema = "lang string, entry string, n long"
    words = staged(arrow_map(sample, count_words, schema).groupBy("lang", "entry").agg(F.sum("n").alias("n")), "words")
    grams = staged(arrow_map(words.select("lang", "entry", "n"), count_grams, schema).groupBy("lang", "entry").agg(F.sum("n").alias("n")), "grams")
    column = {name: i for i, name in enumerate(languages)}
    number, logs, total = _scores(_most(words, "entry", MAX_WORDS).collect(), column)
    by_length = [
        _scores([(r[0][1:], r[1], r[2]) for r in _most(grams.where(F.substring("entry", 1, 1) == str(length)), "entry", MAX_GRAMS).collect()], column)
        for length in range(LONGEST, 0, -1)
    ]
    # A constant that only tells between texts about which the model knows nothing.
    prior = 1e-9 * np.log(total + 1)
    return Model(languages, number, logs, [x[0] for x in by_length], [x[1] for x in by_length], prior)


def identify(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: fold, language and confidence."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            names, shares = shared.value.predict(texts(batch, text_column).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [texts(batch, id_column).cast(pa.int64()), texts(batch, "held_out"), pa.array(names, pa.string()), pa.array(shares, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = documents.select(id_column, (_fold(id_column) == HELD_FOLD).alias("held_out"), text_column)
    return arrow_map(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


@query("op2_language_id")
def op2_language_id(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return identify(documents, train(documents))
