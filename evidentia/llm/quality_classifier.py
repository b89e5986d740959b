"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every document becomes a short vector of statistics of its whole text. Trees are
fitted on at most ``MAX_TRAIN`` labelled documents (those with the smallest
hashed id): values are put in at most ``BINS`` bins by quantile, and each tree
level takes its splits from gradient and hessian histograms. The trees are
flattened into arrays, and a batch walks all trees with one gather per level.

Edge cases: a null text counts as empty, and empty texts get a score like any
other vector; documents without label are scored and not learned from; a null id
is never held out nor learned from; without any label every score is 0.5; with
labels of one class only, scores are near that class; repeated rows are scored
one by one (a repeated label counts once); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, query, staged, table
from .columns import Words, mix, slices, texts

MAX_TRAIN = 20_000
BINS = 64
TREES = 60
DEPTH = 4
RATE = 0.2
MIN_HESSIAN = 2.0
RIDGE = 1.0
CUT = 0.3
FOLDS, HELD_FOLD = 5, 0

FEATURES = (
    "log_bytes log_words word_length long_word symbols bars digits capitals points commas bangs white others "
    "lines dup_lines repeat_words distinct_words top_word same_next capital_words symbol_words entropy"
).split()


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_SIGN = _class("#*$%&|<>@~^_=+\\{}[]")


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    words = Words(column)
    n_texts = len(words.first) - 1
    data, offset, first = words.data, words.offset, words.first

    def by_text(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (sums[at[1:]] - sums[at[:-1]]).astype(np.float64)

    def in_word(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[words.end] - sums[words.start]

    def share_of_words(mask: np.ndarray) -> np.ndarray:
        return by_text(mask, first) / n

    size = np.diff(offset).astype(np.float64)
    n_words = words.counts.astype(np.float64)
    b, n = np.maximum(size, 1), np.maximum(n_words, 1)
    length = words.end - words.start
    longest = np.zeros(n_texts)
    text = words.text_of()
    np.maximum.at(longest, text, length)
    # Occurrences of each word within its text.
    key = mix(words.hash + mix(text.astype(np.uint64) + np.uint64(1)))
    _, at, back, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    top = np.zeros(n_texts)
    np.maximum.at(top, text[at], times)
    new = np.zeros(len(words), bool)
    new[at] = True
    same = np.zeros(len(words), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (text[1:] == text[:-1])
    covered = np.zeros(len(words), bool)
    whole = np.flatnonzero(words.whole(3))
    if len(whole):
        three = mix(words.sequences(3)[whole] + mix(text[whole].astype(np.uint64) + np.uint64(1)))
        _, back, times = np.unique(three, return_inverse=True, return_counts=True)
        for step in range(3):
            covered[whole[times[back] > 1] + step] = True
    lines, dup = np.zeros(n_texts), np.zeros(n_texts)
    for i, t in enumerate(column.to_pylist()):
        full = [x for x in (t or "").split("\n") if x.strip(" \t\v\f\r")]
        lines[i], dup[i] = len(full), len(full) - len(set(full))
    counts = np.bincount(np.repeat(np.arange(n_texts), np.diff(offset)) * 256 + data, minlength=256 * n_texts).reshape(n_texts, 256) / b[:, None]
    entropy = -(counts * np.log2(np.where(counts > 0, counts, 1))).sum(axis=1)
    capital, letter, sign = in_word(_CAPITAL[data]), in_word(_LETTER[data]), in_word(_SIGN[data])
    columns = [
        np.log1p(size), np.log1p(n_words), by_text(~_class(" \t\n\v\f\r")[data], offset) / n, np.log1p(longest),
        by_text(_SIGN[data], offset) / b, by_text(_class("|")[data], offset) / b, by_text(_class("0123456789")[data], offset) / b,
        by_text(_CAPITAL[data], offset) / b, by_text(_class(".")[data], offset) / n, by_text(_class(",;:")[data], offset) / n,
        by_text(_class("!?")[data], offset) / n, by_text(_class(" \t\n\v\f\r")[data], offset) / b, by_text(data >= 128, offset) / b,
        lines / n, dup / np.maximum(lines, 1), share_of_words(covered), share_of_words(new), top / n, share_of_words(same),
        share_of_words((capital > 1) & (capital == letter)), share_of_words(sign > 0), entropy,
    ]
    return np.stack(columns, axis=1).astype(np.float32)


@dataclass
class Trees:
    """All trees in one set of arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, values: np.ndarray) -> np.ndarray:
        total = np.full(len(values), self.base)
        rows = np.arange(len(values))
        for root in self.roots.tolist():
            node = np.full(len(values), root)
            for _ in range(DEPTH):
                node = np.where(values[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(values: np.ndarray, label: np.ndarray) -> Trees:
    """Boosted trees for the logistic loss."""
    n, width = values.shape
    if not n:
        return Trees(np.zeros(1, np.int64), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1), np.zeros(0, np.int64), 0.0)
    edges = [np.unique(np.quantile(values[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], values[:, f], "left") for f in range(width)], axis=1)
    shift = np.arange(width) * BINS
    rate = (label.sum() + 1) / (n + 2)
    base = float(np.log(rate / (1 - rate)))
    total = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf() -> int:
        number = len(feature)
        for column, x in ((feature, 0), (threshold, 0.0), (left, number), (right, number), (value, 0.0)):
            column.append(x)
        return number

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = label - p, np.maximum(p * (1 - p), 1e-9)
        roots.append(leaf())
        where, level = np.full(n, roots[-1]), [roots[-1]]
        for _ in range(DEPTH):
            following = []
            for node in level:
                rows = np.flatnonzero(where == node)
                slot = (binned[rows] + shift).ravel()
                g, h = (np.bincount(slot, np.repeat(x[rows], width), BINS * width).reshape(width, BINS).cumsum(axis=1) for x in (gradient, hessian))
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
                gain[(h < MIN_HESSIAN) | (h_all - h < MIN_HESSIAN)] = 0
                f, cut = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, cut] <= 1e-6:
                    continue
                feature[node], threshold[node] = int(f), float(edges[f][cut])
                left[node], right[node] = leaf(), leaf()
                where[rows] = np.where(binned[rows, f] <= cut, left[node], right[node])
                following += [left[node], right[node]]
            level = following
        ends, back = np.unique(where, return_inverse=True)
        step = RATE * np.bincount(back, gradient) / (np.bincount(back, hessian) + RIDGE)
        for node, x in zip(ends.tolist(), step.tolist(), strict=True):
            value[node] = x
        total += step[back]
    return Trees(*(np.array(x) for x in (feature, threshold, left, right, value, roots)), base)


def _fold(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS, F.lit(-1))


def train(vectors: DataFrame, labels: DataFrame, at_most: int = MAX_TRAIN) -> Trees:
    """Trees from labelled vectors outside the held-out fold."""
    usable = labels.where("quality in (0, 1) and doc_id is not null").where(_fold("doc_id") != HELD_FOLD)
    usable = usable.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    chosen = usable.orderBy((F.col("doc_id") * 2_654_435_761) % 4_294_967_296, "doc_id").limit(at_most)
    # At most ``at_most`` pairs of an id and a label are broadcast.
    rows = vectors.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("vector").alias("vector"), F.max("label").alias("label"))
    found = sorted((r[0], bytes(r[1]), r[2]) for r in rows.toLocalIterator())
    values = np.frombuffer(b"".join(x[1] for x in found), np.float32).reshape(-1, len(FEATURES))
    return fit(values, np.array([x[2] for x in found], np.float64))


def quality_scores(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: whether it is held out, its score and the prediction."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            rows = statistics(texts(batch, text_column))
            yield pa.RecordBatch.from_arrays([texts(batch, id_column).cast(pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "vector"])

    vectors = staged(arrow_map(documents.select(id_column, text_column), describe, "doc_id long, vector binary"), "vectors")
    trees = documents.sparkSession.sparkContext.broadcast(train(vectors, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([np.frombuffer(x, np.float32) for x in batch.column(2).to_pylist()], np.float32).reshape(-1, len(FEATURES))
            p = trees.value.score(values)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = vectors.select("doc_id", (_fold("doc_id") == HELD_FOLD).alias("held_out"), "vector")
    return arrow_map(rows, score, "doc_id long, held_out boolean, score double, predicted int")


@query("op6_quality_classifier")
def op6_quality_classifier(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
