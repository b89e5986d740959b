"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

Terms are lower-cased runs of letters and digits; letters of scripts that are
written without spaces are terms one by one. Test items are indexed in
entries of at most ``ENTRY`` terms (a longer item has several). The impact of a
term in an entry is its BM25 weight divided by the entry's score for itself, so
one threshold fits all entries: ``MIN_SCORE`` of an entry's own score.

Every training passage (``2 * ENTRY`` terms, starting every ``ENTRY`` terms, so
that each stretch of ``ENTRY`` terms lies whole in one) queries the index and
retrieves all entries above the threshold. First, for a batch of passages at
once, the postings of rare terms are added up; an entry whose sum cannot reach
the threshold with all its other terms is ruled out. Passages with entries left
go through block-max WAND over all terms. What it retrieves is verified: at
least ``MIN_OVERLAP`` of the pairs of neighbouring terms of the question (all but
the last sentence) and of the answer (the last sentence; halves, if there is only
one) must stand in the passage.

The index is built by Spark and used in blocks of at most ``BLOCK_POSTINGS``
postings, one pass over the documents for each; one block is broadcast.

Edge cases: null and empty texts or items match nothing; of an item of two to
``SHORT - 1`` terms all neighbouring pairs must stand in the passage; a single term is
no evidence and is not searched; repeated document rows
give one row per id and item; rows with a null id are reported under null; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, query, staged, table
from .columns import PUNCTUATION, Words, slices, texts

ENTRY = 64
MIN_TERMS = 2
SHORT = 5  # items with fewer terms must be there in full
MIN_SCORE = 0.5
MIN_OVERLAP = 0.5
K1, B = 1.2, 0.75
BLOCK = 64  # postings under one maximum
BLOCK_POSTINGS = 2_000_000
RARE = 0.02  # share of entries that hold a rare term
SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)")

RESULT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


#: Letters of scripts without spaces between words.
UNSPACED = r"(\p{Han}|\p{Hiragana}|\p{Katakana}|\p{Thai}|\p{Lao}|\p{Khmer}|\p{Myanmar})"


#: First bytes of letters of these scripts (and of some others) in UTF-8.
_MAYBE_UNSPACED = np.isin(np.arange(256), [0xE0, 0xE1, *range(0xE3, 0xEA), 0xEF, 0xF0])


def plain(column: pa.Array) -> pa.Array:
    """Lower-cased texts, with spaces around every letter of an unspaced script."""
    lower = pc.utf8_lower(column).cast(pa.large_string())
    content = lower.buffers()[2]
    if content is None or not len(lower):
        return lower
    offset = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + len(lower) + 1]
    place = np.flatnonzero(_MAYBE_UNSPACED[np.frombuffer(content, np.uint8)[offset[0] : offset[-1]]]) + offset[0]
    rows = np.unique(np.searchsorted(offset, place, "right") - 1)
    if not len(rows):
        return lower
    spread = pc.replace_substring_regex(lower.take(pa.array(rows)), pattern=UNSPACED, replacement=r" \1 ")
    mask = np.zeros(len(lower), bool)
    mask[rows] = True
    return pc.replace_with_mask(lower, pa.array(mask), spread)


def terms(column: pa.Array) -> Words:
    return Words(plain(column), separators=PUNCTUATION)


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """Neighbouring terms as hashes; a lone term stands for itself."""
    if len(hashes) < 2:
        return hashes
    return np.unique(hashes[:-1] * np.uint64(3) + hashes[1:])


def _answer_start(text: str) -> int:
    """Byte where the last sentence begins; 0 if there is only one."""
    ends = [m.end() for m in SENTENCE.finditer(text) if text[m.end() :].strip()]
    return len(text[: ends[-1]].encode()) if ends else 0


def entries(benchmark: DataFrame, item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """``entry, item_id, terms, answer_at``: the term hashes of each entry, and where its answer begins; equal entries once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            lower = plain(texts(batch, text_column))
            words = Words(lower, separators=PUNCTUATION)
            item, part, found, answer = [], [], [], []
            for i, text in enumerate(lower.to_pylist()):
                a, b = words.first[i : i + 2].tolist()
                if b - a < MIN_TERMS:
                    continue
                parts = -(-(b - a) // ENTRY)
                split = int(np.searchsorted(words.start[a:b], _answer_start(text) + words.offset[i]))
                for k in range(parts):
                    lo, hi = (b - a) * k // parts, (b - a) * (k + 1) // parts
                    item.append(batch.column(0)[i].as_py())
                    part.append(k)
                    found.append(words.hash[a + lo : a + hi].view(np.int64).tolist())
                    whole = 0 if b - a < SHORT else (hi - lo) // 2  # a short item is all answer
                    answer.append(split if parts == 1 and 0 < split < b - a and whole else whole)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int64()), pa.array(part, pa.int32()), pa.array(found, pa.list_(pa.int64())), pa.array(answer, pa.int32())],
                ["item_id", "part", "terms", "answer_at"],
            )

    found = arrow_map(benchmark.select(item_column, text_column), cut, "item_id long, part int, terms array<long>, answer_at int")
    return found.withColumn("entry", F.xxhash64("item_id", "part", "terms")).drop("part").dropDuplicates(["entry"])


def postings(cut: DataFrame, n_entries: int, mean_length: float) -> DataFrame:
    """``entry, term, impact``: BM25 weights as shares of the entry's score for itself."""
    tf = cut.select("entry", F.size("terms").alias("len"), F.explode("terms").alias("term")).groupBy("entry", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((n_entries - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean_length))
    weighted = tf.join(df, "term").select("entry", "term", weight.alias("w"))
    own = weighted.groupBy("entry").agg(F.sum("w").alias("own"))
    return weighted.join(own, "entry").select("entry", "term", (F.col("w") / F.col("own")).alias("impact"))


class Index:
    """One block of the index as arrays; entries are numbered within it."""

    def __init__(self, cut: pa.Table, posted: pa.Table):
        cut = cut.take(pc.sort_indices(cut, [("entry", "ascending")]))
        self.item = cut.column("item_id").to_pylist()
        self.question, self.answer, self.wanted = [], [], []
        for found, at in zip(cut.column("terms").to_pylist(), cut.column("answer_at").to_pylist(), strict=True):
            found = np.array(found, np.int64).view(np.uint64)
            self.question.append(_pairs(found[:at]))
            self.answer.append(_pairs(found[at:]))
            self.wanted.append(1.0 if len(found) < SHORT else MIN_OVERLAP)
        entry = np.searchsorted(cut.column("entry").to_numpy(), posted.column("entry").to_numpy())
        hashed = posted.column("term").to_numpy().view(np.uint64)
        impact = posted.column("impact").to_numpy()
        order = np.lexsort((entry, hashed))
        entry, hashed, impact = entry[order], hashed[order], impact[order]
        self.terms, begin = np.unique(hashed, return_index=True)
        self.begin = np.append(begin, len(hashed))
        self.entry, self.impact = entry, impact
        self.df = np.diff(self.begin)
        self.most = np.maximum.reduceat(impact, begin) if len(begin) else impact
        # Block maxima of every list, one after the other.
        blocks = -(-self.df // BLOCK)
        self.block_begin = np.concatenate([[0], np.cumsum(blocks)])
        starts = np.repeat(self.begin[:-1], blocks) + BLOCK * (np.arange(self.block_begin[-1]) - np.repeat(self.block_begin[:-1], blocks))
        self.block_most = np.maximum.reduceat(impact, starts) if len(starts) else impact
        # Rare terms, and as many more of each entry as leave it below the threshold without them.
        rare = np.repeat(self.df <= max(3, RARE * len(self.item)), self.df)
        essential = rare.copy()
        term_of = np.repeat(np.arange(len(self.terms)), self.df)
        left = np.bincount(entry[~rare], impact[~rare], len(self.item)) if len(entry) else np.zeros(0)
        for at in np.lexsort((impact, self.df[term_of], entry)).tolist() if len(entry) else ():
            if not essential[at] and left[entry[at]] >= 0.8 * MIN_SCORE:
                essential[at] = True
                left[entry[at]] -= impact[at]
        self.rest = left
        self.first_begin = np.concatenate([[0], np.cumsum(np.bincount(term_of[essential], minlength=len(self.terms)))])
        self.first_entry, self.first_impact = entry[essential], impact[essential]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.terms & np.uint64(0xFFFF)).astype(np.int64)] = True

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers of hashes, -1 for those that no entry holds."""
        out = np.full(len(hashes), -1, np.int64)
        at = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if len(at) and len(self.terms):
            found = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
            out[at] = np.where(self.terms[found] == hashes[at], found, -1)
        return out

    def candidates(self, passage: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Passages for which some entry may still reach the threshold, by the postings of first terms."""
        size = (self.first_begin[1:] - self.first_begin[:-1])[term]
        total = int(size.sum())
        if not total:
            return np.zeros(0, np.int64)
        at = np.repeat(self.first_begin[:-1][term] - (np.cumsum(size) - size), size) + np.arange(total)
        key = np.repeat(passage, size) * len(self.item) + self.first_entry[at]
        pair, back = np.unique(key, return_inverse=True)
        sums = np.bincount(back, self.first_impact[at])
        good = sums + self.rest[pair % len(self.item)] >= MIN_SCORE - 1e-9
        return np.unique(pair[good] // len(self.item))

    def retrieve(self, term: np.ndarray, threshold: float = MIN_SCORE) -> list[tuple[int, float]]:
        """All entries that reach the threshold for the given distinct terms: block-max WAND."""
        end = len(self.item)
        lists = [[int(self.entry[self.begin[t]]), int(self.begin[t]), int(t)] for t in sorted(term.tolist())]
        out = []
        while True:
            lists = [x for x in lists if x[0] < end]
            lists.sort()
            bound, pivot = 0.0, None
            for n, (entry, _, t) in enumerate(lists):
                bound += self.most[t]
                if bound >= threshold - 1e-9:
                    pivot = entry
                    while n + 1 < len(lists) and lists[n + 1][0] == pivot:
                        n += 1
                    break
            if pivot is None:
                return out
            here = lists[: n + 1]
            bound, following = 0.0, lists[n + 1][0] if n + 1 < len(lists) else end
            for _, at, t in here:
                block = self._block(t, at, pivot)
                if block is None:
                    continue
                bound += self.block_most[block]
                last = min(self.begin[t + 1], self.begin[t] + BLOCK * (block - self.block_begin[t] + 1)) - 1
                following = min(following, int(self.entry[last]) + 1)
            if bound < threshold - 1e-9:  # no entry up to the end of these blocks can reach it
                self._move(here, max(following, pivot + 1))
            elif here[0][0] == pivot:
                score = math.fsum(self.impact[at] for _, at, _ in here)
                if score >= threshold - 1e-9:
                    out.append((pivot, score))
                self._move(here, pivot + 1)
            else:
                self._move(here, pivot)

    def _block(self, term: int, at: int, entry: int) -> int | None:
        """The block of a list that holds the first posting from an entry on."""
        to = at + int(np.searchsorted(self.entry[at : self.begin[term + 1]], entry))
        if to >= self.begin[term + 1]:
            return None
        return int(self.block_begin[term]) + (to - int(self.begin[term])) // BLOCK

    def _move(self, lists: list[list[int]], entry: int) -> None:
        for x in lists:
            if x[0] < entry:
                x[1] += int(np.searchsorted(self.entry[x[1] : self.begin[x[2] + 1]], entry))
                x[0] = int(self.entry[x[1]]) if x[1] < self.begin[x[2] + 1] else len(self.item)


def _overlap(wanted: np.ndarray, there: np.ndarray) -> float:
    return float(np.isin(wanted, there).sum()) / len(wanted) if len(wanted) else 1.0


def matches(words: Words, index: Index) -> Iterator[tuple[int, int, float, float, float]]:
    """Verified ``text, entry, score, question overlap, answer overlap`` of all passages of a slice."""
    number = index.number(words.hash)
    at = np.flatnonzero(number >= 0)
    if not len(at):
        return
    text = words.text_of()[at]
    steps = np.maximum(1, -(-words.counts // ENTRY))
    base = np.concatenate([[0], np.cumsum(steps)])
    step = (at - words.first[text]) // ENTRY
    ahead = step > 0
    passage = np.concatenate([base[text] + step, (base[text] + step)[ahead] - 1])
    n_terms = len(index.terms)
    pair = np.unique(passage * n_terms + np.concatenate([number[at], number[at][ahead]]))
    passage, term = pair // n_terms, pair % n_terms
    for one in index.candidates(passage, term).tolist():
        a, b = np.searchsorted(passage, [one, one + 1])
        retrieved = index.retrieve(term[a:b])
        if not retrieved:
            continue
        doc = int(np.searchsorted(base, one, "right")) - 1
        begin = words.first[doc] + ENTRY * (one - base[doc])
        there = words.hash[begin : min(begin + 2 * ENTRY, words.first[doc + 1])]
        there = np.concatenate([_pairs(there), there])
        for entry, score in retrieved:
            both = [_overlap(wanted, there) for wanted in (index.question[entry], index.answer[entry])]
            if min(both) >= index.wanted[entry]:
                yield doc, entry, score, *both


def _blocks(benchmark: DataFrame, item_column: str, text_column: str) -> Iterator[Index]:
    cut = staged(entries(benchmark, item_column, text_column), "entries")
    n, total = cut.agg(F.count("*"), F.sum(F.size("terms"))).first()
    if not n:
        return
    posted = staged(postings(cut, n, total / n), "index")
    parts = -(-total // BLOCK_POSTINGS)
    mine = F.pmod("entry", F.lit(parts))
    for part in range(parts):
        yield Index(cut.where(mine == part).toArrow(), posted.where(mine == part).toArrow())


def _flagged(index: Index, batch: pa.RecordBatch, text_column: str):
    return matches(terms(texts(batch, text_column)), index)


def contaminated(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """One row per document and test item that it contains, with the best passage's figures."""
    narrow = documents.select(id_column, text_column)
    found = narrow.sparkSession.createDataFrame([], RESULT)
    for index in _blocks(benchmark, item_column, item_text_column):
        shared = narrow.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text_column):
                rows = list(_flagged(shared.value, batch, text_column))
                doc, entry, *figures = zip(*rows) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [
                        texts(batch, id_column).cast(pa.int64()).take(pa.array(doc, pa.int64())),
                        pa.array([shared.value.item[e] for e in entry], pa.int64()),
                        *(pa.array(x, pa.float64()) for x in figures),
                    ],
                    ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                )

        found = found.unionByName(arrow_map(narrow, search, RESULT))
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """The documents that contain no test item, with all their columns; no row is moved."""
    for index in _blocks(benchmark, item_column, item_text_column):
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text_column):
                clean = np.ones(batch.num_rows, bool)
                clean[[row[0] for row in _flagged(shared.value, batch, text_column)]] = False
                yield batch.filter(pa.array(clean))

        documents = arrow_map(documents, search, documents.schema)
    return documents


@query("op5_benchmark_decontamination")
def op5_benchmark_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
