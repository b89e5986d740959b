"""Ranked lexical search: BM25 in integers, MaxScore with bounds of term pairs.

One scan of the documents keeps the postings of all terms that some item asks
for, with each document's length; from them come the corpus figures and the
impact of a term in a document (its part of the score), all exact integers.

The index consists of shards of ``SHARD`` documents. A shard has a list of
documents and impacts for each term, and, for pairs of terms of one item, the
documents that hold both with the greatest sum of their two impacts. An item's
terms are paired greatest weight first, each term once.

A shard answers an item by MaxScore. The documents of its best pair lists are
scored first, which gives a threshold. Terms in ascending order of their
greatest impact are left out as long as no document with these terms alone could
reach it. Such a bound is not the sum of the terms' maxima: a document that holds
both terms of a pair adds at most the pair's joint maximum, any other at most the
larger of the two. Only the lists of the terms that are not left out are read;
their documents go through the left-out terms one by one while the bound of those
still missing allows, and the threshold rises. A document with a score equal to
the threshold is never skipped, so the result is exact.

Items are searched in blocks of at most ``BLOCK_TERMS`` terms, one scan for each;
one block's terms, weights and items are broadcast. A shard sends its best
``k`` rows an item; ranks are taken per slice of the shards first.

Edge cases: a null text or item has no term; items without a term, or none of
whose terms occurs with a positive weight, have no rows; rows of one item id are
one item with the terms of all; a null item id is an item; repeated document rows
are ranked each, equal scores by ascending id, a null id last; an empty table
gives an empty result. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import arrow_map, query, staged, table
from .columns import PUNCTUATION, Words, slices, texts

TOP = 50
SHARD = 8192  # documents of one shard
SHARD_POSTINGS = 2_000_000  # or so many postings, if they come first
BLOCK_TERMS = 200_000
SLICES = 64  # slices of shards in which ranks are taken first

LIST = "shard long, a int, b int, docs binary, impacts binary, top long"


def terms(column: pa.Array) -> Words:
    return Words(column, lower=True, separators=PUNCTUATION)


def item_terms(items: DataFrame, item_column: str, text_column: str) -> DataFrame:
    """``item_id, term``, each once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            words = terms(texts(batch, text_column))
            ids = texts(batch, item_column).cast(pa.int64()).take(pa.array(words.text_of()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(words.hash.view(np.int64))], ["item_id", "term"])

    return arrow_map(items.select(item_column, text_column), cut, "item_id long, term long").distinct()


def _blocks(wanted: DataFrame) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Items with their terms, so many at a time as ``BLOCK_TERMS`` allows; a longer item is a block of its own."""
    block, size, held, last = [], 0, [], None
    for row in wanted.orderBy("item_id", "term").toLocalIterator():
        if held and row.item_id != last:
            block.append((last, np.array(held, np.int64)))
            size, held = size + len(held), []
            if size >= BLOCK_TERMS:
                yield block
                block, size = [], 0
        last = row.item_id
        held.append(row.term)
    if held:
        block.append((last, np.array(held, np.int64)))
    if block:
        yield block


def postings(documents: DataFrame, vocabulary: np.ndarray, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, n, terms, times`` of every document with a term: its length, the numbers of its terms in the sorted vocabulary and how often each occurs."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, text_column):
            words = terms(texts(batch, text_column))
            hashed = words.hash.view(np.int64)
            at = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
            hit = np.flatnonzero(known[at] == hashed)
            key, times = np.unique(words.text_of()[hit] * len(known) + at[hit], return_counts=True)
            begin = np.searchsorted(key, np.arange(batch.num_rows + 1) * len(known)).astype(np.int32)
            filled = pa.array(words.counts > 0)
            lists = [pa.ListArray.from_arrays(pa.array(begin), pa.array(x.astype(np.int32))) for x in (key % len(known), times)]
            columns = [texts(batch, id_column).cast(pa.int64()), pa.array(words.counts), *lists]
            yield pa.RecordBatch.from_arrays([c.filter(filled) for c in columns], ["doc_id", "n", "terms", "times"])

    return staged(arrow_map(documents.select(id_column, text_column), scan, "doc_id long, n long, terms array<int>, times array<int>"), "postings")


def frequencies(posted: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["term", "df"])

    rows = arrow_map(posted.select("terms"), count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(n_terms, np.int64)
    out[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return out


def weights(df: np.ndarray, n_documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)


def impacts(weight: np.ndarray, times: np.ndarray, n: np.ndarray, n_documents: int, length: int) -> np.ndarray:
    m = 50 + 50 * n * n_documents // length
    return weight * (1_000_000_000 * times // (1000 * times + 20 * m))


class Item:
    """An item's term numbers, and which of them are pairs (``a < b``)."""

    def __init__(self, item_id: int | None, numbers: np.ndarray, weight: np.ndarray):
        self.item_id = item_id
        self.terms = np.sort(numbers[weight[numbers] > 0])
        heavy = self.terms[np.argsort(-weight[self.terms], kind="stable")].tolist()
        self.pairs = [tuple(sorted(p)) for p in zip(heavy[::2], heavy[1::2])]


def build_index(posted: DataFrame, items: list[Item], weight: np.ndarray, n_documents: int, length: int, shard_documents: int = SHARD) -> DataFrame:
    """The lists of all shards, by shard: ``a`` alone is a term, ``a, b`` a pair, neither the document ids (in ``impacts``; null ids are told in ``docs``)."""
    plan = posted.sparkSession.sparkContext.broadcast((sorted({p for item in items for p in item.pairs}), weight))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, w = plan.value
        partition, number = _task(), 0
        held, size = [], [0, 0]

        def lists():
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            found = rows.column("doc_id")
            times_of = np.diff(rows.column("terms").offsets.to_numpy())
            doc = np.repeat(np.arange(rows.num_rows, dtype=np.int32), times_of)
            term, times = (rows.column(c).flatten().to_numpy() for c in ("terms", "times"))
            worth = impacts(w[term], times.astype(np.int64), rows.column("n").to_numpy()[doc], n_documents, length)
            some = np.flatnonzero(worth)
            some = some[np.argsort(term[some], kind="stable")]
            doc, term, worth = doc[some], term[some], worth[some]
            names, begin = np.unique(term, return_index=True)
            cut = dict(zip(names.tolist(), zip(begin.tolist(), np.append(begin[1:], len(term)).tolist()), strict=True))
            ids = found.fill_null(0).to_numpy()
            out = [(None, None, np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False)).astype(np.int32), ids, 0)]
            for t, (lo, hi) in cut.items():
                out.append((t, None, doc[lo:hi], worth[lo:hi], int(worth[lo:hi].max())))
            for a, b in pairs:
                if a in cut and b in cut:
                    (lo, hi), (low, high) = cut[a], cut[b]
                    both, i, j = np.intersect1d(doc[lo:hi], doc[low:high], assume_unique=True, return_indices=True)
                    if len(both):
                        joint = worth[lo:hi][i] + worth[low:high][j]
                        out.append((a, b, both, joint, int(joint.max())))
            shard = (partition << 24) + number
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * len(out), pa.int64()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()),
                    pa.array([x.astype(np.int32).tobytes() for x in columns[2]], pa.binary()), pa.array([x.astype(np.int64).tobytes() for x in columns[3]], pa.binary()),
                    pa.array(columns[4], pa.int64()),
                ],
                ["shard", "a", "b", "docs", "impacts", "top"],
            )

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                here = batch.slice(at, min(1024, shard_documents - size[0]))
                held.append(here)
                size = [size[0] + here.num_rows, size[1] + len(here.column("terms").flatten())]
                at += here.num_rows
                if size[0] >= shard_documents or size[1] >= SHARD_POSTINGS:
                    yield lists()
                    held, size, number = [], [0, 0], number + 1
        if held:
            yield lists()

    return arrow_map(posted, build, LIST)


def _task() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


class Shard:
    """The lists of one shard."""

    def __init__(self, rows: pa.Table):
        self.lists, self.pairs, self.top = {}, {}, {}
        for a, b, docs, worth, top in zip(*(rows.column(c).to_pylist() for c in ("a", "b", "docs", "impacts", "top")), strict=True):
            docs, worth = np.frombuffer(docs, np.int32), np.frombuffer(worth, np.int64)
            if a is None:
                self.ids, self.unnamed = worth, docs
            elif b is None:
                self.lists[a], self.top[a] = (docs, worth), top
            else:
                self.pairs[a, b] = docs, worth, top

    def bound(self, left_out: set[int], item: Item) -> int:
        """The most that a document can add up from these terms: joint maxima for pairs, maxima for the rest."""
        total, paired = 0, set()
        for pair in item.pairs:
            if left_out.issuperset(pair):
                tops = [self.top.get(t, 0) for t in pair]
                total += max(*tops, self.pairs[pair][2] if pair in self.pairs else 0)
                paired.update(pair)
        return total + sum(self.top.get(t, 0) for t in left_out - paired)

    def _add(self, docs: np.ndarray, score: np.ndarray, term: int) -> None:
        there, worth = self.lists[term]
        at = np.minimum(np.searchsorted(there, docs), len(there) - 1)
        score += np.where(there[at] == docs, worth[at], 0)

    def score(self, docs: np.ndarray, item: Item) -> np.ndarray:
        total = np.zeros(len(docs), np.int64)
        for term in item.terms.tolist():
            if term in self.lists:
                self._add(docs, total, term)
        return total

    def seeds(self, item: Item, k: int) -> np.ndarray:
        """Documents of the pair lists with the greatest joint maxima, ``k`` if there are as many."""
        found = np.zeros(0, np.int32)
        for pair in sorted((p for p in item.pairs if p in self.pairs), key=lambda p: -self.pairs[p][2]):
            docs, joint, _ = self.pairs[pair]
            found = np.union1d(found, docs[np.argsort(-joint, kind="stable")[:k]])
            if len(found) >= k:
                break
        return found

    def best(self, item: Item, k: int, read: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the ``k`` best, and maybe others; ``read`` gets the terms whose lists were read."""
        by = sorted((t for t in item.terms.tolist() if t in self.lists), key=lambda t: (self.top[t], t))
        threshold = 1
        seeds = self.seeds(item, k)
        if len(seeds) >= k:
            threshold = max(1, int(np.partition(self.score(seeds, item), len(seeds) - k)[len(seeds) - k]))
        first = 0  # terms before it are left out
        while first < len(by) and self.bound(set(by[: first + 1]), item) < threshold:
            first += 1
        if read is not None:
            read += by[first:]
        if first == len(by):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        total = np.zeros(len(self.ids), np.int64)
        for term in by[first:]:
            docs, worth = self.lists[term]
            total[docs] += worth
        docs = np.flatnonzero(total)
        score = total[docs]
        for last in range(first, -1, -1):
            if len(score) >= k:  # scores so far are lower bounds, so they raise the threshold
                threshold = max(threshold, int(np.partition(score, len(score) - k)[len(score) - k]))
            good = score + self.bound(set(by[:last]), item) >= threshold
            docs, score = docs[good], score[good]
            if last:
                self._add(docs, score, by[last - 1])
        return docs, score

    def ranked(self, item: Item, k: int) -> tuple[pa.Array, np.ndarray]:
        """Ids and scores of the ``k`` best rows."""
        docs, score = self.best(item, k)
        unnamed = np.isin(docs, self.unnamed)
        order = np.lexsort((self.ids[docs], unnamed, -score))[:k]
        return pa.array(self.ids[docs[order]], mask=unnamed[order]), score[order]


def lexical_search(documents: DataFrame, items: DataFrame, k: int = TOP, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", shard_documents: int = SHARD) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest scores above 0 for each item."""
    spark = documents.sparkSession
    found = spark.createDataFrame([], "item_id long, doc_id long, score long, slice int")
    for block in _blocks(staged(item_terms(items, item_column, item_text_column), "item-terms")):
        vocabulary = np.unique(np.concatenate([x for _, x in block]))
        posted = postings(documents, vocabulary, id_column, text_column)
        n_documents, length = posted.agg(F.count("*"), F.sum("n")).first()
        if not n_documents:
            break
        weight = weights(frequencies(posted, len(vocabulary)), n_documents)
        asked = [Item(i, np.searchsorted(vocabulary, x), weight) for i, x in block]
        index = staged(build_index(posted, asked, weight, n_documents, length, shard_documents), "index")
        shared = spark.sparkContext.broadcast(asked)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for shard, rows in _shards(batches):
                one = Shard(rows)
                for item in shared.value:
                    ids, score = one.ranked(item, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item.item_id] * len(ids), pa.int64()), ids, pa.array(score), pa.array([shard % SLICES] * len(ids), pa.int32())],
                        ["item_id", "doc_id", "score", "slice"],
                    )

        lists = index.repartition("shard").sortWithinPartitions("shard")
        found = found.unionByName(arrow_map(lists, search, "item_id long, doc_id long, score long, slice int"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item_id", "slice"], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Whole shards of rows that are sorted by shard."""
    held, last = [], None
    for batch in batches:
        shard = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            if held and shard[lo] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = int(shard[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield last, pa.Table.from_batches(held)


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS t FROM documents
), d AS (SELECT r, doc_id, t, len(t) AS n FROM w WHERE len(t) > 0),
c AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark
), p AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term
), f AS (
  SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, c GROUP BY term, big_n
), i AS (
  SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // l))) AS impact FROM p JOIN d USING (r) JOIN f USING (term), c
), s AS (SELECT item_id, r, doc_id, sum(impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
) WHERE rank <= {TOP}
"""


@query("op11_lexical_search", ORACLE)
def op11_lexical_search(spark, sf_dir):
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
