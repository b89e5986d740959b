"""Repeated passages by seed and extend over winnowed anchors.

Seeds. Every window of ``LENGTH`` words has one anchor: the smallest hash among
its runs of ``SEED`` words. Two equal windows have equal anchors, so they meet
when documents are joined on anchors. Neighbouring windows share their anchor
occurrence; such a stretch is one row. Anchors that occur once are left out
before the join by a filter over the counts of all anchors.

Extension. Rows that meet on an anchor are compared at every offset to both
sides at once: occurrences whose ``LENGTH`` words around the anchor hash alike
at that offset extend each other over that window. The union of the windows so
found is the union of the maximal repeats of at least ``LENGTH`` words.

An anchor that occurs more than ``HOT`` times is dealt out by salt. Windows that
meet a partner within their part are settled there; the others are counted once
more by their hash, with partial sums and with the settled ones, so no anchor is
handled in one group.

Edge cases: a null or empty text has no words and keeps none; texts shorter than
``LENGTH`` words lose nothing; equal rows count as two documents, so a repeated
row of at least ``LENGTH`` words loses all words in both; a null id is one more
id; an empty table gives an empty result. Of a long run of one word every window
is a repeat of its neighbour.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, query, release, staged, table
from .bloom import bloom
from .columns import Words, mix, slices, texts

LENGTH = 35
SEED = 8
HOT = 2_000
MAX_HOT = 1_000_000  # hot anchors told to the tasks; the threshold grows so that no more exist

_STRETCH = pa.schema([("anchor", pa.int64()), ("salt", pa.int32()), ("key", pa.int64()), ("start", pa.int32()), ("windows", pa.binary())])
_SPAN = pa.schema([("key", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("window", pa.int64()), ("times", pa.int32())])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` values from a position on; only where they all exist."""
    out, size = values, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def stretches(words: Words, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, and where stretches of one anchor begin among them with the anchor's hash."""
    at = np.flatnonzero(words.whole(length))
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    low = np.uint64((1 << 22) - 1)
    number = np.arange(len(words), dtype=np.uint64)
    grams = words.sequences(seed)
    least = _sliding_min(grams & ~low | number & low, length - seed + 1)[at]
    place = at + ((least & low).astype(np.int64) - at) % (1 << 22)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(place) != 0) | (np.diff(at) != 1)
    first = np.flatnonzero(new)
    return at, first, grams[place[first]]


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def repeated_spans(documents: DataFrame, length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """``key, first, last``: word ranges (last excluded) of repeated windows, for rows of ``key, text``."""
    spark = documents.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, _, anchor = stretches(Words(texts(batch, "text")), length, seed)
            found, n = np.unique(anchor, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(found)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    counted = arrow_map(documents.select("text"), count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    shared = staged(counted.where("n > 1"), "anchors")
    n_shared, n_rows = shared.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    limit = max(hot, n_rows // MAX_HOT + 1)
    often = {r[0]: -(-r[1] // limit) for r in shared.where(F.col("n") > limit).toLocalIterator()}
    parts = np.array([sorted(often), [often[k] for k in sorted(often)]], np.int64).reshape(2, -1)
    known = spark.sparkContext.broadcast((bloom(shared, "anchor", n_shared), parts))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, (hot_anchor, hot_parts) = known.value
        for batch in slices(batches, "text"):
            words = Words(texts(batch, "text"))
            at, first, anchor = stretches(words, length, seed)
            if not len(at):
                continue
            size = np.diff(np.append(first, len(at)))
            keep = bits.has(anchor)
            first, anchor, size = first[keep], _signed(anchor[keep]), size[keep]
            text = np.searchsorted(words.first, at[first], "right") - 1
            key = batch.column(batch.schema.get_field_index("key")).to_numpy(zero_copy_only=False)[text]
            start = at[first] - words.first[text]
            salt = np.full(len(first), -1, np.int64)
            if len(hot_anchor):
                where = np.minimum(np.searchsorted(hot_anchor, anchor), len(hot_anchor) - 1)
                is_hot = hot_anchor[where] == anchor
                spread = mix(key.astype(np.int64).view(np.uint64) + start.astype(np.uint64))
                salt[is_hot] = (spread % hot_parts[where].astype(np.uint64)).astype(np.int64)[is_hot]
            window = words.sequences(length)[at[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]]
            ends = np.concatenate([[0], np.cumsum(size * 8)]).astype(np.int32)
            blob = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(window))])
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(salt.astype(np.int32)), pa.array(key), pa.array(start.astype(np.int32)), blob], schema=_STRETCH)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the anchor that may go on in the next batch
        for batch in batches:
            anchor, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(anchor):
                continue
            last = np.flatnonzero((anchor != anchor[-1]) | (salt != salt[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            head = held[-1] if held else None
            goes_on = head is not None and head.column(0)[0].as_py() == anchor[0] and head.column(1)[0].as_py() == salt[0]
            if held and not goes_on:
                yield from _settle(held, length)
                held = []
            if cut:
                yield from _settle([*held, batch.slice(0, cut)], length)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from _settle(held, length)

    met = arrow_map(documents.select("key", "text"), seeds, "anchor long, salt int, key long, start int, windows binary")
    met = met.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    found = staged(arrow_map(met, extend, "key long, first int, last int, window long, times int"), "spans")
    del met
    release(spark)
    open_ = found.where("window is not null")
    again = open_.groupBy("window").agg(F.sum("times").alias("n")).where("n > 1").select("window")
    late = open_.where("first < last").join(again, "window").select("key", "first", "last")
    return found.where("window is null").select("key", "first", "last").unionByName(late)


def _settle(batches: list[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans of windows that occur twice among complete groups; unsettled windows of salted groups."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    blob = pa.concat_arrays(rows.column("windows").chunks).cast(pa.large_binary())
    ends = np.frombuffer(blob.buffers()[1], np.int64)[blob.offset : blob.offset + len(blob) + 1]
    window = np.frombuffer(blob.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint64)
    size = np.diff(ends) // 8
    row = np.repeat(np.arange(len(size)), size)
    key, salt = rows.column("key").to_numpy(), rows.column("salt").to_numpy()
    place = rows.column("start").to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    if (salt < 0).all():
        _, back, n = np.unique(window, return_inverse=True, return_counts=True)
    else:  # parts of one hot anchor may share a batch; they must not settle each other's count twice
        _, back, n = np.unique(mix(window + mix((salt[row] + 2).astype(np.uint64))), return_inverse=True, return_counts=True)
    twice = n[back] > 1
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (twice[1:] != twice[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(row)) - 1
    good = twice[begin]
    begin, end = begin[good], end[good]
    # Of salted groups: windows without partner here, and once each the settled ones, to be their partner.
    salted = salt[row] >= 0
    lone = np.flatnonzero(~twice & salted)
    _, told = np.unique(back, return_index=True)
    told = told[twice[told] & salted[told]]
    spot, stop = np.concatenate([begin, lone, told]), np.concatenate([end, lone, told])
    n_spans, n_told = len(begin), len(told)
    last = place[stop] + length
    last[len(spot) - n_told :] = place[told]  # an empty span
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(key[row[spot]]),
            pa.array(place[spot].astype(np.int32)),
            pa.array(last.astype(np.int32)),
            pa.array(_signed(window[spot]), mask=np.arange(len(spot)) < n_spans),
            pa.array(np.where(np.arange(len(spot)) < len(spot) - n_told, 1, 2).astype(np.int32)),
        ],
        schema=_SPAN,
    )


def _kept(text: str | None, spans) -> tuple[int, list[bytes]]:
    """How many words a text has, and those outside the spans."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if not spans:
        return len(words), words
    gone = np.zeros(len(words) + 1, np.int64)
    for span in spans:
        gone[span["first"]] += 1
        gone[span["last"]] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    return len(words), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def _with_spans(documents: DataFrame, id_column: str, text_column: str, length: int, seed: int, hot: int) -> tuple[DataFrame, str]:
    """All documents with their spans in a new last column."""
    keyed = F.xxhash64(F.col(id_column), F.col(text_column))
    spans = repeated_spans(documents.select(keyed.alias("key"), F.col(text_column).alias("text")), length, seed, hot)
    name = "spans"
    while name in documents.columns:
        name += "_"
    # Repeated rows share a key and have the same spans: a set, or every copy would carry those of all.
    lists = spans.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias(name))
    joined = documents.withColumn(f"{name}_key", keyed).join(lists.withColumnRenamed("key", f"{name}_key").hint("shuffle_hash"), f"{name}_key", "left")
    return joined.drop(f"{name}_key"), name


def substring_dedup(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """One row per document: its words, how many are removed and a digest of those kept."""
    rows, spans = _with_spans(documents.select(id_column, text_column), id_column, text_column, length, seed, hot)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n, kept = _kept(text, ranges)
                out.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n_words, n_removed, sha = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return arrow_map(rows.select(id_column, text_column, spans), digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def strip_repeats(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str | None = None, length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """The documents with the words kept (joined by one space) as text, all other columns as they are.

    A text without repeats stays unchanged. ``length_column`` is set to the new length.
    """
    rows, spans = _with_spans(documents, id_column, text_column, length, seed, hot)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = texts(batch, spans).to_pylist()
            old = texts(batch, text_column).to_pylist()
            new = [b" ".join(_kept(t, r)[1]).decode("utf-8", "surrogatepass") if r else t for t, r in zip(old, ranges, strict=True)]
            arrays = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != spans}
            arrays[text_column] = pa.array(new, arrays[text_column].type)
            if length_column:
                kind = arrays[length_column].type
                changed = [bool(r) for r in ranges]
                arrays[length_column] = pa.array([len(t) if c else o for t, c, o in zip(new, changed, arrays[length_column].to_pylist(), strict=True)], kind)
            yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    return arrow_map(rows, rest, documents.schema)


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {LENGTH - 1}], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {LENGTH - 2})) AS i FROM d WHERE len(w) >= {LENGTH})),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {LENGTH})) AS p FROM rep),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op8_substring_dedup", ORACLE)
def op8_substring_dedup(spark, sf_dir):
    return substring_dedup(table(spark, sf_dir, "documents"))
