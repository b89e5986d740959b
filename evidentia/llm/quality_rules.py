"""Quality rules: how much more a text looks like trusted text than like the raw corpus.

Character trigrams of every text are hashed into ``N_BUCKETS``. Two multinomials
are estimated over the buckets: the trusted target from documents labelled good
and the raw corpus from every document; the target is smoothed towards the corpus. A text's score is the mean over its
trigrams of log p_target - log p_raw; a text is kept if it passes the base rules
and its score is at least ``MIN_SCORE``. Bucket weights are integers
(millionths), so a verdict does not depend on the order of addition.

The raw multinomial counts all texts of the corpus. The trusted target is fitted
on at most ``MAX_TRUSTED`` labelled documents, those with the smallest hashed id.
Per task and per job only one count pair per bucket is moved.

Edge cases: a null or empty text has no words and fails the base rules; a text
of fewer than three code points has no trigram and score 0; repeated ids are
judged row by row; without any trusted document every weight is 0, so only the
base rules decide; an empty table gives an empty result. A null id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, batch_of, query, table
from .columns import Words, ids, mix, slices, texts

N_BUCKETS = 65_521  # prime
FACTORS = (1, 1_009, 1_000_003)  # of the three code points
MAX_TRUSTED = 20_000
MIN_SCORE = -500_000  # millionths of a nat per trigram
PRIOR = 1_000  # trigrams of the raw corpus mixed into the target, so that a small target says little
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
UNIT = 1_000_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("base_failed", pa.bool_()),
        ("kept", pa.bool_()),
        ("n_grams", pa.int64()),
        ("score_sum", pa.int64()),
    ]
)
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_grams long, score_sum long"


def trigrams(rows: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every trigram and, for each text, where its trigrams begin (one longer)."""
    size = np.array([len(t) if t else 0 for t in rows], np.int64)
    code = np.frombuffer("".join(t for t in rows if t).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(len(rows) + 1, np.int64)
    bucket = (code[:-2] * FACTORS[0] + code[1:-1] * FACTORS[1] + code[2:] * FACTORS[2]) % N_BUCKETS
    inside = np.arange(len(bucket)) + 3 <= np.repeat(at[1:], size)[: len(bucket)]
    return bucket[inside], np.concatenate([[0], np.cumsum(np.maximum(size - 2, 0))])


def trusted_ids(labels: DataFrame, at_most: int = MAX_TRUSTED) -> np.ndarray:
    """Ids labelled good, at most so many: those with the smallest hashed id."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    first = good.orderBy((F.col("doc_id") * 2_654_435_761) % 4_294_967_296, "doc_id").limit(at_most)
    return np.array(sorted(r[0] for r in first.collect()), np.int64)


def bucket_weights(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", at_most: int = MAX_TRUSTED) -> np.ndarray:
    """log p_target - log p_raw of every bucket, in millionths, from all documents."""
    trusted = documents.sparkSession.sparkContext.broadcast(trusted_ids(labels, at_most))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, N_BUCKETS), np.int64)
        for batch in slices(batches, text_column):
            bucket, at = trigrams(texts(batch, text_column).to_pylist())
            counts[1] += np.bincount(bucket, minlength=N_BUCKETS)
            good = np.repeat(np.isin(ids(batch, id_column), trusted.value), np.diff(at))
            counts[0] += np.bincount(bucket[good], minlength=N_BUCKETS)
        seen = np.flatnonzero(counts[1])
        yield batch_of(pa.schema([("bucket", pa.int32()), ("target", pa.int64()), ("raw", pa.int64())]), seen, counts[0][seen], counts[1][seen])

    narrow = documents.select(id_column, text_column)
    rows = arrow_map(narrow, count, "bucket int, target long, raw long").groupBy("bucket").agg(F.sum("target"), F.sum("raw")).collect()
    counts = np.zeros((2, N_BUCKETS))
    for bucket, target, raw in rows:
        counts[:, bucket] = target, raw
    if not counts[0].any():
        return np.zeros(N_BUCKETS, np.int64)
    raw = (counts[1] + 1) / (counts[1].sum() + N_BUCKETS)
    target = (counts[0] + PRIOR * raw) / (counts[0].sum() + PRIOR)
    return np.rint(UNIT * (np.log(target) - np.log(raw))).astype(np.int64)


def _repeated(words: Words) -> np.ndarray:
    """For each text, its words inside three-word windows found twice or more in it."""
    covered = np.zeros(len(words), bool)
    at = np.flatnonzero(words.whole(3))
    if len(at):
        text = words.text_of()[at].astype(np.uint64)
        key = mix(words.sequences(3)[at] + mix(text + np.uint64(1)))
        _, back, n = np.unique(key, return_inverse=True, return_counts=True)
        again = at[n[back] > 1]
        for step in range(3):
            covered[again + step] = True
    return _per_text(covered, words.first)


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values.astype(np.int64))])
    return sums[first[1:]] - sums[first[:-1]]


def _repeated_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            again += line in seen
            seen.add(line)
    return again


def judge(batch: pa.RecordBatch, weights: np.ndarray, id_column: str, text_column: str) -> pa.RecordBatch:
    """The result rows of one slice."""
    column = texts(batch, text_column)
    rows = column.to_pylist()
    words = Words(column)
    in_word = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    chars = np.concatenate([[0], np.cumsum(in_word[words.end] - in_word[words.start])])
    n_words, repeated = words.counts, _repeated(words)
    symbols = _per_text(SYMBOLS[words.data], words.offset)
    bucket, at = trigrams(rows)
    score = _per_text(weights[bucket], at)
    n_grams = np.diff(at)
    failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * n_words)
    return batch_of(
        _RESULT,
        batch.column(batch.schema.get_field_index(id_column)).cast(pa.int64()),
        n_words,
        chars[words.first[1:]] - chars[words.first[:-1]],
        symbols,
        np.array([_repeated_lines(t) for t in rows], np.int64),
        repeated,
        failed,
        ~failed & (score >= MIN_SCORE * n_grams),
        n_grams,
        score,
    )


def quality_rules(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document with the rules' counts and the verdict."""
    narrow = documents.select(id_column, text_column)
    weights = narrow.sparkSession.sparkContext.broadcast(bucket_weights(narrow, labels, id_column, text_column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            yield judge(batch, weights.value, id_column, text_column)

    return arrow_map(narrow, run, RESULT)


def keep_good(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that pass, with all their columns; no row is moved."""
    weights = documents.sparkSession.sparkContext.broadcast(bucket_weights(documents, labels, id_column, text_column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            yield batch.filter(judge(batch, weights.value, id_column, text_column).column("kept"))

    return arrow_map(documents, run, documents.schema)


WORD = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
tri AS (
  SELECT doc_id, i, w[i:i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), cov AS (
  SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1
), rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM cov GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (
  SELECT doc_id, CAST(count(*) - count(DISTINCT l) AS BIGINT) AS n_dup_lines
  FROM lines WHERE regexp_matches(l, '{WORD}') GROUP BY doc_id
), chars AS (SELECT doc_id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM d WHERE length(t) > 2),
code AS (
  SELECT doc_id, unicode(c) AS c1, lead(unicode(c), 1) OVER w AS c2, lead(unicode(c), 2) OVER w AS c3
  FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), grams AS (
  SELECT doc_id, (c1 * {FACTORS[0]} + c2 * {FACTORS[1]} + CAST(c3 AS BIGINT) * {FACTORS[2]}) % {N_BUCKETS} AS b FROM code WHERE c3 IS NOT NULL
), good AS (
  SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)
  ORDER BY (doc_id * 2654435761) % 4294967296, doc_id LIMIT {MAX_TRUSTED}
), n AS (
  SELECT b, count(*) AS r, count(good.doc_id) AS t FROM grams LEFT JOIN good USING (doc_id) GROUP BY b
), pr AS (
  SELECT b, t, (r + 1.0::DOUBLE) / ((sum(r) OVER ()) + {N_BUCKETS}) AS raw, sum(t) OVER () AS all_t FROM n
), wt AS (
  SELECT b, CASE WHEN all_t = 0 THEN 0 ELSE CAST(round({UNIT} * (ln((t + {PRIOR} * raw) / (all_t + {PRIOR})) - ln(raw))) AS BIGINT) END AS weight FROM pr
),
sc AS (SELECT doc_id, CAST(sum(weight) AS BIGINT) AS score_sum, count(*) AS n_grams FROM grams JOIN wt USING (b) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_grams, 0) AS n_grams, coalesce(score_sum, 0) AS score_sum
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN sc USING (doc_id)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words) AND score_sum >= {MIN_SCORE} * n_grams AS kept
FROM base
"""


@query("op1_quality_rules", ORACLE)
def op1_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
