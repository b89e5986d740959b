"""Token counts by a two-tier table of pre-token lengths.

A text's pre-tokens are found by one pattern, and its count is the sum of their
lengths in tokens. Lengths of frequent pre-tokens come from a broadcast hash
table of at most ``TABLE`` entries; others are encoded by the library once and
kept in a cache of each worker. No pre-token is shuffled.

The frequent pre-tokens are those of at most ``SAMPLE`` documents (those with the
smallest hash of their id); the table only saves work and never changes a count.
The pattern stands for the library's own normalising and splitting on texts of
ASCII and accented Latin letters without special strings. Any other text is
counted by the library as a whole.

Edge cases: null and empty texts have 0 bytes and 0 tokens; a special string in
a text is one token, as the library has it; repeated rows are counted one by
one; a null id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, held, query, table
from .columns import slices, texts

LIMIT = 2048
TABLE = 1 << 16
SAMPLE = 4096
SAMPLE_TOP = 20_000  # pre-tokens that one task of the sample reports
CACHE = 200_000

# The split pattern of the vocabulary's file, for lower-cased texts of the plain characters.
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\v\f\ra-zß-öø-ÿ0-9]+")
#: Characters on which Python and the library agree about composing, lower case and white space.
OTHER = re.compile(r"[^\t\n\v\f\r -~À-ÿ]")

_WORKER: dict[str, tuple] = held(__name__)


def _tokenizer(content: str):
    """The library's tokenizer and the cache of lengths, once per worker and vocabulary."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    known = _WORKER.get(content)
    if known is None:
        _WORKER[content] = known = (Tokenizer.from_str(content), {})
    return known


def pre_tokens(text: str, special: re.Pattern) -> list[str] | None:
    """The pre-tokens of a text; None if only the library may split it."""
    if OTHER.search(text) or special.search(text):
        return None
    return PRE_TOKEN.findall(text.lower())


def special_strings(content: str) -> re.Pattern:
    tokenizer, _ = _tokenizer(content)
    found = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return re.compile("|".join(map(re.escape, found)) or r"(?!)")


def frequent_lengths(documents: DataFrame, content: str, id_column: str, text_column: str) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of a bounded sample."""
    special = special_strings(content)
    total = documents.count()
    share = int(2**31 * min(1.0, SAMPLE / max(1, total)))
    sample = documents.where(F.shiftrightunsigned(F.xxhash64(id_column), 33) < share).limit(SAMPLE).select(text_column) if total > SAMPLE else documents.select(text_column)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in slices(batches, text_column):
            for text in texts(batch, text_column).to_pylist():
                counts.update(pre_tokens(text, special) or () if text else ())
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:SAMPLE_TOP]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["token", "n"])

    counts = Counter()
    for token, n in arrow_map(sample, count, "token string, n long").toLocalIterator():
        counts[token] += n
    tokens = [t for t, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:TABLE]]
    encoded = _tokenizer(content)[0].encode_batch(tokens, add_special_tokens=False)
    return {t: len(e) for t, e in zip(tokens, encoded, strict=True)}


def count_batch(rows: list[str | None], content: str, frequent: dict[str, int], special: re.Pattern) -> list[int]:
    """Token counts of a batch of texts."""
    tokenizer, cache = _tokenizer(content)
    split = [pre_tokens(t, special) if t else [] for t in rows]
    distinct = set(chain.from_iterable(s for s in split if s))
    rest = distinct.difference(frequent)
    new = [t for t in rest if t not in cache]
    if len(cache) + len(new) > CACHE:
        cache.clear()
        new = list(rest)
    cache.update(zip(new, map(len, tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
    length = {t: frequent[t] if t in frequent else cache[t] for t in distinct}
    whole = iter(tokenizer.encode_batch_fast([t for t, s in zip(rows, split, strict=True) if s is None], add_special_tokens=False))
    return [len(next(whole)) if s is None else sum(map(length.__getitem__, s)) for s in split]


def token_counts(documents: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: UTF-8 bytes, tokens, and whether there are more than ``limit``."""
    with open(tokenizer_path, encoding="utf-8") as file:
        content = file.read()
    narrow = documents.select(id_column, text_column)
    shared = narrow.sparkSession.sparkContext.broadcast((content, frequent_lengths(narrow, content, id_column, text_column)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, frequent = shared.value
        special = special_strings(vocabulary)
        for batch in slices(batches, text_column):
            rows = texts(batch, text_column).to_pylist()
            n = count_batch(rows, vocabulary, frequent, special)
            yield pa.RecordBatch.from_arrays(
                [
                    texts(batch, id_column).cast(pa.int64()),
                    pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in rows], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return arrow_map(narrow, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


@query("op10_token_counts")
def op10_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
