"""Whole texts as numpy columns: words, their hashes and hashes of word sequences.

A batch of texts is handled as one run of bytes. A word is a run of bytes other
than space and the controls 9 to 13, so it never crosses a code point. Word
hashes are 64-bit polynomials over a fixed random byte table, finished with an
avalanche step; equal words always hash alike and different words share a hash
with probability about 2**-64. Everything wraps modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .base import held

SLICE_BYTES = 2 << 20  # text handled at once; one longer text is a slice of its own
_BYTES = np.random.RandomState(20240517).randint(0, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SEQUENCE = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Every ASCII character that is neither letter nor digit: separates terms.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_POWERS: dict[int, np.ndarray] = held(__name__)


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values, one to one."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, size: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < size:
        size = max(size, SLICE_BYTES + 1)
        powers = np.full(size, base, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        if size > 4 * SLICE_BYTES:  # of one very long text: not kept
            return powers
        _POWERS[base] = known = powers
    return known


class Words:
    """The words of a slice of texts.

    ``start`` and ``end`` are byte positions in ``data``, ``hash`` the word
    hashes, ``first`` (one longer than the texts) the number of each text's
    first word, ``offset`` the byte positions of the texts.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, separators: np.ndarray = _SPACE):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offset = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offset[0] : offset[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.offset = offset - offset[0]
        self.data = data
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        size = len(data)
        solid = ~separators[data]
        opens = np.ones(size + 1, bool)
        opens[1:] = ~np.append(solid[:-1], False) if size else True
        opens[self.offset] = True  # a text's first byte follows nothing
        self.start = np.flatnonzero(solid & opens[:-1])
        closes = np.ones(size, bool)
        if size:
            closes[:-1] = ~solid[1:]
            closes[self.offset[1:][self.offset[1:] > 0] - 1] = True
        self.end = np.flatnonzero(solid & closes) + 1
        self.first = np.searchsorted(self.start, self.offset)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTES[data] * _powers(_BASE, size)[:size], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * _powers(_BASE_INVERSE, size)[self.start])

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def whole(self, length: int) -> np.ndarray:
        """Which positions begin ``length`` words of one text."""
        return np.arange(len(self)) + length <= np.repeat(self.first[1:], self.counts)

    def sequences(self, length: int) -> np.ndarray:
        """A hash of the ``length`` words from each position; use only where ``whole``."""
        return mix(self._run(length) + np.uint64(length))

    def _run(self, length: int) -> np.ndarray:
        block, size, factor = self.hash, 1, _SEQUENCE
        total, done, shift = None, 0, 1
        while True:
            if length & size:
                part = _ahead(block, done) * np.uint64(shift)
                total = part if total is None else total + part
                done += size
                shift = shift * factor % 2**64
            size *= 2
            if size > length:
                return total
            block = block + _ahead(block, size // 2) * np.uint64(factor)
            factor = factor * factor % 2**64


def _ahead(values: np.ndarray, by: int) -> np.ndarray:
    if by == 0:
        return values
    out = np.zeros_like(values)
    if by < len(values):
        out[:-by] = values[by:]
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches again, cut so that each holds at most ``most`` bytes of text or one row."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def texts(batch: pa.RecordBatch, column: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(column))


def ids(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """An id column; its nulls become the smallest long."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.int64()), -(2**63)).to_numpy(zero_copy_only=False)
