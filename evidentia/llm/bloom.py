"""A Bloom filter of fixed greatest size, built by Spark one segment per row.

A key's bits all lie in one segment, so a segment is filled by one task and the
driver only receives finished segments: at most ``2**MAX_BITS`` bits together.
A filter that is too small for its keys lets more rows through; it never loses
one, and whoever uses it counts exactly afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import mix

SEGMENT_BITS = 6
MIN_BITS, MAX_BITS = 16, 27
PROBES = 3


class Bloom:
    def __init__(self, bits: int, segments: dict[int, bytes]):
        self.bits = bits
        size = 1 << (bits - SEGMENT_BITS - 3)
        self.data = np.zeros(size << SEGMENT_BITS, np.uint8)
        for number, content in segments.items():
            self.data[number * size : (number + 1) * size] = np.frombuffer(content, np.uint8)

    def __contains__(self, keys):  # pragma: no cover - arrays only
        raise TypeError("use has()")

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in _bits(keys, self.bits):
            found &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def _bits(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    inner = np.uint64(bits - SEGMENT_BITS)
    segment = keys >> np.uint64(64 - SEGMENT_BITS) << inner
    out = []
    for probe in range(PROBES):
        h = mix(keys + np.uint64(0x9E3779B97F4A7C15 * (probe + 1) % 2**64))
        out.append(segment | h >> np.uint64(64) - inner)
    return out


def bloom(keys: DataFrame, column: str, n_keys: int) -> Bloom:
    """The filter of a long column, about ten bits a key up to the greatest size."""
    bits = int(min(MAX_BITS, max(MIN_BITS, np.ceil(np.log2(10 * max(1, n_keys))))))
    size = 1 << (bits - SEGMENT_BITS - 3)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments: dict[int, np.ndarray] = {}
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in _bits(key, bits):
                number = (at >> np.uint64(bits - SEGMENT_BITS)).astype(np.int64)
                for one in np.unique(number):
                    mask = segments.setdefault(int(one), np.zeros(size, np.uint8))
                    local = at[number == one] & np.uint64((size << 3) - 1)
                    np.bitwise_or.at(mask, (local >> np.uint64(3)).astype(np.int64), np.uint8(1) << (local & np.uint64(7)).astype(np.uint8))
        names = list(segments)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([segments[n].tobytes() for n in names], pa.binary())], ["segment", "bits"])

    segment = F.shiftrightunsigned(F.col(column), 64 - SEGMENT_BITS)
    rows = keys.select(column).repartition(1 << SEGMENT_BITS, segment).mapInArrow(fill, "segment int, bits binary").toLocalIterator()
    return Bloom(bits, {r[0]: bytes(r[1]) for r in rows})
