"""SimHash near-duplicates by a binary trie self-join.

A fingerprint bit is the majority of that bit among the XXH64 values of a text's
three-word shingles. Distinct fingerprints form a binary trie, which is joined
with itself: pairs of nodes of one depth are traversed together, the bits in
which their paths differ are added up, and a pair is dropped as soon as there
are more than ``BITS``.

The upper part of the traversal is a DataFrame of node pairs, ``STRIDE`` levels
a round, until both nodes of a pair hold at most ``BUCKET`` fingerprints. Such a
pair is one row with the fingerprints of both; a task goes on with the same
traversal over ranges of the sorted fingerprints, bit by bit and for all node
pairs of a level at once. A node has at most one pair for each path within
``BITS`` of its own, so pairs grow with the fingerprints and not with their
square, however many texts share a fingerprint or a neighbourhood. Every link of
different fingerprints is found; what a task found leaves it as a forest.

Edge cases: a null text, or one without a word, has fingerprint zero and links
like any other; one or two words are one shingle; repeated rows share their
component; a null id belongs to its fingerprint's component but never names it
(null if no id is there); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, query, staged, table
from .columns import Words, slices, texts
from .components import components

SHINGLE = 3
SEED = 42
BITS = 2
STRIDE = 4
BUCKET = 4096
LONG = 256  # bytes of a shingle beyond which the library hashes it
FREQUENT = 1000  # so many fingerprints at most count as frequent
BLOCK = 1 << 15  # shingles whose bits are spread out at once

# The five primes of XXH64, fixed values of the published algorithm.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(state: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotate(state + lane * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of the byte ranges of ``data``, all at once; long ones by the library."""
    size = end - start
    out = np.empty(len(start), np.uint64)
    long = np.flatnonzero(size > LONG)
    for i in long.tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    short = np.flatnonzero(size <= LONG)
    if not len(short):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded.data, strides=(1,))
    halves = np.ndarray((len(data) + 1,), np.dtype("<u4"), padded.data, strides=(1,))
    at, size = start[short], size[short]
    h = np.full(len(at), (seed + int(P5)) % 2**64, np.uint64)
    wide = np.flatnonzero(size >= 32)
    if len(wide):
        first = (seed + int(P1) + int(P2), seed + int(P2), seed, seed - int(P1))
        state = [np.full(len(wide), x % 2**64, np.uint64) for x in first]
        for stripe in range(int(size.max()) // 32):
            live = np.flatnonzero(size[wide] >= 32 * (stripe + 1))
            for k in range(4):
                state[k][live] = _round(state[k][live], lanes[at[wide[live]] + 32 * stripe + 8 * k])
        merged = _rotate(state[0], 1) + _rotate(state[1], 7) + _rotate(state[2], 12) + _rotate(state[3], 18)
        for one in state:
            merged = (merged ^ _round(np.zeros_like(one), one)) * P1 + P4
        h[wide] = merged
    h = h + size.astype(np.uint64)
    done = size // 32 * 32
    for _ in range(3):
        live = np.flatnonzero(size - done >= 8)
        if not len(live):
            break
        x = h[live] ^ _round(np.zeros(len(live), np.uint64), lanes[at[live] + done[live]])
        h[live] = _rotate(x, 27) * P1 + P4
        done[live] += 8
    live = np.flatnonzero(size - done >= 4)
    x = h[live] ^ halves[at[live] + done[live]].astype(np.uint64) * P1
    h[live] = _rotate(x, 23) * P2 + P3
    done[live] += 4
    for _ in range(3):
        live = np.flatnonzero(size > done)
        if not len(live):
            break
        x = h[live] ^ padded[at[live] + done[live]].astype(np.uint64) * P5
        h[live] = _rotate(x, 11) * P1
        done[live] += 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    h ^= h >> np.uint64(32)
    out[short] = h
    return out


def _joined(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, lower-cased and each followed by one space, and where they start and end."""
    size = words.end - words.start
    start = np.cumsum(size + 1) - (size + 1)
    marks = np.zeros(len(words.data) + 1, np.int8)
    marks[words.start] += 1
    marks[words.end] -= 1
    data = words.data[np.cumsum(marks[:-1]) > 0] if len(words) else words.data[:0]
    upper = (data >= 65) & (data <= 90)
    spread = np.full(len(data) + len(words), 32, np.uint8)
    spread[np.arange(len(data)) + np.repeat(np.arange(len(words)), size)] = np.where(upper, data + np.uint8(32), data)
    return spread, start, start + size


def fingerprints(column: pa.Array) -> np.ndarray:
    """The fingerprint of each text."""
    words = Words(column)
    n_texts = len(column)
    data, start, end = _joined(words)
    counts = words.counts
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    of = np.repeat(np.arange(n_texts), n)
    first = np.repeat(words.first[:-1] - (np.cumsum(n) - n), n) + np.arange(len(of))
    last = first + np.minimum(np.repeat(counts, n), SHINGLE) - 1
    hashed = xxh64(data, start[first], end[last])
    ones = np.zeros((n_texts, 64), np.int64)
    for at in range(0, len(of), BLOCK):
        some = of[at : at + BLOCK]
        bits = np.unpackbits(hashed[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        begin = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
        ones[some[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1).view(">u8").astype(np.uint64).reshape(-1)


def fingerprinted(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fp`` of every row; the fingerprint as a signed long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            found = fingerprints(texts(batch, text_column)).view(np.int64)
            yield pa.RecordBatch.from_arrays([texts(batch, id_column).cast(pa.int64()), pa.array(found)], ["doc_id", "fp"])

    return arrow_map(documents.select(id_column, text_column), scan, "doc_id long, fp long")


def _prefix(depth: int):
    return F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")


def node_pairs(distinct: DataFrame, n: int, bucket: int = BUCKET, bits: int = BITS, stride: int = STRIDE) -> list[tuple[int, DataFrame]]:
    """The pairs ``p, q, diff`` of trie nodes to go on with in tasks, by depth: the traversal from the root until both nodes are small."""
    pairs = distinct.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.lit(0).alias("diff"), F.lit(n).cast("long").alias("larger")
    )
    out, depth, left_over, small = [], 0, n > bucket, n <= bucket
    while True:
        if small:
            out.append((depth, pairs.where(F.col("larger") <= bucket).select("p", "q", "diff")))
        if not left_over:
            return out
        pairs = pairs.where(F.col("larger") > bucket)
        depth += stride
        child = distinct.groupBy(_prefix(depth).alias("node")).agg(F.count("*").alias("n")).withColumn("parent", F.shiftrightunsigned("node", stride))
        left = child.select(F.col("parent").alias("p"), F.col("node").alias("left"), F.col("n").alias("n_left"))
        right = child.select(F.col("parent").alias("q"), F.col("node").alias("right"), F.col("n").alias("n_right"))
        below = F.lit((1 << stride) - 1).cast("long")  # the paths above differ in ``diff`` bits
        diff = F.col("diff") + F.bit_count(F.col("left").bitwiseXOR(F.col("right")).bitwiseAND(below)).cast("int")
        pairs = (
            pairs.join(left, "p").join(right, "q").withColumn("diff", diff)
            .where((F.col("diff") <= bits) & ((F.col("p") != F.col("q")) | (F.col("left") <= F.col("right"))))
            .select(F.col("left").alias("p"), F.col("right").alias("q"), "diff", F.greatest("n_left", "n_right").alias("larger"))
        )
        pairs = staged(pairs, "node-pairs")
        left_over, small = pairs.agg(F.count_if(F.col("larger") > bucket), F.count_if(F.col("larger") <= bucket)).first()


def traverse(a: np.ndarray, b: np.ndarray, depth: int, diff: int, same: bool, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Positions in two sorted arrays of fingerprints that differ in ``bits`` bits at most.

    The arrays are subtries at ``depth`` whose paths differ in ``diff`` bits;
    ``same`` says that they are one, of which each pair is wanted once.
    """
    lo, hi, low, high = (np.array([x]) for x in (0, len(a), 0, len(b)))
    diff, same = np.array([diff]), np.array([same])
    found_a, found_b = [], []

    def finish(one):
        x, y = lo[one], low[one]
        good = np.bitwise_count(a[x] ^ b[y]) <= bits
        good &= ~same[one]
        found_a.append(x[good])
        found_b.append(y[good])

    for level in range(depth, 65):
        single = (hi - lo == 1) & (high - low == 1)
        if single.any():
            finish(np.flatnonzero(single))
            rest = ~single
            lo, hi, low, high, diff, same = (x[rest] for x in (lo, hi, low, high, diff, same))
        if not len(lo) or level == 64:
            break
        bit = np.uint64(63 - level)
        cuts = []
        for values, begin, end in ((a, lo, hi), (b, low, high)):
            ones = np.concatenate([[0], np.cumsum((values >> bit) & np.uint64(1)).astype(np.int64)])
            cuts.append(end - (ones[end] - ones[begin]))
        cut, other = cuts
        # Children with equal bits keep the sum, children with different bits add one to it.
        apart = diff < bits
        once = apart & ~same
        lo, hi, low, high, diff, same = (
            np.concatenate(x)
            for x in (
                (lo, cut, lo[apart], cut[once]),
                (cut, hi, cut[apart], hi[once]),
                (low, other, other[apart], low[once]),
                (other, high, high[apart], other[once]),
                (diff, diff, diff[apart] + 1, diff[once] + 1),
                (same, same, np.zeros(apart.sum(), bool), np.zeros(once.sum(), bool)),
            )
        )
        some = (lo < hi) & (low < high) & ~(same & (hi - lo == 1))
        lo, hi, low, high, diff, same = (x[some] for x in (lo, hi, low, high, diff, same))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as the given ones, one a node: to the smallest value reached."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = back[: len(a)], back[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = root.copy()
        np.minimum.at(least, root[left], root[right])
        np.minimum.at(least, root[right], root[left])
        least = least[least]
        moved = least[root]
        if (moved == root).all():
            break
        root = moved
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _links(distinct: DataFrame, depth: int, pairs: DataFrame, bits: int) -> DataFrame:
    """Links ``a, b`` of the fingerprints below the node pairs of one depth."""
    wanted = pairs.select(F.col("p").alias("node")).unionByName(pairs.select(F.col("q").alias("node"))).distinct()
    below = distinct.select("fp", _prefix(depth).alias("node")).join(wanted, "node", "left_semi")
    nodes = below.groupBy("node").agg(F.collect_list("fp").alias("fps"))  # ``bucket`` at most
    left = nodes.select(F.col("node").alias("p"), F.col("fps").alias("left"))
    right = nodes.select(F.col("node").alias("q"), F.col("fps").alias("right"))
    nothing = F.lit(None).cast("array<long>")
    alike = pairs.where("p = q").join(left, "p").select("diff", "left", nothing.alias("right"))
    rows = pairs.where("p <> q").join(left, "p").join(right, "q").select("diff", "left", "right").unionByName(alike)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            diff = batch.column(0).to_numpy()
            out = []
            for i in range(batch.num_rows):
                sides = [np.sort(c[i].values.to_numpy().view(np.uint64)) if c[i].is_valid else None for c in batch.columns[1:]]
                a, b = sides[0], sides[0] if sides[1] is None else sides[1]
                x, y = traverse(a, b, depth, int(diff[i]), sides[1] is None, bits)
                if len(x):
                    out.append(forest(a[x].view(np.int64), b[y].view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["a", "b"])

    return arrow_map(rows, compare, "a long, b long")


def simhash_join(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """One row per document: its fingerprint in hex and the smallest id reachable by links."""
    marked = staged(fingerprinted(documents, id_column, text_column), "fingerprints")
    distinct = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    n, rows = distinct.agg(F.count("*"), F.sum("n")).first()
    links = None
    for depth, pairs in node_pairs(distinct, n, bucket, bits):
        found = _links(distinct, depth, pairs, bits)
        links = found if links is None else links.unionByName(found)
    roots = components(links, "simhash")
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("class"))
    classes = named.groupBy("class").agg(F.min("least").alias("component_id"))
    named = staged(named.join(classes, "class").select("fp", "n", "component_id"), "named")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    # At most FREQUENT fingerprints have more than this share of the rows; they are told to all tasks, the others are joined.
    often = F.col("n") > (rows or 0) // FREQUENT
    hot = F.broadcast(named.where(often).select("fp", "component_id"))
    cold = marked.join(F.broadcast(named.where(often).select("fp")), "fp", "left_anti").join(named.where(~often).select("fp", "component_id"), "fp")
    return marked.join(hot, "fp").unionByName(cold).select("doc_id", text.alias("fingerprint"), "component_id")


@query("op13_simhash_join")
def op13_simhash_join(spark, sf_dir):
    return simhash_join(table(spark, sf_dir, "documents"))
