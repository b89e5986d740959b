"""Ranked search, Merkle manifest and SimHash join against brute force."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from evidentia.llm import lexical_search as search
from evidentia.llm import merkle_manifest as merkle
from evidentia.llm import simhash_join as simhash

from .common import GIVEN, SF, edge_documents, rows_by, sentence, write_tables

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Ranked search


def brute_search(documents, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(i, term.findall((t or "").translate(LOWER))) for i, t in documents]
    docs = [(i, t) for i, t in docs if t]
    n, length = len(docs), sum(len(t) for _, t in docs)
    out = []
    for item in sorted({i for i, _ in items}, key=lambda i: (i is not None, i)):
        wanted = {x for i, t in items if i == item for x in term.findall((t or "").translate(LOWER))}
        scores = []
        for doc, words in docs:
            score = 0
            for x in wanted & set(words):
                df = sum(x in w for _, w in docs)
                m = 50 + 50 * len(words) * n // length
                tf = words.count(x)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, rank + 1, doc, -score) for rank, (score, _, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


ITEMS = [
    (1, GIVEN), (2, "w1 " + sentence(1, 12)), (2, sentence(3, 4)), (3, None), (4, "??? !!"), (5, "nowhere"),
    (None, "One two three"), (6, "日本語 é x"), (7, sentence(1, 60) + " " + sentence(4, 90)),
]


@pytest.mark.parametrize("shard,k", [(8192, 50), (3, 2), (5, 1)])
def test_search_is_exact(spark, shard, k):
    docs = edge_documents(spark)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit("clash"))
    got = rows_by(search.lexical_search(docs, items, k=k, shard_documents=shard), "item_id", "rank", "doc_id", "score")
    assert got == brute_search([(r.doc_id, r.text) for r in docs.collect()], ITEMS, k)


def test_search_in_blocks_and_on_empty_tables(spark, monkeypatch):
    docs, items = edge_documents(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = rows_by(search.lexical_search(docs, items, k=3), "item_id", "rank", "doc_id", "score")
    monkeypatch.setattr(search, "BLOCK_TERMS", 5)
    assert rows_by(search.lexical_search(docs, items, k=3), "item_id", "rank", "doc_id", "score") == want
    assert search.lexical_search(docs.limit(0), items).count() == 0
    assert search.lexical_search(docs, items.limit(0)).count() == 0


def test_pair_bounds_leave_out_more_terms(spark):
    # Two terms that never meet: their sum of maxima would keep both lists open, the pair's bound does not.
    apart = [f"{'alpha' if i % 2 else 'beta'} pad{i} pad{i}x" for i in range(40)]
    strong = [f"gamma delta epsilon zeta{i}" for i in range(4)]
    docs = spark.createDataFrame(list(enumerate(apart + strong)), "doc_id long, text string").coalesce(1)
    vocabulary = np.unique(search.terms(pa.array(["alpha beta gamma delta epsilon"])).hash.view(np.int64))
    posted = search.postings(docs, vocabulary, "doc_id", "text")
    n, length = posted.agg(F.count("*"), F.sum("n")).first()
    weight = search.weights(search.frequencies(posted, len(vocabulary)), n)
    number = {w: int(np.searchsorted(vocabulary, search.terms(pa.array([w])).hash.view(np.int64)[0])) for w in ("alpha", "beta", "gamma", "delta", "epsilon")}
    item = search.Item(1, np.array(list(number.values())), weight)
    item.pairs = [tuple(sorted((number["alpha"], number["beta"]))), tuple(sorted((number["gamma"], number["delta"])))]
    shard = search.Shard(search.build_index(posted, [item], weight, n, length).toArrow())
    pair = {number["alpha"], number["beta"]}
    assert shard.bound(pair, item) == max(shard.top[t] for t in pair) < sum(shard.top[t] for t in pair)
    assert shard.pairs[item.pairs[1]][2] == shard.bound(set(item.pairs[1]), item)
    read = []
    docs, score = shard.best(item, 4, read)
    assert not pair & set(read) and len(docs) == 4 and (score > shard.bound(pair, item)).all()


# Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """``leaf, subroot, root, siblings`` of rows ``source, doc_id, leaf``, and the fold of another leaf."""

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, seat):
        out = []
        for level in levels[:-1]:
            first = seat // 16 * 16
            out.append((level[first:seat], level[seat + 1 : first + 16]))
            seat //= 16
        return out

    groups = {}
    for source, doc, leaf in rows:
        groups.setdefault(source, []).append((doc is not None, doc or 0, leaf))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for number, s in enumerate(order):
        for seat, (named, doc, leaf) in enumerate(sorted(groups[s])):
            steps = path(trees[s], seat) + path(top, number)
            out.append((s, doc if named else None, leaf, trees[s][-1][0], top[-1][0], H(*(x for left, right in steps for x in (*left, *right)))))
    return sorted(out, key=repr)


SHAPES = {
    "one row": [("a", 1)],
    "one run": [("a", i) for i in range(16)],
    "last run of one": [("a", i) for i in range(17)],
    "deep and shallow": [("a", i) for i in range(300)] + [(None, 5), ("", 6), ("é", 7), ("z", 8), ("Z", 9), ("a", None), ("a", 3), ("a", 3)],
    "many groups": [(f"s{i % 40}", i) for i in range(90)],
    "equal rows": [("a", 1)] * 40 + [("b", 2)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_manifest_is_exact(spark, shape, monkeypatch):
    monkeypatch.setattr(merkle, "SERVED", 2)
    rows = spark.createDataFrame([(s, d, "x", 1) for s, d in SHAPES[shape]], "source string, doc_id long, digest string, seat int").repartition(3)
    rows = rows.withColumn("leaf", merkle.digest(F.col("doc_id"), F.col("source")))
    found = merkle.manifest(rows).withColumn("p", F.sha2(merkle.siblings(F.col("proof")), 256)).withColumn("f", merkle.fold(F.col("leaf"), F.col("proof")))
    plain = [(s, d, H("-" if d is None else f"{len(str(d))}:{d}", "-" if s is None else f"{len(s.encode())}:{s}")) for s, d in SHAPES[shape]]
    assert rows_by(found, "source", "doc_id", "leaf", "subroot", "root", "p") == brute_manifest(plain)
    assert found.where("f <> root").count() == 0 and found.where("digest <> 'x' or seat <> 1").count() == 0


def test_manifest_query_on_awkward_rows(spark, tmp_path):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in edge_documents(spark).collect()] + [(20 + i, "Ab", "x", f"s{i % 3}", 2) for i in range(30)]
    folder = str(write_tables(tmp_path, rows))
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, la, s, n: H(*map(field, (i, s, la, n, t)))
    found = merkle.op12_merkle_manifest(spark, folder)
    want = brute_manifest([(s, i, leaf(i, t, la, s, n)) for i, t, la, s, n in rows])
    assert rows_by(found, "doc_id", "leaf", "subroot", "root", "proof_sha256") == sorted([r[1:] for r in want], key=repr)
    hit = {i for i, t, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and t and t.translate(LOWER) != t}
    assert {r.doc_id for r in found.where("not verified").collect()} == hit and hit
    write_tables(tmp_path, [])
    assert merkle.op12_merkle_manifest(spark, folder).count() == 0


# SimHash join


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(marks):
    """The smallest id reachable for rows ``id, fingerprint``."""
    a = np.array([f for _, f in marks], np.uint64)
    root = np.array([2**62 if i is None else i for i, _ in marks])
    while True:
        new = np.array([root[np.bitwise_count(x ^ a) <= 2].min() for x in a])
        if (new == root).all():
            return [None if r == 2**62 else int(r) for r in root]
        root = new


@pytest.mark.parametrize("bucket", [4096, 3])
def test_simhash_is_exact(spark, bucket):
    rows = edge_documents(spark)
    marks = [(r.doc_id, brute_fingerprint(r.text)) for r in rows.collect()]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(marks, brute_components(marks))), key=repr)
    assert rows_by(simhash.simhash_join(rows, bucket=bucket), "doc_id", "fingerprint", "component_id") == want


def test_simhash_on_given_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    marks = [(r.doc_id, brute_fingerprint(r.text)) for r in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(marks, brute_components(marks))), key=repr)
    assert rows_by(simhash.op13_simhash_join(spark, SF), "doc_id", "fingerprint", "component_id") == want
    assert simhash.simhash_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_xxh64_of_all_lengths():
    data = np.random.RandomState(3).randint(0, 256, 4000).astype(np.uint8)
    start = np.arange(0, 600)
    end = start + np.arange(600)
    want = [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(start, end)]
    assert simhash.xxh64(data, start, end).tolist() == want


@pytest.mark.parametrize("seed", range(6))
def test_traversal_finds_every_link_once(seed):
    r = np.random.RandomState(seed)
    base = r.randint(0, 2**63 - 1, 12, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    flip = lambda: np.uint64(1) << r.randint(0, 64, 900).astype(np.uint64)
    f = np.unique(base[r.randint(0, 12, 900)] ^ flip() ^ (flip() if seed % 2 else np.uint64(0)))
    x, y = simhash.traverse(f, f, 0, 0, True)
    want = {(i, int(j)) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= 2) if i < j}
    assert {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())} == want and len(x) == len(want)


def test_family_makes_node_pairs_by_its_links(spark):
    # Five random bits away from one fingerprint: close to each other, but hardly ever linked.
    r, made = np.random.RandomState(1), []
    for n in (1000, 4000):
        flips = np.array([np.bitwise_or.reduce(np.uint64(1) << r.choice(64, 5, False).astype(np.uint64)) for _ in range(n)])
        fps = spark.createDataFrame([(x,) for x in set((flips ^ np.uint64(0x5A5A5A5A5A5A5A5A)).view(np.int64).tolist())], "fp long")
        made.append(sum(pairs.count() for _, pairs in simhash.node_pairs(fps, n, bucket=16)))
    assert made[1] <= 10 * made[0] and made[1] < 4000 * 4000 // 100, made
