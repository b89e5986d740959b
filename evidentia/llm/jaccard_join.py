"""Exact similarity join of word-shingle sets with a token-group matrix.

Sets are split into groups of similar sets; the matrix says which groups hold a
token. A query set needs to open only groups whose token union holds at least
three quarters of the query, and any such union holds one of the query's
``n // 4 + 1`` first tokens in any fixed order of all tokens. So the matrix is
kept for those first tokens, in an order that puts frequent tokens last.

1. Equal sets are one set from here on (``sig``). 2. Every set posts its first
tokens; those that no other set of a fitting size posts are dropped. 3. A set
joins the group of the set (pivot) with which it shares most posted tokens, if
sizes and shared tokens allow a link; a large group is split into parts, each
with the pivot. Each part is opened: all its pairs are compared, linked sets
become classes. 4. Sets outside the largest class of their tokens are compared
with one part of the class with which they share most, ``ROUNDS`` times at most.
So a large family of similar sets becomes one class without all its pairs. 5.
Tokens whose postings lie in one class are done. For the others, sets query all
groups (parts of classes) of other classes. Sizes and the number of posted tokens
that the matrix has for a group rule most of them out; for the rest the bound on
the group's whole token union decides whether members are compared. Links join
classes. Every link of two sets lies in one class after step 4, or one of the two
sets queries the other's group in step 5, so the components are exact.

The order of tokens (at most ``MAX_FREQUENT`` frequent ones are told to the
tasks) changes the work, never the result.

Edge cases: a null text, or one without a word, has an empty set, no link and
itself as component; fewer than five words make one shingle; repeated rows are
copies; a null id belongs to its set's component but never names it (null if
alone); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import arrow_map, query, release, staged, table, unstaged
from .bloom import bloom
from .columns import Words, ids, mix, slices, texts
from .components import components

SHINGLE = 5
PERCENT = 75
PART = 128  # sets opened together
MAX_FREQUENT = 1 << 20
ROUNDS = 2
BUFFER = 2_000_000  # shingles among which a task looks for frequent ones
OFTEN = 4
MARK = "_text_mark"  # a hash of the text as it stands, by which a scan finds the texts it is after


def shingle_sets(words: Words, length: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    hashed = words.sequences(length)
    short = {k: words.sequences(k) for k in range(1, length)}
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        n = b - a
        out.append(np.unique(hashed[a : b - length + 1]) if n >= length else short[n][a : a + 1] if n else hashed[:0])
    return out


def signature(tokens: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed long."""
    total = mix(np.add.reduce(mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)), keepdims=True) + np.uint64(len(tokens)))
    return int(total.view(np.int64)[0])


def linked(overlap, left, right, percent: int = PERCENT):
    return 100 * overlap >= percent * (left + right - overlap)


def _describe(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows ``doc_id, n, sig`` and ``MARK`` of all documents, and ``token, n`` of tokens that some task saw often."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "sig", "token", MARK]
        held, size = [], 0

        def often():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            found, n = found[n >= OFTEN], n[n >= OFTEN]
            none = pa.nulls(len(found), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.array(n.astype(np.int64)), none, pa.array(found.view(np.int64)), none], names)

        for batch in slices(batches, text_column):
            sets = shingle_sets(Words(texts(batch, text_column), lower=True))
            n = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index(id_column)).cast(pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([signature(s) if len(s) else None for s in sets], pa.int64()),
                    pa.nulls(len(sets), pa.int64()),
                    texts(batch, MARK),
                ],
                names,
            )
            held += sets
            size += sum(n)
            if size > BUFFER:
                yield often()
                held, size = [], 0
        if held:
            yield often()

    rows = documents.select(id_column, text_column, F.xxhash64(text_column).alias(MARK))
    return staged(arrow_map(rows, scan, f"doc_id long, n long, sig long, token long, {MARK} long"), "sets")


def _frequent(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most ``MAX_FREQUENT`` tokens, sorted, and the place of each by count."""
    counts = described.where("token is not null").groupBy("token").agg(F.sum("n").alias("n"))
    counts = staged(counts, "frequent")
    sizes = counts.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count("*").alias("c")).orderBy(F.desc("b")).collect()
    total, least = 0, None
    for b, c in sizes:
        if total + c > MAX_FREQUENT:
            break
        total, least = total + c, b
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = counts.where(F.col("n") >= F.lit(1 << least)).toArrow()
    token = rows.column("token").to_numpy().view(np.uint64)
    place = np.empty(len(token), np.int64)
    place[np.lexsort((token, rows.column("n").to_numpy()))] = np.arange(1, len(token) + 1)
    by = np.argsort(token)
    return token[by], place[by]


def first_tokens(tokens: np.ndarray, frequent: np.ndarray, place: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The tokens of a set of which any set linked with it holds one."""
    n = len(tokens)
    size = n - -(-percent * n // 100) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        rank = np.where(frequent[at] == tokens, place[at], 0)
        if rank.any():
            tokens = tokens[np.argsort(rank, kind="stable")]  # equal ranks stay in order of hash
    return tokens[:size]


def early_tokens(n: int, percent: int = PERCENT) -> int:
    """So many first tokens of a set hold the first one in common with any linked set that is not smaller."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def _can_link(shared, n, other, percent: int = PERCENT):
    """Whether sets of ``n`` and ``other`` tokens (columns) with so many posted tokens in common may link.

    Common tokens that are not posted by both come after the prefix of one of
    the two, so they are fewer than that set's tokens behind its prefix.
    """
    wanted = F.ceil(F.lit(percent) * (n + other) / (100 + percent))
    behind = F.ceil(percent * F.greatest(n, other) / 100) - 1
    return (100 * n >= percent * other) & (100 * other >= percent * n) & (shared + behind >= wanted)


def _postings(documents: DataFrame, text_column: str, frequent) -> DataFrame:
    """``token, sig, n, pivot, pivot_n`` of all tokens posted by two sets of fitting sizes.

    A token's sets are cut, by size, where neighbours differ by too much to
    link; each stretch counts as a token of its own, with its largest set as pivot.

    The first common token of two linked sets is among the ``early`` first tokens
    of the smaller one, and of both if they are equal in size. So a posting is
    ``live`` if it is early or if the token has an early one of a set that is not
    larger; a set without a live posting has no link, and all its postings go.
    Texts that only share what very many share end here.
    """
    known = documents.sparkSession.sparkContext.broadcast(frequent)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, text_column):
            tokens, sigs, sizes, early = [], [], [], []
            for one in shingle_sets(Words(texts(batch, text_column), lower=True)):
                if len(one) and (sig := signature(one)) not in seen:
                    seen.add(sig)
                    tokens.append(first_tokens(one, *known.value))
                    sigs.append(sig)
                    sizes.append(len(one))
                    early.append(np.arange(len(tokens[-1])) < early_tokens(len(one)))
            if len(seen) > 200_000:
                seen.clear()
            if tokens:
                times = [len(t) for t in tokens]
                sig, n = np.repeat(np.array(sigs, np.int64), times), np.repeat(np.array(sizes, np.int32), times)
                columns = [np.concatenate(tokens).view(np.int64), sig, n, np.concatenate(early)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "sig", "n", "early"])

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "sig", "n", "pivot", "pivot_n", "live"]
        last = pivot = None  # token, sig and size of the last row; sig and size of its stretch's first
        pending = pending_live = False  # the pivot's own row waits for a second set
        for batch in batches:
            token, sig, n, live = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(token):
                continue
            before = [np.append(x[:1] if last is None else np.array([v], x.dtype), x[:-1]) for x, v in zip((token, sig, n), last or (None,) * 3)]
            fresh = (token != before[0]) | (sig != before[1])
            new = (token != before[0]) | (100 * n.astype(np.int64) < PERCENT * before[2].astype(np.int64))
            if last is None:
                fresh[0] = new[0] = True
            last = token[-1], sig[-1], n[-1]
            token, sig, n, live, new = token[fresh], sig[fresh], n[fresh], live[fresh], new[fresh]
            if not len(token):
                continue
            goes_on = not new[0]
            new[0] = True
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(token)))
            first, first_n = sig[begin], n[begin]
            keep = size > 1
            if goes_on:
                first[0], first_n[0], keep[0] = *pivot, True
            # Tokens are hashes; with the pivot mixed in, stretches are told apart.
            stretch = mix(token[begin].view(np.uint64) + mix(first.view(np.uint64))).view(np.int64)
            if goes_on and pending:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (stretch[0], *pivot, *pivot, pending_live)], names)
            kept = np.repeat(keep, size)
            yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (np.repeat(stretch, size), sig, n, np.repeat(first, size), np.repeat(first_n, size), live)], names)
            pending, pending_live = not keep[-1], bool(live[-1])
            pivot = first[-1], first_n[-1]

    posted = arrow_map(documents.select(text_column), post, "token long, sig long, n int, early boolean")
    whole = Window.partitionBy("token").orderBy(F.desc("n"), "sig").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    live = F.col("early") | (F.col("n") >= F.min(F.when(F.col("early"), F.col("n"))).over(whole))
    posted = posted.repartition("token").select("token", "sig", "n", F.coalesce(live, F.lit(False)).alias("live"))
    posted = posted.sortWithinPartitions("token", F.desc("n"), "sig")
    shared = staged(arrow_map(posted, share, "token long, sig long, n int, pivot long, pivot_n int, live boolean"), "shared")
    release(documents.sparkSession)
    postings = staged(shared.drop("live").join(shared.where("live").select("sig").distinct(), "sig", "left_semi"), "postings")
    unstaged(shared)
    return postings


def _groups(postings: DataFrame, part: int) -> DataFrame:
    """``sig, pivot, part``: the group of each set that may link with a pivot."""
    best = (
        postings.where("sig <> pivot").groupBy("sig", "pivot", "n", "pivot_n").agg(F.count("*").alias("shared"))
        .where(_can_link(F.col("shared"), F.col("n"), F.col("pivot_n")))
        .groupBy("sig").agg(F.max(F.struct("shared", "pivot")).alias("best"))
        .select("sig", F.col("best.pivot").alias("pivot"))
    )
    best = staged(best, "groups")
    sizes = best.groupBy("pivot").agg(F.count("*").alias("n")).select("pivot", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    return staged(best.join(sizes, "pivot").select("sig", "pivot", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int").alias("part")), "parts")


def _tokens(documents: DataFrame, text_column: str, marks: DataFrame, active: DataFrame) -> DataFrame:
    """``sig, tokens`` of the active sets and a few others, once each; rows that join them by ``sig`` need no second shuffle of them.

    One text of a set, told by its mark, is enough, so a scan passes over the others without reading their words.
    """
    wanted = staged(marks.join(active.distinct(), "sig", "left_semi").select(MARK), "wanted")
    known = documents.sparkSession.sparkContext.broadcast(bloom(wanted, MARK, wanted.count()))
    unstaged(wanted)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, text_column):
            batch = batch.filter(pa.array(known.value.has(texts(batch, MARK).to_numpy().view(np.uint64))))
            sets = [s for s in shingle_sets(Words(texts(batch, text_column), lower=True)) if len(s)]
            sigs = [signature(s) for s in sets]
            chosen = [i for i, sig in enumerate(sigs) if sig not in seen and not seen.add(sig)]
            if len(seen) > 200_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([sigs[i] for i in chosen], pa.int64()), pa.array([sets[i].tobytes() for i in chosen], pa.binary())], ["sig", "tokens"])

    rows = documents.select(text_column, F.xxhash64(text_column).alias(MARK))
    return arrow_map(rows, scan, "sig long, tokens binary").dropDuplicates(["sig"])


def groups_of(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Complete groups of rows that are sorted by their first columns."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy() for i in range(n_keys)]
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            here = tuple(k[a] for k in keys)
            if held and here != key:
                yield pa.Table.from_batches(held)
                held = []
            key = here
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two small lists."""
    tokens, back = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    total = np.zeros((len(left), len(right)), np.int64)
    width = 1 << 13
    for at in range(0, len(tokens), width):
        chosen = (back >= at) & (back < at + width)
        dense = np.zeros((len(left) + len(right), min(width, len(tokens) - at)), np.float32)
        dense[row[chosen], back[chosen] - at] = 1
        total += (dense[: len(left)] @ dense[len(left) :].T).astype(np.int64)
    return total


def _open(parts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Links inside each part, as edges ``a, b`` to the smallest set of a class."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in groups_of(batches, 2):
            sig, at = np.unique(group.column("sig").to_numpy(), return_index=True)
            if len(sig) < 2:
                continue
            sets = _sets(group.column("tokens").take(pa.array(at)))
            size = np.array([len(s) for s in sets])
            link = linked(overlaps(sets, sets), size[:, None], size[None, :])
            root = np.arange(len(sig))
            while True:  # smallest number among the neighbours, until nothing moves
                least = np.where(link, root[None, :], len(sig)).min(axis=1)
                if (least == root).all():
                    break
                root = least
            other = np.flatnonzero(root != np.arange(len(sig)))
            a += sig[other].tolist()
            b += sig[root[other]].tolist()
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    pivots = parts.select(F.col("pivot").alias("sig"), "pivot", "part").distinct()
    rows = parts.unionByName(pivots).join(tokens, "sig").select("pivot", "part", "sig", "tokens")
    rows = rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part")
    return arrow_map(rows, compare, "a long, b long")


def _homes(sets: DataFrame, links: DataFrame, part: int, name: str) -> DataFrame:
    """``sig, n, cls`` and ``MARK`` with links applied, the class's figures and the part of it that holds the set."""
    roots = components(links, name)
    named = sets.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("sig", "n", MARK, F.coalesce("root", "cls").alias("cls"))
    figures = named.groupBy("cls").agg(F.count("*").alias("size"), F.min("n").alias("least"), F.max("n").alias("most"))
    homes = named.join(figures, "cls").withColumn("part", F.pmod(F.xxhash64("sig"), F.ceil(F.col("size") / part)).cast("int"))
    return staged(homes.withColumn("magnitude", F.floor(F.log(8.0, "size")).cast("int")), name)


def _smallest(n):
    return F.greatest("least", F.ceil(F.lit(PERCENT) * n / 100))


def _largest(n):
    return F.least("most", F.floor(F.lit(100) * n / PERCENT))


def _mixed(postings: DataFrame, homes: DataFrame) -> DataFrame:
    """Postings of tokens that lie in several classes."""
    posted = postings.select("token", "sig").join(homes.select("sig", "n", "cls", "size", "part", "magnitude"), "sig")
    mixed = posted.groupBy("token").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high").select("token")
    return posted.join(mixed, "token")


def _towards_largest(documents: DataFrame, text_column: str, posted: DataFrame, homes: DataFrame, part: int) -> DataFrame:
    """Links of sets with a part of the class that holds most of their tokens, among the largest class of each; ``posted`` is ``_mixed``."""
    large = posted.where("size > 1").groupBy("token").agg(F.max(F.struct("size", "cls")).alias("top")).select("token", F.col("top.cls").alias("home"))
    shared = posted.join(large, "token").where("cls <> home").groupBy("sig", "n", "cls", "home").agg(F.count("*").alias("shared"))
    figures = homes.select(F.col("cls").alias("home"), F.col("size").alias("home_size"), "least", "most").distinct()
    n, more = F.col("n"), F.col("shared") + 1
    near = (
        shared.join(figures, "home").where(f"{PERCENT} * least <= 100 * n and {PERCENT} * n <= 100 * most")
        .where(_can_link(more, n, _largest(n)) | _can_link(more, n, _smallest(n)))
        .groupBy("sig", "cls").agg(F.max(F.struct("shared", "home", "home_size")).alias("best"))
        .select("sig", "cls", F.col("best.home").alias("home"), F.pmod(F.xxhash64("sig"), F.ceil(F.col("best.home_size") / F.lit(part))).cast("int").alias("part"))
    )
    return _ask(documents, text_column, staged(near, "near"), homes)


def _across(documents: DataFrame, text_column: str, posted: DataFrame, homes: DataFrame) -> DataFrame:
    """All links between sets of different classes; ``posted`` is ``_mixed``."""
    held = (
        posted.groupBy("token", F.col("cls").alias("home"), "part", F.col("magnitude").alias("home_magnitude"))
        .agg(F.min("n").alias("least"), F.max("n").alias("most"))
    )
    # One of two sets asks: that of the much smaller class, or else the smaller set.
    fits = F.expr(
        f"cls <> home and {PERCENT} * least <= 100 * n and {PERCENT} * n <= 100 * most and (magnitude < home_magnitude or "
        "magnitude = home_magnitude and (n < most or n = most and cls < home))"
    )
    # The matrix: how many of a set's first tokens a group holds; a member of the most favourable size is assumed
    # (but for one token of rounding, the farther its size, the less it must share).
    asked = (
        posted.select("token", "sig", "n", "cls", "magnitude").join(held, "token").where(fits)
        .groupBy("sig", "n", "cls", "home", "part", (F.col("magnitude") < F.col("home_magnitude")).alias("any_size"))
        .agg(F.count("*").alias("shared"), F.min("least").alias("least"), F.max("most").alias("most"))
    )
    n, more = F.col("n"), F.col("shared") + 1
    asked = asked.where(_can_link(more, n, _largest(n)) | F.col("any_size") & _can_link(more, n, _smallest(n)))
    return _ask(documents, text_column, staged(asked.select("sig", "cls", "home", "part"), "asked"), homes)


def _ask(documents: DataFrame, text_column: str, asked: DataFrame, homes: DataFrame) -> DataFrame:
    """Links of the asking sets (``sig, cls, home, part``) with members of the groups they ask, as edges ``a, b`` of classes."""
    members = homes.select("sig", "cls", F.col("cls").alias("home"), "part").join(asked.select("home", "part").distinct(), ["home", "part"], "left_semi")
    opened = staged(asked.withColumn("asks", F.lit(True)).unionByName(members.withColumn("asks", F.lit(False))), "opened")
    release(documents.sparkSession)
    tokens = _tokens(documents, text_column, homes, opened.select("sig"))
    rows = opened.join(tokens, "sig").select("home", "part", "asks", "sig", "cls", "tokens")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 2):
            asks = group.column("asks").to_numpy()
            cls, sets = group.column("cls").to_numpy(), _sets(group.column("tokens"))
            member = np.flatnonzero(~asks)
            if not len(member):  # a part of a large class that holds none of it, in step 4
                continue
            union = np.unique(np.concatenate([sets[i] for i in member]))
            opened = [i for i in np.flatnonzero(asks) if 100 * np.isin(sets[i], union, assume_unique=True).sum() >= PERCENT * len(sets[i])]
            found = set()
            for at in range(0, len(opened), PART):
                some = opened[at : at + PART]
                size = [np.array([len(sets[i]) for i in x]) for x in (some, member)]
                link = linked(overlaps([sets[i] for i in some], [sets[i] for i in member]), size[0][:, None], size[1][None, :])
                q, m = np.nonzero(link)
                found |= {(x, y) for x, y in zip(cls[np.array(some)[q]].tolist(), cls[member[m]].tolist(), strict=True) if x != y}
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = rows.repartition("home", "part").sortWithinPartitions("home", "part")
    links = staged(arrow_map(rows, compare, "a long, b long"), "links")
    unstaged(asked, opened)
    return links


def jaccard_join(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", part: int = PART) -> DataFrame:
    """One row per document: the size of its shingle set and the smallest id reachable by links."""
    spark = documents.sparkSession
    described = _describe(documents, id_column, text_column)
    sets = described.where("token is null").select("doc_id", F.col("n").alias("n_shingles"), "sig")
    marks = staged(described.where("sig is not null").groupBy("sig").agg(F.min(MARK).alias(MARK)), "marks")
    posted = _postings(documents, text_column, _frequent(described))
    release(spark)
    parts = _groups(posted, part)
    release(spark)
    near = parts.select("sig").unionByName(parts.select(F.col("pivot").alias("sig")))
    tops = posted.groupBy("sig").agg(F.max("n").alias("n")).join(marks, "sig").withColumn("cls", F.col("sig"))
    homes = _homes(tops, _open(parts, _tokens(documents, text_column, marks, near)), part, "inner")
    unstaged(marks)

    def still_mixed() -> DataFrame:
        # Classes only grow, so a token that lies in one stays there: a step needs the postings of the step before.
        mixed = staged(_mixed(posted, homes), "mixed")
        unstaged(posted)
        release(spark)
        return mixed

    posted = still_mixed()
    for _ in range(ROUNDS):
        links = _towards_largest(documents, text_column, posted, homes, part)
        if links.isEmpty():
            break
        homes = _homes(homes.select("sig", "n", MARK, "cls"), links, part, "rounds")
        posted = still_mixed()
    links = _across(documents, text_column, posted, homes)
    unstaged(posted)
    final = _homes(homes.select("sig", "n", MARK, "cls"), links, part, "outer").select("sig", "cls")
    release(spark)

    copies = sets.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least")).join(final, "sig", "left")
    named = copies.withColumn("cls", F.coalesce("cls", "sig"))
    least = named.groupBy("cls").agg(F.min("least").alias("component_id"))
    where = named.join(least, "cls").select("sig", "component_id")
    filled = sets.where("sig is not null").join(where, "sig").select("doc_id", "n_shingles", "component_id")
    empty = sets.where("sig is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return filled.unionByName(empty)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON m.x = d.doc_id
"""


@query("op7_jaccard_join", ORACLE)
def op7_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"))
