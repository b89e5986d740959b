"""Merkle manifest of a dataset: one tree a group, one tree over the groups, proofs by pointer jumping.

``manifest`` puts the leaves of each group in order, hashes runs of ``ARITY``
nodes level by level up to the group's subroot and likewise the subroots up to
the root. Every node below the root then holds a pointer to its parent and a
segment: its siblings in the run, left and right of it. A self-join of these
rows takes each pointer to its target's target and appends the target's
segment, so the distance doubles until all pointers are at the root. The leaves
of a run have the same way up: they ride in their run's row, and their own
first step, the rest of the run, is added when the run has arrived.

Scale: leaves get their seats from a range partitioning (hot groups are cut
like any other) and are grouped by run, never by group. Segments are joined for
runs, a sixteenth of the rows. Near the root many nodes share a target; a target
above ``weight`` runs stands in ``weight / SERVED`` copies, among which those
below it are dealt, so no key meets more than about ``SERVED`` rows. The driver
gets the number of groups, the largest group and the root.

Edge cases: nulls are leaves like others (``-``); rows of one group and id are
ordered by leaf digest, equal rows stay rows; a null id comes first, a null
group is a group and comes first; a single leaf is its group's subroot, a single
subroot is the root; an empty table gives an empty result. Carried columns keep
their names, whatever they are called; they must be sortable (no maps).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import query, staged, table

ARITY = 16
SERVED = 4096
STEP = "array<struct<left:string,right:string,top:boolean>>"


def digest(*columns: Column) -> Column:
    """Lower-case hex SHA-256 of fields, each as its UTF-8 length, a colon and its value, or ``-``."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The digest that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, leaf, lambda done, step: F.sha2(F.concat(step.left, done, step.right), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof in one string."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step.left, step.right)), "")


def _seated(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows ``g, o, digest, row`` with ``number`` (of the group), ``size`` and ``seat``; how many groups, and the largest."""
    order = ["g", "o", "digest", "tie"]
    kept = staged(rows.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    ordered = kept.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the partition in the upper bits, the place in it in the lower 33
    ordered = staged(ordered.drop("o", "tie").withColumn("at", at).withColumn("part", F.shiftright("at", 33)), "ordered")

    stretches = staged(ordered.groupBy("part", "g").agg(F.min("at").alias("first"), F.count("*").alias("n")), "stretches")
    groups = stretches.groupBy("g").agg(F.min("first").alias("start"), F.sum("n").alias("size"))
    groups = groups.withColumn("opens", F.shiftright("start", 33))
    # One row a partition: the groups that begin in earlier ones.
    opened = groups.groupBy("opens").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("opens").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    opened = opened.select("opens", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("opens").orderBy("start")) - 1
    groups = groups.withColumn("place", place).join(opened, "opens").select(F.col("g").alias("of"), "size", (F.col("place") + F.col("before")).alias("number"))
    groups = staged(groups, "groups")
    n_groups, most = groups.agg(F.count("*"), F.max("size")).first()

    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.withColumn("shift", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first"))
    stretches = stretches.join(groups, F.col("g").eqNullSafe(F.col("of")))
    stretches = stretches.select(F.col("part").alias("in_part"), "of", "shift", "size", "number")
    seated = ordered.join(stretches, (F.col("part") == F.col("in_part")) & F.col("g").eqNullSafe(F.col("of")))
    return seated.select("number", "size", (F.col("at") + F.col("shift")).alias("seat"), "digest", "row"), n_groups, most or 0


def _hashed(members: str) -> Column:
    return F.sha2(F.array_join(F.col(f"{members}.digest"), ""), 256)


def _run(column: str) -> Column:
    return F.expr(f"{column} div {ARITY}")


def _runs_of(n: int) -> int:
    return -(-n // ARITY)


def _others(members: str, top: Column) -> Column:
    """The step from a member at ``pos`` of a run to the run."""
    found = F.col(f"{members}.digest")
    left = F.array_join(F.slice(found, F.lit(1), F.col("pos")), "")
    right = F.array_join(F.slice(found, F.col("pos") + 2, F.lit(ARITY)), "")
    return F.struct(left.alias("left"), right.alias("right"), top.alias("top"))


def _climb(nodes: DataFrame, n: int, level: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The levels above ``nodes`` (``key, seat, n, id, digest, weight``) while a key has several, ``n`` at most.

    Gives the last nodes of all keys, and the tables of runs (``id, digest, weight, members``).
    """
    last, levels = [], []
    while n > 1:
        last.append(nodes.where("n = 1"))
        member = F.struct("seat", "id", "digest", "weight")
        runs = (
            nodes.where("n > 1").groupBy("key", "n", _run("seat").alias("up"))
            .agg(F.sort_array(F.collect_list(member)).alias("members"), F.sum("weight").alias("weight"))
        )
        level, n = level + 1, _runs_of(n)
        identity = F.struct(F.col("key").alias("number"), F.lit(level).alias("level"), F.col("up").alias("seat"))
        runs = runs.select("key", "n", F.col("up").alias("seat"), identity.alias("id"), "weight", "members", _hashed("members").alias("digest"))
        runs = staged(runs, "level")
        levels.append(runs)
        nodes = runs.select("key", "seat", F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), "id", "digest", "weight")
    return [*last, nodes], levels


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _steps(runs: DataFrame, top: bool) -> DataFrame:
    """Every member's pointer to its run, and the segment between."""
    return runs.select(F.col("id").alias("target"), F.col("weight").alias("target_weight"), "members", F.posexplode("members")).select(
        F.col("col.id").alias("id"), F.col("col.weight").alias("weight"), "target", "target_weight",
        F.array(_others("members", F.lit(top))).cast(STEP).alias("segment"),
    )


def _copies(weight: str) -> Column:
    return F.ceil(F.col(weight) / SERVED)


def jump(pointers: DataFrame, root: Column) -> DataFrame:
    """One self-join: pointers that are not at the root yet go to their target's target."""
    copy = F.explode(F.sequence(F.lit(0).cast("long"), _copies("weight") - 1))
    targets = pointers.select(
        F.col("id").alias("target"), copy.alias("copy"), F.col("target").alias("further"),
        F.col("target_weight").alias("further_weight"), F.col("segment").alias("more"),
    )
    going = pointers.where(F.col("target") != root).withColumn("copy", F.pmod(F.xxhash64("id"), _copies("target_weight")))
    gone = going.join(targets, ["target", "copy"]).select(
        "id", "weight", F.col("further").alias("target"), F.col("further_weight").alias("target_weight"),
        F.concat("segment", "more").alias("segment"),
    )
    return gone.unionByName(pointers.where(F.col("target") == root))


def manifest(rows: DataFrame, leaf_column: str = "leaf", id_column: str = "doc_id", group_column: str = "source") -> DataFrame:
    """All columns of ``rows`` with ``subroot``, ``root`` and ``proof``, the steps from the leaf to the root.

    A step has the digests ``left`` and ``right`` of the node in its run, as one
    string each; steps above the subroot are marked ``top``.
    """
    names = [c for c in rows.columns if c != leaf_column]
    wide = rows.select(
        F.col(f"`{group_column}`").alias("g"), F.col(f"`{id_column}`").alias("o"), F.col(f"`{leaf_column}`").alias("digest"),
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"),
    )
    seated, n_groups, most = _seated(wide)
    if not n_groups:
        empty = F.lit(None).cast("string")
        return rows.select("*", empty.alias("subroot"), empty.alias("root"), F.lit(None).cast(STEP).alias("proof")).limit(0)

    runs = seated.groupBy("number", "size", _run("seat").alias("run")).agg(F.sort_array(F.collect_list(F.struct("seat", "digest", "row"))).alias("members"))
    hashed = F.when(F.col("size") == 1, F.col("members")[0].digest).otherwise(_hashed("members"))
    identity = F.struct("number", F.lit(1).alias("level"), F.col("run").alias("seat"))
    runs = staged(runs.select("number", "size", "run", identity.alias("id"), "members", hashed.alias("digest")), "runs")

    nodes = runs.select(
        F.col("number").alias("key"), F.col("run").alias("seat"), F.expr(f"(size + {ARITY - 1}) div {ARITY}").alias("n"), "id", "digest", F.lit(1).cast("long").alias("weight")
    )
    subroots, inner = _climb(nodes, _runs_of(most), 1)
    nodes = _union(subroots).select(F.lit(-1).cast("long").alias("key"), F.col("key").alias("seat"), F.lit(n_groups).alias("n"), "id", "digest", "weight")
    tops, outer = _climb(nodes, n_groups, 0)
    (root, root_id), *_ = tops[-1].select("digest", "id").collect()  # one row
    at_root = F.struct(F.lit(root_id.number).alias("number"), F.lit(root_id.level).alias("level"), F.lit(root_id.seat).alias("seat"))

    segments = None
    steps = [_steps(x, False) for x in inner] + [_steps(x, True) for x in outer]
    if steps:
        pointers, reach = staged(_union(steps), "pointers"), 1
        while reach < len(steps):  # no way is longer than all levels together
            pointers, reach = staged(jump(pointers, at_root), "pointers"), 2 * reach
        segments = pointers.where("id.level = 1 and id.number >= 0").select("id", "segment")
        runs = runs.join(segments, "id", "left")
    else:
        runs = runs.withColumn("segment", F.lit(None).cast(STEP))
    segment = F.coalesce("segment", F.array().cast(STEP))
    runs = runs.withColumn("segment", segment).withColumn("subroot", fold(F.col("digest"), F.filter("segment", lambda step: ~step.top)))
    first = F.when(F.col("size") == 1, F.array().cast(STEP)).otherwise(F.array(_others("members", F.lit(False))).cast(STEP))
    return runs.select("size", "segment", "subroot", "members", F.posexplode("members")).select(
        *(F.col("col.row")[c].alias(c) for c in names), F.col("col.digest").alias(leaf_column), "subroot", F.lit(root).alias("root"),
        F.concat(first, "segment").alias("proof"),
    )


def _level(before: str, keys: str) -> str:
    """One level of a tree in SQL; a key with one node keeps it."""
    return (
        f"SELECT {keys} seat // 16 AS seat, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY seat)) END AS h, "
        f"(any_value(n) + 15) // 16 AS n FROM {before} GROUP BY {keys} seat // 16"
    )


def _sides(level: str, keys: str) -> str:
    frame = f"OVER (PARTITION BY {keys} seat // 16 ORDER BY seat ROWS BETWEEN"
    return (
        f"SELECT {keys} seat, n, h, coalesce(array_to_string(list(h) {frame} UNBOUNDED PRECEDING AND 1 PRECEDING), ''), ''), "
        f"coalesce(array_to_string(list(h) {frame} 1 FOLLOWING AND UNBOUNDED FOLLOWING), ''), '') FROM {level}"
    )


def _oracle(levels: int = 6, tops: int = 4) -> str:
    """The tree level by level, up to 16 ** levels rows a source and 16 ** tops sources."""
    fields = lambda text: " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = (
        "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda b: ascii(b)::BIGINT)), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"
    )
    parts = [
        f"d AS (SELECT doc_id, source, sha256({fields('text')}) AS leaf, coalesce({crc} % 5 = 0, false) AS hit, sha256({fields(lower)}) AS low FROM documents)",
        "g AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS seat, "
        "count(*) OVER (PARTITION BY source) AS n FROM d)",
        "l0 AS (SELECT k, seat, leaf AS h, n FROM g)",
    ]
    parts += [f"l{i + 1} AS ({_level(f'l{i}', 'k, ')})" for i in range(levels)]
    parts += [f"t0 AS (SELECT k AS seat, h, (SELECT count(*) FROM l{levels}) AS n FROM l{levels})"]
    parts += [f"t{i + 1} AS ({_level(f't{i}', '')})" for i in range(tops)]
    parts += [f"sl{i}(k, seat, n, h, l, r) AS ({_sides(f'l{i}', 'k, ')})" for i in range(levels)]
    parts += [f"st{i}(seat, n, h, l, r) AS ({_sides(f't{i}', '')})" for i in range(tops)]
    parts += ["c0 AS (SELECT doc_id, leaf, k, seat, CASE WHEN hit THEN low ELSE leaf END AS f, '' AS p FROM g)"]
    step = "CASE WHEN s.n = 1 THEN f ELSE sha256(l || f || r) END AS f, p || l || r AS p"
    parts += [f"c{i + 1} AS (SELECT doc_id, leaf, k, c.seat // 16 AS seat, {step} FROM c{i} c JOIN sl{i} s USING (k, seat))" for i in range(levels)]
    parts += [f"u0 AS (SELECT doc_id, leaf, k, k AS seat, h AS subroot, f, p FROM c{levels} JOIN (SELECT k, h FROM l{levels}) USING (k))"]
    parts += [f"u{i + 1} AS (SELECT doc_id, leaf, k, c.seat // 16 AS seat, subroot, {step} FROM u{i} c JOIN st{i} s USING (seat))" for i in range(tops)]
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, t.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = t.h AS verified FROM u{tops}, t{tops} t"
    )


@query("op12_merkle_manifest", _oracle())
def op12_merkle_manifest(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = documents.select(
        "doc_id", "source", digest(*fields, F.col("text")).alias("leaf"), F.when(hit, digest(*fields, lower)).alias("tampered")
    )
    proved = manifest(leaves)
    folded = proved.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"),
        fold(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
