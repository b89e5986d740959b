"""Full paths of file-table entries by pointer doubling.

Only entries that are somebody's parent take part in the doubling; each round
doubles the distance a path reaches and is checkpointed. Every other entry is
joined once to its parent's finished path. Entries whose ancestors form a
cycle never finish; they are the ones left when a round finishes none, and are
walked step by step with the visited list that the cycle needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _prepend(above: Column, path: Column) -> Column:
    """``above\\path``; nameless ancestors leave no mark."""
    return F.when(F.coalesce(F.length(above), F.lit(0)) == 0, path).otherwise(F.concat(above, F.lit("\\"), path))


def _prefix(above: Column, own: Column) -> Column:
    """What a folder contributes to the paths below it."""
    return F.when(F.coalesce(F.length(own), F.lit(0)) == 0, F.coalesce(above, F.lit(""))).otherwise(_prepend(above, own))


def full_paths(
    entries: DataFrame,
    keys: tuple[str, ...] = ("host", "source"),
    index: str = "record_index",
    parent: str = "parent_record_index",
    name: str = "file_name",
    path: str = "full_path",
) -> DataFrame:
    """Set ``path`` to the names from the topmost known ancestor down, joined by backslashes.

    A walk ends at an entry that is its own parent, at a missing parent, or
    before it would revisit an entry.
    """
    keys = list(keys)
    base = entries.select(*keys, F.col(index).alias("_id"), F.col(name).alias("_name"), F.col(parent).alias("_up"))
    edges = base.withColumn("_up", F.when(F.col("_up") != F.col("_id"), F.col("_up")))
    parents = edges.where(F.col("_up").isNotNull()).select(*keys, F.col("_up").alias("_id")).distinct()
    folders = cut_lineage(edges.join(parents, [*keys, "_id"], "left_semi"))

    state = folders.select(*keys, "_id", F.col("_name").alias("_path"), F.col("_up").alias("_next"))
    done = state.where(F.col("_next").isNull())
    todo = state.where(F.col("_next").isNotNull())
    remaining = todo.count()
    while remaining:
        reach = done.unionByName(todo).select(
            *keys, F.col("_id").alias("_next"), F.col("_path").alias("_above"), F.col("_next").alias("_far")
        )
        advanced = cut_lineage(
            todo.join(reach, [*keys, "_next"], "left").select(
                *keys,
                "_id",
                F.when(F.col("_above").isNull(), F.col("_path"))
                .otherwise(_prefix(F.col("_above"), F.col("_path")))
                .alias("_path"),
                F.col("_far").alias("_next"),
            )
        )
        done = done.unionByName(advanced.where(F.col("_next").isNull()))
        todo = advanced.where(F.col("_next").isNotNull())
        left = todo.count()
        if left == remaining:
            break
        remaining = left

    rows = _attach(entries, done, keys, index, parent, name, path)
    if remaining:
        cyclic = folders.join(todo.select(*keys, "_id"), [*keys, "_id"], "left_semi")
        walked = _walk_cycles(cyclic, keys)
        reached = walked.select(*keys, "_id", F.col("_prefix").alias("_path"), F.lit(None).cast("bigint").alias("_next"))
        below = _attach(entries, done.unionByName(reached), keys, index, parent, name, path)
        own = walked.select(*keys, F.col("_id").alias(index), F.col("_path").alias("_own"))
        rows = below.join(own, [*keys, index], "left").withColumn(path, F.coalesce("_own", path)).drop("_own")
    return rows.select(*entries.columns if path in entries.columns else [*entries.columns, path])


def _attach(
    entries: DataFrame, folders: DataFrame, keys: list[str], index: str, parent: str, name: str, path: str
) -> DataFrame:
    above = folders.select(*keys, F.col("_id").alias(parent), F.col("_path").alias("_above"))
    joined = entries.join(above, [*keys, parent], "left")
    own = F.when(F.col(parent) != F.col(index), F.col("_above"))
    return joined.withColumn(path, _prepend(own, F.col(name))).drop("_above")


def _walk_cycles(cyclic: DataFrame, keys: list[str]) -> DataFrame:
    """Each entry's own walk; a step joins the walkers to the entry they reach next."""
    step = cyclic.select(
        *keys, F.col("_id").alias("_next"), F.col("_name").alias("_above"), F.col("_up").alias("_far")
    )
    own = F.col("_name")
    walkers = cyclic.select(
        *keys,
        "_id",
        own.alias("_path"),
        F.coalesce(own, F.lit("")).alias("_prefix"),
        F.col("_up").alias("_next"),
        F.array("_id").alias("_seen"),
    )
    ended = None
    while True:
        stop = F.col("_next").isNull() | F.array_contains("_seen", F.col("_next"))
        finished = walkers.where(stop).select(*keys, "_id", "_path", "_prefix")
        ended = finished if ended is None else ended.unionByName(finished)
        active = walkers.where(~stop)
        walkers = cut_lineage(
            active.join(step, [*keys, "_next"], "left").select(
                *keys,
                "_id",
                _prepend(F.col("_above"), F.col("_path")).alias("_path"),
                _prefix(F.col("_above"), F.col("_prefix")).alias("_prefix"),
                F.col("_far").alias("_after"),
                F.array_append("_seen", F.col("_next")).alias("_seen"),
            )
        ).withColumnRenamed("_after", "_next")
        if walkers.isEmpty():
            return ended
