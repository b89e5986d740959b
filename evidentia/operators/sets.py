"""Unions, differences and distinct sets over event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import keep_first


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All sources as one event set."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_live(snapshot: DataFrame, live: DataFrame) -> DataFrame:
    """Append every live event to the snapshot; nothing is deduplicated."""
    return snapshot.unionByName(live, allowMissingColumns=True)


def new_items(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``current`` that ``baseline`` lacks.

    Both sides shrink to distinct keys before the anti join, so repeated keys
    never reach the shuffle as rows.
    """
    return current.select(*keys).distinct().join(baseline.select(*keys).distinct(), keys, "left_anti")


def new_processes(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Process keys of each host's current collection that are not in its baseline, by text form."""
    pick = lambda df: df.where(F.col("subject_process").isNotNull()).select(
        "host", F.col("subject_process.key").alias("process_key")
    )
    return new_items(pick(current), pick(baseline), ["host", "process_key"])


def new_connections(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Flow keys of each host's current collection that are not in its baseline."""
    pick = lambda df: df.where(F.col("object_flow").isNotNull()).select(
        "host", F.col("object_flow.key").alias("flow_key")
    )
    return new_items(pick(current), pick(baseline), ["host", "flow_key"])


def gone_keys(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Keys observed before and missing now: closed connections, ended pids."""
    return new_items(previous, current, keys)


def undeclared_files(present: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    return new_items(present, declared, keys)


def distinct_ignore_case(rows: DataFrame, column: str, seq: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """First spelling of each value, ignoring case."""
    folded = F.lower(column).alias("_folded")
    return rows.groupBy(*keys, folded).agg(F.min_by(column, seq).alias(column)).drop("_folded")


def merge_mft(sources: list[DataFrame], cap: int = 0) -> tuple[DataFrame, DataFrame]:
    """Concatenate file tables in order; returns the rows and a one-row truncation flag.

    Record indexes collide between sources, so ``source_ordinal`` stays with the
    row. The cap keeps whole sources in order, then the first rows by index.
    """
    tagged = [df.withColumn("source_ordinal", F.lit(i)) for i, df in enumerate(sources)]
    merged = reduce(lambda a, b: a.unionByName(b), tagged)
    order = merged.withColumn(
        "_order", F.col("source_ordinal").cast("bigint") * F.lit(2**48) + F.col("record_index")
    )
    kept = keep_first(order, cap, "_order").drop("_order")
    flag = merged.agg(
        F.count("*").alias("total_rows"),
        ((F.count("*") > cap) & F.lit(cap > 0)).alias("truncated"),
    )
    return kept, flag
