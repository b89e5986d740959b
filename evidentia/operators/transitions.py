"""Successive snapshots as events: connections and processes that appear, change and vanish.

A snapshot row at number ``n`` is the current state of ``n`` and the previous
state of ``n + 1``. Grouping by (key, number) meets both, so no key is ever
walked in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.times import hour_bucket
from ..session import cut_lineage
from .asof import running_max
from .ranking import lag_by_chunk

SNAPSHOTS = 4096  # snapshots of one pid that a task looks at together


def number_snapshots(rows: DataFrame, ts: str = "snapshot_ts", host: str = "host") -> DataFrame:
    """Number the distinct snapshot times of a host 1, 2, 3 … as ``snapshot_id``."""
    calendar = rows.select(host, ts).distinct()
    numbered = calendar.withColumn(
        "snapshot_id", F.row_number().over(Window.partitionBy(host).orderBy(ts)).cast("bigint")
    )
    return rows.join(numbered, [host, ts])


def _paired(rows: DataFrame, keys: list[str], state: list[str]) -> DataFrame:
    """Current and previous state per key and snapshot number, with the snapshot's time."""
    packed = F.struct(*[F.col(c).alias(c) for c in [*state, "snapshot_ts"]])
    now = rows.select(*keys, "snapshot_id", packed.alias("now"), F.lit(None).cast(_type(rows, packed)).alias("before"))
    shifted = rows.select(
        *keys, (F.col("snapshot_id") + 1).alias("snapshot_id"), F.lit(None).cast(_type(rows, packed)).alias("now"),
        packed.alias("before"),
    )
    merged = now.unionByName(shifted).groupBy(*keys, "snapshot_id").agg(
        F.max("now").alias("now"), F.max("before").alias("before")
    )
    calendar = rows.groupBy("host", "snapshot_id").agg(F.max("snapshot_ts").alias("at"))
    return merged.join(calendar, ["host", "snapshot_id"])


def _type(rows: DataFrame, packed: Column):
    return rows.select(packed.alias("p")).schema["p"].dataType


def connection_transitions(observed: DataFrame) -> DataFrame:
    """Connect/Listen, Update and Disconnect rows from connection snapshots.

    ``observed``: ``host, snapshot_id, snapshot_ts, protocol, local_ep,
    remote_ep, pid, state`` with ``snapshot_id`` counting without gaps per host.
    An hour roll closes the old flow and opens the new one. The pid is part of
    the identity, as in the cache key of a live monitor.
    """
    keys = ["host", "protocol", "local_ep", "remote_ep", "pid"]
    rows = observed.withColumn("bucket", hour_bucket(F.col("snapshot_ts"))).select(
        *keys, "snapshot_id", "snapshot_ts", "state", "bucket"
    )
    paired = _paired(rows, keys, ["state", "bucket"])
    now, before = F.col("now"), F.col("before")
    opened = F.when(F.col("protocol") == "UDP", F.lit("Listen")).otherwise(F.lit("Connect"))
    rolled = now["bucket"] != before["bucket"]
    changed = (F.upper("protocol") == "TCP") & ~now["state"].eqNullSafe(before["state"])

    def step(action: Column | str, bucket: Column, state: Column) -> Column:
        return F.struct(
            (F.lit(action) if isinstance(action, str) else action).alias("action"),
            bucket.alias("time_bucket"),
            state.cast("string").alias("state"),
        )

    unknown = F.lit("Unknown")
    open_step = step(opened, now["bucket"], now["state"])
    close_step = step("Disconnect", before["bucket"], unknown)
    steps = (
        F.when(before.isNull(), F.array(open_step))
        .when(now.isNull(), F.array(close_step))
        .when(rolled, F.array(close_step, open_step))
        .when(changed, F.array(step("Update", now["bucket"], now["state"])))
    )
    return paired.select(*keys, "snapshot_id", F.col("at").alias("ts"), F.explode(steps).alias("e")).select(
        *keys, "snapshot_id", "ts", "e.*"
    )


def process_transitions(observed: DataFrame, chunk_width: int = SNAPSHOTS) -> DataFrame:
    """Start and Stop rows from process snapshots.

    ``observed``: ``host, snapshot_id, snapshot_ts, pid, create_time`` with
    ``create_time`` null where the monitor could not read it. While it is
    unknown the snapshot of first sight stands in; learning it later, or a
    reused pid, is a Stop and a Start. A pid occurs once per snapshot.

    Where a pid's run of snapshots began, and the create time last read, are
    running maxima of the snapshot number, taken in chunks of ``chunk_width``
    snapshots and carried over them, so a pid seen for years is no single window.
    """
    keys, chunk = ["host", "pid"], F.call_function("div", F.col("snapshot_id"), F.lit(chunk_width).cast("bigint"))
    seen = cut_lineage(observed.select(*keys, "snapshot_id", "snapshot_ts", "create_time"))
    seen = lag_by_chunk(seen, keys, ["snapshot_id"], chunk, ["snapshot_id"], prefix="_before_")
    began = F.col("_before_snapshot_id").isNull() | (F.col("snapshot_id") != F.col("_before_snapshot_id") + 1)
    seen = cut_lineage(seen.select(*keys, "snapshot_id", "snapshot_ts", "create_time", began.alias("_began"), chunk.alias("_chunk")))
    known = {
        "_run": F.when(F.col("_began"), F.struct("snapshot_id", "snapshot_ts")),
        "_read": F.when(F.col("create_time").isNotNull(), F.struct("snapshot_id", "create_time")),
    }
    seen = running_max(seen, keys, "snapshot_id", "_chunk", known)
    read = F.when(F.col("_read.snapshot_id") >= F.col("_run.snapshot_id"), F.col("_read.create_time"))
    effective = seen.select(*keys, "snapshot_id", "snapshot_ts", F.coalesce(read, "_run.snapshot_ts").alias("create"))
    paired = _paired(effective, ["host", "pid"], ["create"])
    now, before = F.col("now.create"), F.col("before.create")

    def step(action: str, create: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), create.alias("create_time"))

    steps = (
        F.when(before.isNull(), F.array(step("Start", now)))
        .when(now.isNull(), F.array(step("Stop", before)))
        .when(now != before, F.array(step("Stop", before), step("Start", now)))
    )
    return paired.select("host", "pid", "snapshot_id", F.col("at").alias("ts"), F.explode(steps).alias("e")).select(
        "host", "pid", "snapshot_id", "ts", "e.*"
    )
