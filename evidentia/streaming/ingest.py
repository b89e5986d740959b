"""Stateless ingest and built-in aggregations over event streams.

No watermark is set unless state needs one; late events are accepted.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.actions import normalize_event
from ..functions.bags import field
from ..functions.times import format_iso
from ..operators.connections import traffic_totals
from ..operators.trust import completeness
from ..operators.windows import stream_event_key


def normalize_append(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Normalise every arriving event and append it to the live table."""
    writer = (
        normalize_event(stream)
        .withColumn("event_date", F.to_date("ts"))
        .writeStream.format("parquet")
        .partitionBy("event_date")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_key() -> Column:
    """Identity of an event within its host."""
    return stream_event_key(
        F.col("category"),
        F.col("action"),
        format_iso(F.col("ts")),
        F.col("summary"),
        field(F.col("fields"), "RecordId"),
    )


def deduplicate(stream: DataFrame, horizon: str = "10 minutes") -> DataFrame:
    """Drop repeats of an event inside the horizon.

    State is bounded by time, not by a number of recent events.
    """
    return (
        stream.withColumn("event_key", event_key())
        .withWatermark("ts", horizon)
        .dropDuplicatesWithinWatermark(["host", "event_key"])
    )


def running_traffic(stream: DataFrame) -> DataFrame:
    """Running totals per connection, for update mode."""
    return traffic_totals(stream)


def hourly_flows(stream: DataFrame, lateness: str | None = None) -> DataFrame:
    """Events per connection and hour."""
    rows = stream.where(F.col("object_flow").isNotNull())
    if lateness:
        rows = rows.withWatermark("ts", lateness)
    return rows.groupBy(
        "host",
        F.window("ts", "1 hour").alias("w"),
        F.col("object_flow.protocol").alias("protocol"),
        F.col("object_flow.local_ep").alias("local_ep"),
        F.col("object_flow.remote_ep").alias("remote_ep"),
        F.col("object_flow.pid").alias("pid"),
    ).agg(F.count("*").alias("event_count")).select(
        "host", F.col("w.start").alias("time_bucket"), "protocol", "local_ep", "remote_ep", "pid", "event_count"
    )


def collection_level(counts: DataFrame) -> DataFrame:
    """Green, amber or red per row of ``event_count, cap, evicted, render_dropped``."""
    return counts.withColumn(
        "status",
        completeness(F.col("event_count"), F.col("cap"), F.col("evicted"), F.col("render_dropped")),
    )


def running_levels(stream: DataFrame, cap: int, evicted: str | None = None, render_dropped: str | None = None) -> DataFrame:
    """Completeness of everything received so far, a row per host whenever it changes (update mode).

    ``evicted`` and ``render_dropped`` name columns with counts that rows report; the
    state is one row per host, however the feed is cut into batches.
    """
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)) if name else F.lit(0)
    counts = stream.groupBy("host").agg(
        F.count("*").alias("event_count"),
        F.lit(cap).cast("bigint").alias("cap"),
        total(evicted).cast("bigint").alias("evicted"),
        total(render_dropped).cast("bigint").alias("render_dropped"),
    )
    return collection_level(counts)
