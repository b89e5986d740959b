"""The event store: Parquet by day, sorted so that row groups prune by category and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EVENT_SCHEMA


def _laid_out(events: DataFrame) -> DataFrame:
    """Rows of a day spread by hash of the arrival number, so one busy day is many files."""
    dated = events.withColumn("event_date", F.to_date("ts"))
    return dated.repartition("event_date", F.pmod(F.xxhash64("host", "ingest_seq"), F.lit(64))).sortWithinPartitions(
        "event_date", "category", "ts"
    )


ORDER = "_order"


def order_counts(events: DataFrame) -> DataFrame:
    """Events per day, minute and category, from which the place of any row in time order follows."""
    minute = F.unix_micros("ts") - F.pmod(F.unix_micros("ts"), F.lit(60_000_000))
    return events.groupBy(F.to_date("ts").alias("day"), minute.alias("minute"), "category").agg(F.count("*").alias("n"))


def _index(events: DataFrame, path: str, mode: str) -> None:
    order_counts(events).coalesce(1).write.mode(mode).parquet(f"{path.rstrip('/')}/{ORDER}")


def write_store(events: DataFrame, path: str) -> None:
    """Replace the store by these events; an index of their order is kept beside them."""
    _laid_out(events.select(*EVENT_SCHEMA.names)).write.mode("overwrite").partitionBy("event_date").parquet(path)
    _index(events, path, "overwrite")


def append_store(events: DataFrame, path: str) -> None:
    """Add events to the store and their counts to its index."""
    _laid_out(events.select(*EVENT_SCHEMA.names)).write.mode("append").partitionBy("event_date").parquet(path)
    _index(events, path, "append")


def migrate_store(old: DataFrame) -> DataFrame:
    """Rows of a version-1 store (``id, timestamp, data``) with the category back-filled from the JSON."""
    valid = F.get_json_object("data", "$.timestamp").isNotNull() & F.get_json_object("data", "$.action").isNotNull()
    category = F.when(valid, F.get_json_object("data", "$.category"))
    return old.withColumns({"category": F.coalesce(category, F.lit("")), "schema_version": F.lit("2")})
