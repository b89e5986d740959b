"""Running results of a stream as a table by key, written by batch number.

Every micro-batch writes what it adds (or what has changed) under its number,
so a repeated batch writes the same files again. Every ``EVERY`` batches the rows
so far are merged into one base; a base is written before the batch that
completes it, so whoever sees a batch finds its base. The stream itself keeps no
state for sums, and only the open windows for windowed counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.connections import traffic_totals
from .ingest import hourly_flows

EVERY = 16
TRAFFIC_KEYS = ["host", "protocol", "local_ep", "remote_ep", "pid"]
HOURLY_KEYS = ["host", "time_bucket", "protocol", "local_ep", "remote_ep", "pid"]


def _merged(rows: DataFrame, keys: list[str], values: list[str], add: bool) -> DataFrame:
    """One row a key: sums, or the values of the last batch that has the key."""
    if add:
        return rows.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values], F.max("batch").alias("batch"))
    last = F.max_by(F.struct(*values), "batch").alias("last")
    return rows.groupBy(*keys).agg(last, F.max("batch").alias("batch")).select(*keys, *[f"last.{v}" for v in values], "batch")


def _so_far(spark: SparkSession, folder: str, number: int, every: int) -> DataFrame:
    """The rows of all batches up to ``number``: a base and the batches behind it."""
    base = number // every * every
    rows = spark.read.parquet(*[f"{folder}/parts/{n}" for n in range(base + (base > 0), number + 1)]) if number > base or base == 0 else None
    if base == 0:
        return rows
    merged = spark.read.parquet(f"{folder}/base/{base}")
    return merged if rows is None else merged.unionByName(rows)


def write_keyed(
    stream: DataFrame, folder: str, keys: list[str], values: list[str], add: bool, summarise: Callable[[DataFrame], DataFrame] | None = None, every: int = EVERY
) -> DataStreamWriter:
    """A writer of ``stream`` to a keyed table; set its trigger and start it.

    ``summarise`` turns a micro-batch into one row a key. With ``add`` values of
    batches are summed, else those of the last batch count (for update mode).
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = (summarise(batch) if summarise else batch).select(*keys, *values).withColumn("batch", F.lit(number).cast("bigint"))
        rows.write.mode("overwrite").parquet(f"{folder}/parts/{number}")
        if number and number % every == 0:
            before = _so_far(spark, folder, number - 1, every).unionByName(spark.read.parquet(f"{folder}/parts/{number}"))
            _merged(before, keys, values, add).write.mode("overwrite").parquet(f"{folder}/base/{number}")
        spark.createDataFrame([(number,)], "number bigint").write.mode("overwrite").parquet(f"{folder}/done/{number % 2}")

    return stream.writeStream.foreachBatch(step).outputMode("append" if add else "update").option("checkpointLocation", f"{folder}/log")


def read_keyed(spark: SparkSession, folder: str, keys: list[str], values: list[str], add: bool, every: int = EVERY) -> DataFrame:
    """The table as of the last whole batch."""
    number = spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/done").agg(F.max("number")).first()[0]
    return _merged(_so_far(spark, folder, number, every), keys, values, add).drop("batch")


COUNTERS = ["sent_bytes", "recv_bytes", "sent_packets", "recv_packets"]


def traffic_table(stream: DataFrame, folder: str, every: int = EVERY) -> DataStreamWriter:
    """Sent and received bytes and packets per connection."""
    return write_keyed(stream, folder, TRAFFIC_KEYS, COUNTERS, True, traffic_totals, every)


def hourly_table(stream: DataFrame, folder: str, lateness: str, every: int = EVERY) -> DataStreamWriter:
    """Events per connection and hour; an hour leaves the state when the watermark has passed it."""
    return write_keyed(hourly_flows(stream, lateness), folder, HOURLY_KEYS, ["event_count"], False, None, every)
