"""The anchored throttle over a stream: the batch operator on every micro-batch, with the open windows carried on.

A busy category is spread over tasks within each micro-batch, as in
:mod:`evidentia.operators.throttle`; between batches there is one state row a
category. Rows and state are written by batch number, so a repeated batch
writes the same files again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.throttle import STATE, throttled


def throttle_stream(stream: DataFrame, folder: str, limits: dict[str, int] | None = None, common: int = 0) -> DataStreamWriter:
    """A writer of the throttled ``host, category, ingest_seq, ts`` rows to ``folder``/rows; set its trigger and start it.

    Each micro-batch is taken in order of its arrival numbers, after all batches before it.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = spark.read.schema(STATE).parquet(f"{folder}/state/batch-{number - 1}") if number else None
        rows, after = throttled(batch, limits, common, state)
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        after.write.mode("overwrite").parquet(f"{folder}/state/batch-{number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/log")


def read_throttled(spark, folder: str) -> DataFrame:
    """All rows written so far."""
    return spark.read.parquet(f"{folder}/rows").drop("batch")
