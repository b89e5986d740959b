"""Continuous event feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import EVENT_SCHEMA


def read_event_stream(
    spark: SparkSession, path: str, format: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """A stream of events from a folder that collectors append to."""
    reader = spark.readStream.format(format).schema(EVENT_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def read_record_stream(spark: SparkSession, format: str, schema, **options: str) -> DataFrame:
    """Any streaming source Spark offers (Kafka, files, rate) with a record schema where it takes one."""
    reader = spark.readStream.format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load()
