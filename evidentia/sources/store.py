"""The stored event table: range, category, page and count reads.

Written by :mod:`evidentia.sinks.store` with ``event_date`` partitions, so time
bounds prune folders and then row groups.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.filters import time_range
from ..operators.ranking import page, slice_rows, tie_columns
from ..sinks.store import ORDER, order_counts


def read_store(spark: SparkSession, path: str, start=None, end=None, category: str | None = None) -> DataFrame:
    """Stored events in a closed time range, optionally of one category."""
    rows = spark.read.parquet(path)
    if start is not None:
        rows = rows.where(F.col("event_date") >= F.lit(_day(start)).cast("date"))
    if end is not None:
        rows = rows.where(F.col("event_date") <= F.lit(_day(end)).cast("date"))
    rows = time_range(rows, start, end)
    if category is not None:
        rows = rows.where(F.col("category") == category)
    return rows.drop("event_date")


def _day(value: dt.datetime | str) -> str:
    return str(value)[:10]


def in_time_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("ts", "ingest_seq")


def read_category(spark: SparkSession, path: str, category: str) -> DataFrame:
    return read_store(spark, path, category=category)


def read_page(
    spark: SparkSession, path: str, offset: int, limit: int, start=None, end=None, category: str | None = None
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in time order, at any depth.

    The index beside the store tells how many rows stand before each minute, so a
    page is read from the minutes that hold it. Without an index, or if one does
    not count as many rows as the store has (an append broke off), the bounds are
    searched in the store itself.
    """
    rows = read_store(spark, path, start, end, category)
    bounds = _page_minutes(spark, path, rows, offset, limit, start, end, category) if limit > 0 else None
    if bounds is None:
        return page(rows.withColumn("_us", F.unix_micros("ts")), [("_us", False), ("ingest_seq", False)], offset, limit).drop("_us")
    if bounds["first"] is None:
        return rows.where(F.lit(False))
    first, last = (F.timestamp_micros(F.lit(bounds[k]).cast("bigint")) for k in ("first", "last"))
    inside = rows.where((F.col("ts") >= first) & (F.col("ts") < last + F.expr("INTERVAL 1 MINUTE")))
    ordering = [F.col("ts").asc(), F.col("ingest_seq").asc(), *tie_columns(rows, [("ts", False), ("ingest_seq", False)])]
    before = offset - bounds["before"]
    return slice_rows(inside, ordering, before, before + limit).orderBy("ts", "ingest_seq")


def _page_minutes(spark: SparkSession, path: str, rows: DataFrame, offset: int, limit: int, start, end, category: str | None):
    """First and last minute of a page, and the rows before the first; None without a valid index."""
    try:
        index = spark.read.parquet(f"{path.rstrip('/')}/{ORDER}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if (index.agg(F.sum("n")).first()[0] or 0) != spark.read.parquet(path).count():  # the store's count is in its footers
        return None
    whole, edge = F.lit(True), F.lit(False)
    for bound, beyond in ((start, True), (end, False)):
        if bound is not None:
            minute = F.unix_micros(F.lit(str(bound)).cast("timestamp")) - F.pmod(F.unix_micros(F.lit(str(bound)).cast("timestamp")), F.lit(60_000_000))
            whole = whole & (F.col("minute") > minute if beyond else F.col("minute") < minute)
            edge = edge | (F.date_trunc("minute", "ts") == F.timestamp_micros(minute))
    listed = index if category is None else index.where(F.col("category") == category)
    # Minutes that the range cuts are counted from their rows.
    minutes = listed.where(whole).select("day", "minute", "n").unionByName(order_counts(rows.where(edge)).select("day", "minute", "n"))
    minutes = minutes.groupBy("day", "minute").agg(F.sum("n").alias("n"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    days = minutes.groupBy("day").agg(F.sum("n").alias("in_day"))
    days = days.select("day", F.coalesce(F.sum("in_day").over(earlier(Window.orderBy("day"))), F.lit(0)).alias("days_before"))  # one row a day
    placed = minutes.join(days, "day").withColumn(
        "before", F.col("days_before") + F.coalesce(F.sum("n").over(earlier(Window.partitionBy("day").orderBy("minute"))), F.lit(0))
    )
    touched = placed.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
    return touched.agg(F.min("minute").alias("first"), F.max("minute").alias("last"), F.min("before").alias("before")).first()


def count_events(spark: SparkSession, path: str, start=None, end=None, category: str | None = None) -> DataFrame:
    return read_store(spark, path, start, end, category).agg(F.count("*").alias("event_count"))
