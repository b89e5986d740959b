"""The activity-event contract shared by every source, operator and sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROCESS_KEY = T.StructType(
    [
        T.StructField("boot_id", T.DecimalType(20, 0)),
        T.StructField("pid", T.LongType()),
        T.StructField("create_time", T.TimestampType()),
        T.StructField("key", T.StringType()),
    ]
)
USER_KEY = T.StructType([T.StructField("sid", T.StringType())])
FILE_KEY = T.StructType(
    [
        T.StructField("volume_serial", T.StringType()),
        T.StructField("file_id", T.DecimalType(20, 0)),
        T.StructField("path", T.StringType()),
        T.StructField("hash", T.StringType()),
    ]
)
REGISTRY_KEY = T.StructType([T.StructField("path", T.StringType())])
FLOW_KEY = T.StructType(
    [
        T.StructField("protocol", T.StringType()),
        T.StructField("local_ep", T.StringType()),
        T.StructField("remote_ep", T.StringType()),
        T.StructField("pid", T.LongType()),
        T.StructField("time_bucket", T.TimestampType()),
        T.StructField("key", T.StringType()),
    ]
)
EVIDENCE = T.ArrayType(
    T.StructType(
        [
            T.StructField("source", T.StringType()),
            T.StructField("reference", T.StringType()),
            T.StructField("hash", T.StringType()),
            T.StructField("collected_at", T.TimestampType()),
        ]
    )
)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("collection_id", T.StringType()),
        T.StructField("ingest_seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("ts_ticks", T.LongType()),
        T.StructField("category", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("subject_process", PROCESS_KEY),
        T.StructField("subject_user", USER_KEY),
        T.StructField("object_file", FILE_KEY),
        T.StructField("object_registry", REGISTRY_KEY),
        T.StructField("object_flow", FLOW_KEY),
        T.StructField("object_url", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("evidence", EVIDENCE),
        T.StructField("confidence", T.StringType()),
    ]
)

MFT_SCHEMA = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("record_index", T.LongType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("full_path", T.StringType()),
        T.StructField("parent_record_index", T.LongType()),
        T.StructField("created_utc", T.TimestampType()),
        T.StructField("modified_utc", T.TimestampType()),
        T.StructField("created_utc_fn", T.TimestampType()),
        T.StructField("modified_utc_fn", T.TimestampType()),
        T.StructField("time_stomp_suspect", T.BooleanType()),
        T.StructField("is_in_use", T.BooleanType()),
        T.StructField("is_directory", T.BooleanType()),
    ]
)

HOST_KEYS = ("host", "collection_id")


def string_map(pairs: dict[str, Column | str]) -> Column:
    """A ``MAP<STRING,STRING>`` of the non-null values among ``pairs``."""
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("key"),
                (F.lit(value) if isinstance(value, str) else value).cast("string").alias("value"),
            )
            for name, value in pairs.items()
        ]
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def evidence_ref(
    source: Column | str,
    reference: Column,
    hash_: Column | None = None,
    collected_at: Column | None = None,
    default_now: bool = False,
) -> Column:
    """One evidence struct; with ``default_now`` a missing collection time becomes now."""
    when = F.lit(None).cast("timestamp") if collected_at is None else collected_at.cast("timestamp")
    if default_now:
        when = F.coalesce(when, F.current_timestamp())
    return F.struct(
        (F.lit(source) if isinstance(source, str) else source).cast("string").alias("source"),
        reference.cast("string").alias("reference"),
        (F.lit(None) if hash_ is None else hash_).cast("string").alias("hash"),
        when.alias("collected_at"),
    )


def to_events(df: DataFrame, **columns: Column) -> DataFrame:
    """Select ``columns`` into the event schema; absent ones become typed nulls.

    ``ts_ticks`` defaults to the exact 100 ns count of ``ts``. Key structs come
    from :mod:`evidentia.functions.keys` and are taken as they are: a cast
    would keep the optimizer from reading one field without building them all.
    """
    if "ts" in columns and "ts_ticks" not in columns:
        columns["ts_ticks"] = F.unix_micros(columns["ts"].cast("timestamp")) * 10
    columns.setdefault("fields", F.create_map().cast("map<string,string>"))
    columns.setdefault("evidence", F.array().cast(EVIDENCE))
    columns.setdefault("confidence", F.lit("Medium"))
    for name in HOST_KEYS + ("ingest_seq",):
        if name not in columns and name in df.columns:
            columns[name] = F.col(name)
    unknown = set(columns) - set(EVENT_SCHEMA.names)
    if unknown:
        raise ValueError(f"not event columns: {sorted(unknown)}")
    return df.select(
        *[
            columns[field.name].alias(field.name)
            if field.name in columns and isinstance(field.dataType, T.StructType)
            else columns.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
            for field in EVENT_SCHEMA
        ]
    )
