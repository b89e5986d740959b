"""CSV and JSON exports of filtered views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys, times

TIMELINE_COLUMNS = [
    "Timestamp",
    "Category",
    "Action",
    "Summary",
    "SubjectProcess",
    "SubjectUser",
    "ObjectFile",
    "ObjectUrl",
    "Confidence",
]
MFT_COLUMNS = {
    "Source": "source",
    "RecordIndex": "record_index",
    "FileName": "file_name",
    "FullPath": "full_path",
    "CreatedUtc": "created_utc",
    "ModifiedUtc": "modified_utc",
    "CreatedUtcFn": "created_utc_fn",
    "ModifiedUtcFn": "modified_utc_fn",
    "ParentRecordIndex": "parent_record_index",
    "IsInUse": "is_in_use",
    "TimeStompSuspect": "time_stomp_suspect",
    "IsDirectory": "is_directory",
}


def timeline_rows(events: DataFrame, *more: str) -> DataFrame:
    """The nine export columns, then ``more`` columns of the events; missing values are empty text."""
    values: list[Column] = [
        times.format_iso(F.col("ts")),
        F.col("category"),
        F.col("action"),
        F.col("summary"),
        F.col("subject_process.key"),
        keys.user_key_text(F.col("subject_user")),
        keys.file_key_text(F.col("object_file")),
        F.col("object_url"),
        F.col("confidence"),
    ]
    return events.select(*[F.coalesce(v, F.lit("")).alias(n) for n, v in zip(TIMELINE_COLUMNS, values)], *more)


def mft_rows(entries: DataFrame) -> DataFrame:
    stamps = {"created_utc", "modified_utc", "created_utc_fn", "modified_utc_fn"}
    return entries.select(
        *[(times.format_iso(F.col(c)) if c in stamps else F.col(c)).alias(n) for n, c in MFT_COLUMNS.items()]
    )


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_timeline_csv(events: DataFrame, path: str, start=None, end=None) -> None:
    """Timeline CSV; the filtered range goes to a sidecar next to it."""
    write_csv(timeline_rows(events), path)
    _write_range(events, path, start, end)


def write_timeline_json(events: DataFrame, path: str, start=None, end=None) -> None:
    rows = timeline_rows(events)
    write_json(rows.toDF(*[n[0].lower() + n[1:] for n in rows.columns]), path)
    _write_range(events, path, start, end)


def _write_range(events: DataFrame, path: str, start, end) -> None:
    if start is None or end is None:
        return
    meta = events.sparkSession.range(1).select(
        F.lit(str(start)).alias("timeRangeStart"), F.lit(str(end)).alias("timeRangeEnd")
    )
    meta.write.mode("overwrite").json(path.rstrip("/") + "_range")


def write_mft_csv(entries: DataFrame, path: str) -> None:
    write_csv(mft_rows(entries), path)


def write_mft_json(entries: DataFrame, path: str) -> None:
    write_json(mft_rows(entries), path)
