"""Process inventory, parents and children.

The inventory is one partial aggregation over the events: every column is a
``min_by``/``max_by``/``count``, so a key with a third of all events costs one
buffer per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.actions import normalize_action
from ..functions.bags import authenticode_summary, field, first_field, parent_pid, parse_int
from ..functions.paths import file_name
from ..functions.text import not_blank
from .ranking import first_by, last_by

# Image names (without .exe) that belong to the operating system.
OS_PROCESSES = [
    "System",
    "System Idle Process",
    "smss",
    "csrss",
    "wininit",
    "services",
    "lsass",
    "lsm",
    "svchost",
    "winlogon",
    "explorer",
    "spoolsv",
    "dwm",
    "fontdrvhost",
    "sihost",
    "taskhostw",
    "runtimebroker",
    "dllhost",
    "conhost",
    "ctfmon",
    "searchindexer",
    "searchhost",
    "searchui",
    "shellexperiencehost",
    "startmenuexperiencehost",
    "smartscreen",
    "wuauclt",
    "audiodg",
    "securityhealthservice",
    "securityhealthsystray",
    "wudfhost",
]

# Inventory column to the Start-event field it shows.
START_FIELDS = {
    "command_line": "CommandLine",
    "integrity": "Integrity",
    "company": "Company",
    "hash": "Hash",
    "owner_sid": "OwnerSid",
    "parent_image_path": "ParentImagePath",
}


def is_os_process(name: Column, company: Column, image_path: Column, windows_dir: str = r"C:\Windows") -> Column:
    bare = F.regexp_replace(F.lower(name), r"\.exe$", "")
    listed = bare.isin([p.lower() for p in OS_PROCESSES])
    vendor = (F.lower(company) == "microsoft corporation") & F.lower(image_path).startswith(windows_dir.lower())
    return F.coalesce(listed, F.lit(False)) | F.coalesce(vendor, F.lit(False))


def process_inventory(events: DataFrame, keys: tuple[str, ...] = ("host", "collection_id")) -> DataFrame:
    """One row per process key seen in category Process, over all events of the key."""
    bag, key = F.col("fields"), F.col("subject_process")
    arrival, by_time = F.col("ingest_seq"), (F.col("ts"), F.col("ingest_seq"))
    latest = (F.col("ts"), -F.col("ingest_seq"))
    is_start = F.col("action") == "Start"
    start_row = F.struct(
        first_field(bag, "ProcessName").alias("process_name"),
        field(bag, "UserName").alias("user_name"),
        first_field(bag, "ImagePath", "ExecutablePath", "ProcessPath").alias("image_path"),
        parse_int(field(bag, "SessionId")).alias("session_id"),
        authenticode_summary(bag).alias("authenticode"),
        *[field(bag, name).alias(column) for column, name in START_FIELDS.items()],
    )
    last_row = F.struct(
        first_field(bag, "ProcessName").alias("process_name"),
        field(bag, "Operation").alias("operation"),
        field(bag, "Result").alias("result"),
    )
    parent = parent_pid(bag)
    grouped = (
        events.where(key.isNotNull())
        .groupBy(*keys, key["key"].alias("process_key"))
        .agg(
            F.first(key["pid"]).alias("pid"),
            F.first(key["create_time"]).alias("start_time"),
            F.count("*").alias("event_count"),
            F.min(arrival).alias("first_seq"),
            F.bool_or(F.col("category") == "Process").alias("_listed"),
            F.bool_or(is_start).alias("_started"),
            first_by(start_row, *by_time, where=is_start).alias("_start"),
            last_by(last_row, *latest).alias("_last"),
            first_by(parent, arrival, where=parent > 0).alias("parent_pid"),
        )
        .where("_listed")
    )
    shown = F.when(F.col("_started"), F.col("_start.process_name")).otherwise(F.col("_last.process_name"))
    empty = F.lit("")
    return grouped.select(
        *keys,
        "process_key",
        "pid",
        "start_time",
        "event_count",
        "first_seq",
        "parent_pid",
        F.coalesce(shown, F.concat(F.lit("PID "), F.col("pid").cast("string"))).alias("process_name"),
        F.coalesce(F.col("_start.user_name"), F.lit("Unknown")).alias("user_name"),
        F.coalesce(F.col("_start.image_path"), empty).alias("image_path"),
        F.coalesce(F.col("_start.authenticode"), empty).alias("authenticode"),
        F.col("_start.session_id").alias("session_id"),
        *[F.coalesce(F.col(f"_start.{column}"), empty).alias(column) for column in START_FIELDS],
        F.coalesce(F.col("_last.operation"), empty).alias("last_operation"),
        F.coalesce(F.col("_last.result"), empty).alias("last_result"),
    )


def first_start_last_event(events: DataFrame, keys: list[str]) -> DataFrame:
    """First Start and last event per key, as sequence numbers and times."""
    by_time, latest = (F.col("ts"), F.col("ingest_seq")), (F.col("ts"), -F.col("ingest_seq"))
    row = F.struct(F.col("ingest_seq").alias("seq"), F.col("ts").alias("ts"), F.col("action").alias("action"))
    return (
        events.groupBy(*keys)
        .agg(
            first_by(row, *by_time, where=F.col("action") == "Start").alias("start"),
            last_by(row, *latest).alias("last"),
        )
        .select(
            *keys,
            F.col("start.seq").alias("start_seq"),
            F.col("start.ts").alias("start_ts"),
            F.col("last.seq").alias("last_seq"),
            F.col("last.ts").alias("last_ts"),
            F.col("last.action").alias("last_action"),
        )
    )


def latest_per_key(rows: DataFrame, keys: list[str], ts: str, columns: list[str], seq: str = "ingest_seq") -> DataFrame:
    """The newest row per key (ties to the earlier arrival), as an aggregate instead of a window."""
    packed = F.struct(*[F.col(c).alias(c) for c in columns])
    return (
        rows.groupBy(*keys)
        .agg(last_by(packed, F.col(ts), -F.col(seq)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])
    )


def pid_map(inventory: DataFrame, host: str = "host") -> DataFrame:
    """Latest-created process per pid with its name and parent."""
    packed = F.struct(F.col("process_name").alias("name"), F.col("parent_pid").alias("parent"))
    return (
        inventory.where(F.col("pid") > 0)
        .groupBy(host, "pid")
        .agg(last_by(packed, F.col("start_time"), -F.col("first_seq")).alias("p"))
        .select(host, "pid", F.col("p.name").alias("process_name"), F.col("p.parent").alias("parent_pid"))
    )


def with_ancestors(inventory: DataFrame, host: str = "host") -> DataFrame:
    """Add parent and grandparent names by pid; ``is_root`` where no parent row exists.

    The pid map (one row per pid) resolves its own parents first, so the
    inventory itself is joined only once.
    """
    pids = pid_map(inventory, host)
    grand = pids.select(
        F.col(host), F.col("pid").alias("parent_pid"), F.col("process_name").alias("_grandparent")
    )
    parents = pids.join(grand, [host, "parent_pid"], "left").select(
        F.col(host),
        F.col("pid").alias("parent_pid"),
        F.col("process_name").alias("_parent"),
        F.when(F.col("parent_pid") > 0, F.col("_grandparent")).alias("_grandparent"),
    )
    return inventory.join(parents, [host, "parent_pid"], "left").select(
        *[inventory[c] for c in inventory.columns],
        F.coalesce(F.col("_parent"), F.lit("")).alias("parent_name"),
        F.coalesce(F.col("_grandparent"), F.lit("")).alias("grandparent_name"),
        F.col("_parent").isNull().alias("is_root"),
    )


def child_names(inventory: DataFrame, host: str = "host") -> DataFrame:
    """Distinct child names per parent pid, one row each: the scalable form of :func:`children`."""
    return (
        inventory.where(F.col("parent_pid").isNotNull())
        .groupBy(host, "parent_pid", F.lower("process_name").alias("folded_name"))
        .agg(first_by(F.col("process_name"), F.col("first_seq")).alias("child_name"))
    )


def children(inventory: DataFrame, host: str = "host") -> DataFrame:
    """Child names joined by ``, ``: duplicates fold away before a parent's list is gathered."""
    packed = F.array_sort(F.collect_list(F.struct("folded_name", "child_name")))
    return (
        child_names(inventory, host)
        .groupBy(host, F.col("parent_pid").alias("pid"))
        .agg(F.array_join(F.transform(packed, lambda s: s["child_name"]), ", ").alias("child_names"))
    )


def with_parent_image(
    starts: DataFrame, keys: tuple[str, ...] = ("host", "snapshot_id"), pid: str = "pid", parent: str = "parent_pid"
) -> DataFrame:
    """Image path of the parent in the same process snapshot."""
    parents = (
        starts.where(not_blank(F.col("image_path")).isNotNull())
        .groupBy(*keys, F.col(pid).alias(parent))
        .agg(F.max("image_path").alias("parent_image_path"))
    )
    joined = starts.join(parents, [*keys, parent], "left")
    return joined.withColumn(
        "parent_image_path",
        F.when(F.col(parent) > 0, F.coalesce(F.col("parent_image_path"), F.lit(""))).otherwise(F.lit("")),
    )


def entities(events: DataFrame) -> dict[str, DataFrame]:
    """Distinct processes, users, files and flows of the events."""
    picks = {
        "processes": "subject_process",
        "users": "subject_user",
        "files": "object_file",
        "network_flows": "object_flow",
    }
    return {
        name: events.where(F.col(column).isNotNull()).select("host", f"{column}.*").distinct()
        for name, column in picks.items()
    }


def module_name(image_path: Column, process_name: Column) -> Column:
    return F.coalesce(file_name(not_blank(image_path)), process_name)
