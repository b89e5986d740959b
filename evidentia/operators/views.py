"""Investigator views: timeline, event log, autoruns, recent files, browsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bags import field, has_field, parse_int
from ..functions.paths import extension, file_name
from ..functions.text import icontains, not_blank
from . import filters

# Registry queries whose values start programs.
AUTORUN_QUERIES = [
    "Run",
    "RunOnce",
    "RunServices",
    "RunServicesOnce",
    "PoliciesRun",
    "StartupApprovedRun",
    "User Run",
    "User RunOnce",
    "Winlogon",
    "IFEO",
]


def newest_first(rows: DataFrame, ts: str = "ts", seq: str = "ingest_seq") -> DataFrame:
    return rows.orderBy(F.col(ts).desc(), F.col(seq))


def timeline(
    events: DataFrame,
    start=None,
    end=None,
    process_key: str | None = None,
    text: str = "",
    category: str = "",
    action: str = "",
    process: str = "",
    path: str = "",
) -> DataFrame:
    """All timeline filters as one predicate chain, newest first."""
    rows = filters.time_range(events, start, end)
    if process_key:
        rows = filters.by_process(rows, process_key)
    rows = filters.full_text(rows, text)
    rows = filters.category_like(rows, category)
    rows = filters.action_like(rows, action)
    rows = filters.process_like(rows, process)
    rows = filters.path_like(rows, path)
    return newest_first(rows)


def _bag(name: str) -> Column:
    return field(F.col("fields"), name)


def event_log_view(events: DataFrame, start=None, end=None, log: str = "All", text: str = "") -> DataFrame:
    rows = filters.time_range(events, start, end).where(has_field(F.col("fields"), "LogName"))
    if log.lower() != "all":
        rows = rows.where(F.lower(_bag("LogName")) == log.lower())
    if text.strip():
        rows = rows.where(
            filters.matches_text(text, [F.col("summary"), _bag("Source"), _bag("Level"), _bag("EventId")])
        )
    return newest_first(rows)


def autorun_view(events: DataFrame, location: str = "All", text: str = "") -> DataFrame:
    query = F.lower(_bag("QueryName"))
    rows = filters.by_category(events, "Registry").where(query.isin([q.lower() for q in AUTORUN_QUERIES]))
    if location.lower() != "all":
        rows = rows.where(query == location.lower())
    if text.strip():
        columns = [F.col("summary")] + [_bag(n) for n in ("ValueName", "ValueData", "KeyPath", "HiveName")]
        rows = rows.where(filters.matches_text(text, columns))
    hive, key = F.coalesce(_bag("HiveName"), F.lit("")), F.coalesce(_bag("KeyPath"), F.lit(""))
    return rows.select(
        "host",
        "collection_id",
        "ingest_seq",
        _bag("QueryName").alias("location"),
        F.coalesce(_bag("ValueName"), F.lit("")).alias("entry"),
        F.coalesce(_bag("ValueData"), F.lit("")).alias("command"),
        F.col("ts").alias("last_write_time"),
        hive.alias("hive"),
        key.alias("key_path"),
        F.coalesce(_bag("ValueType"), F.lit("")).alias("value_type"),
        F.when(hive == "", key).otherwise(F.concat(hive, F.lit("\\"), key)).alias("full_key_path"),
    ).orderBy("location", "entry", F.col("last_write_time").desc())


def recent_files_view(events: DataFrame, start=None, end=None, text: str = "") -> DataFrame:
    """Recent documents, shortcuts and jump-list items in one shape."""
    bag = F.col("fields")

    def value(name: str) -> Column:
        return F.coalesce(_bag(name), F.lit(""))

    is_docs = F.coalesce(_bag("Parser") == "RecentDocs", F.lit(False))
    is_link = ~is_docs & (has_field(bag, "LnkFilePath") | has_field(bag, "TargetPath"))
    is_jump = ~is_docs & ~is_link & (has_field(bag, "JumpListType") | has_field(bag, "AppId"))

    docs_path = F.coalesce(*[not_blank(_bag(n)) for n in ("ParsedPath", "ValueData", "RawHex")], F.lit(""))
    jump_path = F.coalesce(
        *[not_blank(_bag(n)) for n in ("TargetPath", "DestListPathHint", "LinkRelativePath", "LinkNameString")]
    )
    docs_name = F.coalesce(not_blank(_bag("FileName")), file_name(docs_path))
    path = F.when(is_docs, docs_path).when(is_link, value("TargetPath")).when(is_jump, jump_path)
    name = F.when(is_docs, docs_name).when(is_link, value("TargetFileName")).otherwise(file_name(jump_path))
    suffix = F.when(
        is_docs, F.coalesce(not_blank(_bag("RecentDocsExtension")), extension(docs_name))
    ).otherwise(extension(path))
    source = (
        F.when(is_docs, F.lit("RecentDocs MRU"))
        .when(is_link, F.lit("Recent LNK"))
        .otherwise(F.concat_ws(" ", F.lit("JumpList"), not_blank(_bag("JumpListType"))))
    )
    details = F.when(is_docs, value("ValueName")).when(is_link, value("LnkFilePath")).otherwise(value("AppId"))
    rows = filters.time_range(events, start, end).where(is_docs | is_link | is_jump)
    if text.strip():
        in_bag = F.exists(F.map_values("fields"), lambda v: icontains(v, text))
        rows = rows.where(icontains(F.col("summary"), text) | F.coalesce(in_bag, F.lit(False)))
    items = rows.select(
        "host",
        "collection_id",
        "ingest_seq",
        "ts",
        source.alias("source"),
        name.alias("file_name"),
        path.alias("path"),
        suffix.alias("extension"),
        details.alias("details"),
        F.when(is_docs, parse_int(_bag("MruOrder"))).alias("mru_order"),
    ).where(F.col("path").isNotNull())
    return newest_first(items)


def browser_view(events: DataFrame, start=None, end=None, text: str = "") -> DataFrame:
    rows = filters.time_range(events, start, end).where(F.col("category") == "Browser")
    if text.strip():
        rows = rows.where(
            filters.matches_text(text, [F.col("summary"), F.col("object_url"), _bag("Url"), _bag("Title")])
        )
    return newest_first(rows)


def static_process_view(
    processes: DataFrame, details: DataFrame, own_path: str = "own_path", keys: tuple[str, ...] = ("host", "pid")
) -> DataFrame:
    """Running processes with command line and path from the detail table, by name.

    ``details`` holds one row per key; the process's own path fills a missing one.
    """
    joined = processes.join(details, list(keys), "left")
    return joined.select(
        *keys,
        F.concat(F.col("process_name"), F.lit(".exe")).alias("process_name"),
        F.coalesce(not_blank(F.col("description")), F.col("process_name")).alias("name"),
        F.when(F.col("has_window"), F.lit("Application")).otherwise(F.lit("Background Process")).alias("type"),
        F.coalesce(F.col("command_line"), F.lit("")).alias("command_line"),
        F.coalesce(not_blank(F.col("executable_path")), F.col(own_path), F.lit("")).alias("path"),
        F.coalesce(F.col("publisher"), F.lit("")).alias("publisher"),
    ).orderBy("name")
