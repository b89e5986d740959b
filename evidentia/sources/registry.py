"""Registry values from hive dumps, selected by the per-hive key list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, registry, times
from ..functions.bags import merge_fields
from ..functions.blobs import shell_items, shim_cache_entries
from ..operators.enrich import mru_ranks, with_mru_rank
from ..operators.filters import registry_search
from ..schema import evidence_ref, string_map, to_events

_CURRENT = r"Microsoft\Windows\CurrentVersion"
_NT = r"Microsoft\Windows NT\CurrentVersion"
_EXPLORER = r"Software\Microsoft\Windows\CurrentVersion\Explorer"
_SHELL = r"Local Settings\Software\Microsoft\Windows\Shell"
_CONTROL_SETS = ["ControlSet001", "ControlSet002"]

# Fixed values: (hive, query, key path, with sub-keys).
HIVE_QUERIES = (
    [
        ("SYSTEM", name, rf"{control_set}\{path}", deep)
        for name, path, deep in [
            ("Services", r"Services", True),
            ("AppCompatCache", r"Control\Session Manager\AppCompatCache", False),
            ("TimeZoneInformation", r"Control\TimeZoneInformation", False),
            ("ComputerName", r"Control\ComputerName\ComputerName", False),
            ("Windows", r"Control\Windows", False),
            ("WmiNamespaceSecurity", r"Control\WMI\Security", True),
        ]
        for control_set in _CONTROL_SETS
    ]
    + [
        ("SYSTEM", "MountedDevices", "MountedDevices", False),
        ("SYSTEM", "Select", "Select", False),
        ("SOFTWARE", "Run", rf"{_CURRENT}\Run", False),
        ("SOFTWARE", "RunOnce", rf"{_CURRENT}\RunOnce", False),
        ("SOFTWARE", "RunServices", rf"{_CURRENT}\RunServices", False),
        ("SOFTWARE", "RunServicesOnce", rf"{_CURRENT}\RunServicesOnce", False),
        ("SOFTWARE", "PoliciesRun", rf"{_CURRENT}\Policies\Explorer\Run", False),
        ("SOFTWARE", "StartupApprovedRun", rf"{_CURRENT}\Explorer\StartupApproved\Run", False),
        ("SOFTWARE", "Winlogon", rf"{_NT}\Winlogon", False),
        ("SOFTWARE", "IFEO", rf"{_NT}\Image File Execution Options", True),
        ("SOFTWARE", "Uninstall", rf"{_CURRENT}\Uninstall", True),
        ("SOFTWARE", "AppCompatLayers", rf"{_NT}\AppCompatFlags\Layers", False),
        ("SOFTWARE", "ProfileList", rf"{_NT}\ProfileList", True),
        ("SOFTWARE", "InternetSettingsConnections", rf"{_CURRENT}\Internet Settings\Connections", False),
        ("SOFTWARE", "BitsClient", rf"{_CURRENT}\BITS", True),
        ("SOFTWARE", "WmiCimom", r"Microsoft\WBEM\CIMOM", False),
        ("SOFTWARE", "SrumRegistry", rf"{_NT}\SRUM", True),
        ("SOFTWARE", "TaskCache", rf"{_NT}\Schedule\TaskCache\Tasks", True),
        ("NTUSER.DAT", "User Run", r"Software\Microsoft\Windows\CurrentVersion\Run", False),
        ("NTUSER.DAT", "User RunOnce", r"Software\Microsoft\Windows\CurrentVersion\RunOnce", False),
        ("NTUSER.DAT", "RunMRU", rf"{_EXPLORER}\RunMRU", False),
        ("NTUSER.DAT", "TypedURLs", r"Software\Microsoft\Internet Explorer\TypedURLs", False),
        ("NTUSER.DAT", "TypedPaths", rf"{_EXPLORER}\TypedPaths", False),
        ("NTUSER.DAT", "RecentDocs", rf"{_EXPLORER}\RecentDocs", True),
        ("NTUSER.DAT", "UserAssist", rf"{_EXPLORER}\UserAssist", True),
        ("NTUSER.DAT", "MountPoints2", rf"{_EXPLORER}\MountPoints2", True),
        ("NTUSER.DAT", "OpenSavePidlMRU", rf"{_EXPLORER}\ComDlg32\OpenSavePidlMRU", True),
        ("NTUSER.DAT", "OpenSaveMRU", rf"{_EXPLORER}\ComDlg32\OpenSaveMRU", True),
        ("NTUSER.DAT", "LastVisitedPidlMRU", rf"{_EXPLORER}\ComDlg32\LastVisitedPidlMRU", True),
        ("NTUSER.DAT", "Streams", rf"{_EXPLORER}\Streams", True),
        ("USRCLASS.DAT", "MuiCache", rf"{_SHELL}\MuiCache", False),
        ("USRCLASS.DAT", "BagMRU", rf"{_SHELL}\BagMRU", True),
        ("USRCLASS.DAT", "Bags", rf"{_SHELL}\Bags", True),
    ]
)


def hive_query_frame(spark: SparkSession, queries: list[tuple] | None = None) -> DataFrame:
    """The key list as a fixed-size table: hive and lower-case path."""
    return spark.createDataFrame(
        [(h, n, p.lower(), d) for h, n, p, d in (queries or HIVE_QUERIES)],
        "q_hive string, query_name string, q_path string, q_deep boolean",
    )


def select_values(values: DataFrame, queries: list[tuple] | None = None) -> DataFrame:
    """Values below the listed keys with their query name.

    Needs ``hive, key_path``. The rule table is fixed and broadcast; the hive is
    the equi key and the path prefix the residual condition.
    """
    rules = F.broadcast(hive_query_frame(values.sparkSession, queries))
    path = F.lower(values["key_path"])
    below = (path == F.col("q_path")) | (F.col("q_deep") & path.startswith(F.concat(F.col("q_path"), F.lit("\\"))))
    return values.join(rules, (F.upper(values["hive"]) == F.col("q_hive")) & below).drop("q_hive", "q_path", "q_deep")


def registry_events(values: DataFrame) -> DataFrame:
    """Registry events of selected values, plus one event per shim-cache entry.

    Needs ``host, collection_id, ingest_seq, hive, hive_path, query_name,
    key_path, value_name, value_type, value_raw, value_text, last_write`` and
    optionally ``from_snapshot, consistency_scope``. ``ValueData`` and the fields
    decoded from it hold the whole value; ``ValueDisplay`` is cut.
    """
    raw, name, path = F.col("value_raw"), F.col("value_name"), F.col("key_path")
    data = F.coalesce(registry.spaced_hex(raw), F.col("value_text"), F.lit(""))
    optional = {
        "OfflineHiveSource": ("from_snapshot", lambda c: F.when(c, F.lit("VSS")).otherwise(F.lit("Live"))),
        "ConsistencyScope": ("consistency_scope", lambda c: c),
    }
    base = {
        "HiveName": F.col("hive"),
        "HivePath": F.col("hive_path"),
        "KeyPath": path,
        "QueryName": F.col("query_name"),
        "Mode": F.lit("Offline"),
        "Parser": F.lit("Registry"),
        **{k: f(F.col(c)) for k, (c, f) in optional.items() if c in values.columns},
    }
    query = F.col("query_name")
    own = {"ValueName": name, "ValueData": F.col("_data"), "ValueDisplay": registry.hex_display(raw), "ValueType": F.col("value_type")}
    # Separate projections, so that no decoded column is copied into the next one.
    rows = values.withColumns(
        {"_data": data, "_base": string_map(base), **registry.run_artifact_columns(query, path, name, raw)}
    )
    rows = rows.withColumn("_found", registry.enrichment(query, path, name, F.col("_data"), raw))
    rows = rows.withColumn("_fields", F.map_concat("_base", string_map(own), "_found"))
    full_key = F.concat(F.col("hive"), F.lit("\\"), path)
    evidence = F.array(evidence_ref("RegistryHive", F.col("hive_path"), default_now=True))
    common = dict(
        category=F.lit("Registry"),
        action=F.lit("Query"),
        object_registry=keys.registry_key(full_key),
        evidence=evidence,
        confidence=F.lit("Medium"),
    )
    main = to_events(
        rows,
        ts=registry.primary_time(F.col("_fields"), F.col("last_write")),
        summary=registry.value_summary(F.col("_fields"), F.col("query_name"), path, name, F.col("_data")),
        fields=F.col("_fields"),
        **common,
    )
    return main.unionByName(shim_cache_events(rows, common))


def shim_cache_events(rows: DataFrame, common: dict) -> DataFrame:
    """One event per decoded compatibility-cache entry; the blob column is the only Python input."""
    blobs = rows.where(
        registry.is_shim_cache_value(F.col("query_name"), F.col("value_name")) & F.col("value_raw").isNotNull()
    )
    entries = blobs.withColumn("_e", F.explode(shim_cache_entries(F.col("value_raw"))))
    modified, updated = times.filetime(F.col("_e.modified_ticks")), times.filetime(F.col("_e.updated_ticks"))
    fields = merge_fields(
        F.col("_base"),
        {
            "ValueName": F.lit("AppCompatCache"),
            "ValueType": F.col("value_type"),
            "ValueData": F.col("_e.path"),
            "OfflineHiveDecoded": F.lit("ShimCache"),
            "ShimCache_FilePath": F.col("_e.path"),
            "ShimCache_ParseFormat": F.col("_e.format"),
            "ShimCache_ControlSet": registry.control_set_head(F.col("key_path")),
            "ShimCache_LastModifiedUtc": times.format_iso(modified),
            "ShimCache_LastUpdateUtc": times.format_iso(updated),
        },
    )
    return to_events(
        entries,
        ts=F.coalesce(modified, updated, F.col("last_write")),
        summary=F.concat(F.lit("ShimCache ("), F.col("_e.format"), F.lit("): "), F.col("_e.path")),
        fields=fields,
        **common,
    )


def registry_search_events(
    values: DataFrame,
    query_name: str,
    key: str,
    recursive: bool = True,
    name_pattern: str | None = None,
    data_pattern: str | None = None,
) -> DataFrame:
    """Ad-hoc registry search; recent-document keys are decoded and ranked.

    Needs ``host, collection_id, ingest_seq, key_path, value_name, value_type,
    value_raw, value_text, last_write``. The data pattern searches the whole
    value; only ``ValueDisplay`` is cut.
    """
    is_docs = F.lit(query_name == "RecentDocs") | F.contains(F.lower("key_path"), F.lit("\\recentdocs"))
    raw_hex = registry.spaced_hex(F.col("value_raw"))
    items = F.when(is_docs & F.col("value_raw").isNotNull(), shell_items(F.col("value_raw")))
    decoded = values.withColumns({"_items": items, "_raw_hex": raw_hex})
    parsed = F.when(F.length(F.trim(F.col("_items.parsed_path"))) > 0, F.col("_items.parsed_path"))
    shown = decoded.withColumn("value_data", F.coalesce(parsed, F.col("_raw_hex"), F.col("value_text")))
    found = registry_search(shown, key, recursive, name_pattern, data_pattern)
    ranks = mru_ranks(values.where(F.lower("value_name") == "mrulistex"))
    ranked = with_mru_rank(found, ranks)
    docs = F.when(is_docs, F.lit("RecentDocs"))
    suffix = F.regexp_extract(F.col("key_path"), r"(?i)\\RecentDocs\\(\.[^\\]+)$", 1)
    fields = {
        "ValueName": F.col("value_name"),
        "ValueData": F.col("value_data"),
        "ValueDisplay": registry.hex_display(F.col("value_raw")),
        "ValueType": F.col("value_type"),
        "QueryName": F.lit(query_name),
        "RawHex": F.col("_raw_hex"),
        "Parser": docs,
        "RecentDocsExtension": F.when(is_docs & (suffix != ""), suffix),
        "MruOrder": F.when(is_docs, F.col("mru_order")),
        "ParsedPath": F.col("_items.parsed_path"),
        "FileName": F.col("_items.file_name"),
        "ShellItemCount": F.col("_items.item_count"),
        "ShellItemTypes": F.col("_items.item_types"),
    }
    return to_events(
        ranked,
        ts=F.col("last_write"),
        category=F.lit("Registry"),
        action=F.lit("Query"),
        object_registry=keys.registry_key(F.col("key_path")),
        summary=F.concat(F.lit(f"{query_name}: "), F.col("key_path"), F.lit("\\"), F.col("value_name")),
        fields=string_map(fields),
        evidence=F.array(evidence_ref("Registry", F.col("key_path"), default_now=True)),
    )
