"""Event shapes of extracted artifact tables: one select per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import browser, keys, times, transfers
from ..functions.bags import merge_fields
from ..functions.paths import file_name, is_rooted, normalize_sha1
from ..functions.text import not_blank
from ..operators.enrich import resolve_ids, srum_id_map, visits_of_urls
from ..operators.ranking import top_n_per_key
from ..operators.windows import VISITS_PER_DATABASE, cap_per_group
from ..operators.wmi import subscriptions
from ..schema import evidence_ref, string_map, to_events

MIN_CHROMIUM_MICROS = times.CHROMIUM_UNIX_EPOCH_MICROS + 946_684_800_000_000  # 2000-01-01

# Usage-monitor provider tables and their names.
USAGE_PROVIDERS = {
    "{973F5D5C-1D90-4944-BE8E-24B94231A174}": "Network Data Usage",
    "{DD6636C4-8929-4683-974E-22C046A43763}": "Network Connectivity Usage",
    "{D10CA2FE-6FCF-4F6D-848E-B2E99266FA89}": "Application Resource Usage",
    "{D10CA2FE-6FCF-4F6D-848E-B2E99266FA86}": "Energy Usage",
    "{FEE4E14F-02A9-4550-B5CE-5FA2DA202E37}": "Energy Usage (Long-Term)",
    "{5C8CF1C7-7257-4F13-B223-970EF5939312}": "Application Timeline",
    "{7ACBBAA3-D029-4BE4-9A7A-0885927F1D8F}": "vfu",
    "{B6D82AF1-F780-4E17-8077-6CB9AD8A6FC4}": "SDP Volume Provider",
    "{DA73FB89-2BEA-4DDC-86B8-6E048C6DA477}": "SDP CPU Provider",
}
NETWORK_PROVIDERS = ["Network Data Usage", "Network Connectivity Usage"]
NETWORK_USAGE = "Network Data Usage"


def _words(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def chromium_events(urls: DataFrame, visits: DataFrame, cap: int = 0) -> DataFrame:
    """Visits of Chromium databases, newest ``cap`` per database (0 keeps all).

    ``urls``: ``host, database, id, url, title, visit_count, typed_count``;
    ``visits``: ``host, database, url, visit_time, transition``.
    """
    renamed = urls.withColumnRenamed("url", "page_url").withColumnRenamed("id", "url_id")
    joined = visits_of_urls(renamed, visits, "url_id", "url")
    rows = _newest_visits(joined, "visit_time", cap)
    rows = rows.where(F.col("page_url").isNotNull() & (F.col("visit_time") >= MIN_CHROMIUM_MICROS))
    context = browser.chromium_context(F.col("database"))
    extra = {"TypedCount": F.coalesce(F.col("typed_count"), F.lit(0))}
    return _visit_events(
        rows,
        times.chromium_time(F.col("visit_time")),
        browser.chromium_visit_type(F.col("transition")),
        context,
        extra,
    ).where(F.col("ts").isNotNull())


def firefox_events(places: DataFrame, visits: DataFrame, cap: int = 0) -> DataFrame:
    """Visits of Firefox databases.

    ``places``: ``host, database, id, url, title, visit_count``;
    ``visits``: ``host, database, place_id, visit_date, visit_type``.
    """
    renamed = places.withColumnRenamed("url", "page_url").withColumnRenamed("id", "url_id")
    joined = visits_of_urls(renamed, visits, "url_id", "place_id")
    rows = _newest_visits(joined, "visit_date", cap).where(F.col("visit_date") > 0)
    rows = rows.withColumn("page_url", F.coalesce("page_url", F.lit("")))
    return _visit_events(
        rows,
        times.firefox_time(F.col("visit_date")),
        browser.firefox_visit_type(F.col("visit_type")),
        browser.firefox_context(F.col("database")),
        {},
    )


def _newest_visits(rows: DataFrame, time: str, cap: int) -> DataFrame:
    if cap <= 0:
        return rows
    return top_n_per_key(rows, ["host", "database"], [(time, True), ("url_id", False)], cap, rank="_r").drop("_r")


def _visit_events(rows: DataFrame, ts: Column, visit_type: Column, context: Column, extra: dict) -> DataFrame:
    title = F.coalesce(F.col("title"), F.lit(""))
    record = F.col("url_id").cast("string")
    fields = {
        "Url": F.col("page_url"),
        "Title": title,
        "VisitCount": F.coalesce(F.col("visit_count"), F.lit(0)),
        "VisitType": visit_type,
        "HistoryDatabase": F.col("database"),
        "RecordId": record,
        "WebBrowser": context["browser"],
        "UserProfile": context["user_profile"],
        "BrowserProfile": context["browser_profile"],
        **extra,
    }
    return to_events(
        rows,
        ts=ts,
        category=F.lit("Browser"),
        action=F.lit("Visit"),
        object_url=F.col("page_url"),
        summary=_words("Browser visit: ", title),
        fields=string_map(fields),
        evidence=F.array(
            evidence_ref("BrowserHistory", _words(F.col("database"), ":", record), collected_at=ts)
        ),
        confidence=F.lit("High"),
    )


def prefetch_events(rows: DataFrame) -> DataFrame:
    """Run artifacts: ``executable, process_path, pf_name, pf_path, hash, run_times, run_count, file_size, created, modified``."""
    runs = distinct_run_times(F.col("run_times"))
    latest = F.get(runs, F.lit(0))
    return to_events(
        rows,
        ts=F.coalesce(latest, F.col("modified")),
        category=F.lit("File"),
        action=F.lit("Execute"),
        object_file=keys.file_key(path=F.col("pf_path"), hash_=F.col("hash")),
        summary=_words("Prefetch execution: ", F.col("executable")),
        fields=string_map(
            {
                "ExecutableName": F.col("executable"),
                "ProcessPath": F.col("process_path"),
                "PrefetchFileName": F.col("pf_name"),
                "PrefetchFilePath": F.col("pf_path"),
                "RunCount": run_count(F.col("run_count"), runs),
                "LastRunTime": F.coalesce(times.format_iso(latest), F.lit("")),
                "RunTimes": F.array_join(F.transform(runs, times.format_iso), ";"),
                "FileSize": F.col("file_size"),
                "FileCreated": times.format_iso(F.col("created")),
                "FileModified": times.format_iso(F.col("modified")),
            }
        ),
        evidence=F.array(evidence_ref("Prefetch", F.col("pf_path"), F.col("hash"), latest)),
        confidence=F.lit("High"),
    )


def distinct_run_times(run_times: Column, before: Column | None = None) -> Column:
    """Distinct run times, newest first; times more than a year ahead are noise."""
    limit = F.current_timestamp() + F.expr("INTERVAL 1 YEAR") if before is None else before
    kept = F.filter(run_times, lambda t: t.isNotNull() & (t < limit))
    return F.sort_array(F.array_distinct(kept), asc=False)


def run_count(stored: Column, run_times: Column) -> Column:
    """Stored count when positive, else the number of run times."""
    return F.when(stored > 0, stored).otherwise(F.size(run_times)).cast("bigint")


def referenced_files(rows: DataFrame) -> DataFrame:
    """One row per file that a run artifact references."""
    return rows.select("host", "pf_path", F.posexplode("referenced_files").alias("ordinal", "full_path")).select(
        "host", "pf_path", "ordinal", file_name(F.col("full_path")).alias("file_name"), "full_path"
    )


def amcache_rows(rows: DataFrame) -> DataFrame:
    """Inventory entries with real SHA-1 values."""
    return rows.withColumn("sha1", normalize_sha1(F.col("sha1")))


def shimcache_rows(rows: DataFrame) -> DataFrame:
    """Extracted compatibility-cache rows with one comparable time."""
    return rows.withColumn("ts", F.coalesce("last_modified", "last_update", "last_write"))


_LINK_FIELDS = {
    "LinkLocalBasePath": "local_base_path",
    "LinkCommonPathSuffix": "common_path_suffix",
    "LinkNetworkPath": "network_path",
    "LinkRelativePath": "relative_path",
    "LinkNameString": "name_string",
    "LinkWorkingDirectory": "working_directory",
    "LinkArguments": "arguments",
}
_LINK_TIMES = {
    "LinkCreationTimeUtc": "link_creation",
    "LinkAccessTimeUtc": "link_access",
    "LinkWriteTimeUtc": "link_write",
}


def _link_fields() -> dict[str, Column]:
    texts = {k: F.coalesce(F.col(c), F.lit("")) for k, c in _LINK_FIELDS.items()}
    stamps = {k: F.coalesce(times.format_iso(F.col(c)), F.lit("")) for k, c in _LINK_TIMES.items()}
    return {**texts, **stamps}


def recent_link_events(rows: DataFrame) -> DataFrame:
    """Recent-folder shortcuts; a path recovered by raw search lowers confidence."""
    confidence = F.when(F.col("raw_fallback"), F.lit("Low")).otherwise(F.lit("Medium"))
    leaf = file_name(F.col("target_path"))
    return to_events(
        rows,
        ts=F.col("access_time"),
        category=F.lit("File"),
        action=F.lit("Open"),
        object_file=keys.file_key(path=F.col("target_path")),
        summary=_words("Recent file access: ", leaf),
        fields=string_map(
            {
                "LnkFilePath": F.col("lnk_path"),
                "TargetPath": F.col("target_path"),
                "TargetFileName": leaf,
                "EvidenceSource": F.lit("RecentFolderLnk"),
                "RawFallbackUsed": F.initcap(F.col("raw_fallback").cast("string")),
                "PathConfidence": confidence,
                "CreationTime": times.format_iso(F.col("creation_time")),
                "AccessTime": times.format_iso(F.col("access_time")),
                "WriteTime": times.format_iso(F.col("write_time")),
                "FileSize": F.col("file_size"),
                **_link_fields(),
            }
        ),
        evidence=F.array(
            evidence_ref("RecentLnk", F.col("lnk_path"), F.col("hash"), F.col("access_time"))
        ),
        confidence=confidence,
    )


def jump_list_events(rows: DataFrame) -> DataFrame:
    """Jump-list items already joined to their list entries (null where there is none)."""
    leaf = file_name(F.col("target_path"))
    kept = rows.where(not_blank(F.col("target_path")).isNotNull())
    return to_events(
        kept,
        ts=F.coalesce("last_access", "link_access", "access_time"),
        category=F.lit("File"),
        action=F.lit("Open"),
        summary=_words("Jump List item: ", leaf, " (", F.col("app_id"), ")"),
        fields=string_map(
            {
                "JumpListType": F.col("list_type"),
                "AppId": F.col("app_id"),
                "FilePath": F.col("file_path"),
                "StreamName": F.col("stream_name"),
                "TargetPath": F.col("target_path"),
                "TargetFileName": leaf,
                "AccessTime": times.format_iso(F.col("access_time")),
                "ModificationTime": times.format_iso(F.col("modification_time")),
                **_link_fields(),
                "JumpListMruOrder": F.col("mru_order"),
                "JumpListAccessCount": F.col("access_count"),
                "JumpListPinStatus": F.col("pin_status"),
                "JumpListLastAccessUtc": times.format_iso(F.col("last_access")),
                "DestListPathHint": not_blank(F.col("path_hint")),
            }
        ),
        evidence=F.array(evidence_ref("JumpList", F.col("file_path"), collected_at=F.col("access_time"))),
        confidence=F.lit("Medium"),
    )


def startup_events(rows: DataFrame) -> DataFrame:
    """Startup-folder entries: ``user_name, entry_path, startup_folder, modified, target_path, arguments, working_directory``."""
    name = file_name(F.col("entry_path"))
    target = F.when(F.lower(name).endswith(".lnk"), not_blank(F.col("target_path")))
    effective = F.coalesce(target, F.col("entry_path"))
    with_target = lambda c: F.when(target.isNotNull(), not_blank(F.col(c)))
    kept = rows.where(F.lower(name) != "desktop.ini")
    arrow = F.when(target.isNotNull(), _words(" → ", target))
    return to_events(
        kept,
        ts=F.col("modified"),
        category=F.lit("Persistence"),
        action=F.lit("StartupFolder"),
        object_file=F.when(is_rooted(effective), keys.file_key(path=effective)),
        summary=_words("Startup (", F.col("user_name"), "): ", name, arrow),
        fields=string_map(
            {
                "User": F.col("user_name"),
                "EntryName": name,
                "EntryPath": F.col("entry_path"),
                "StartupFolder": F.col("startup_folder"),
                "TargetPath": target,
                "Arguments": with_target("arguments"),
                "WorkingDirectory": with_target("working_directory"),
            }
        ),
        evidence=F.array(evidence_ref("StartupFolder", F.col("entry_path"))),
        confidence=F.lit("High"),
    )


def usage_rows(tables: dict[str, DataFrame], cap: int = 0) -> DataFrame:
    """Known provider tables as one frame with ``provider_guid, provider``; first ``cap`` rows per host and table.

    Columns other than the row keys differ per table and come back as nulls elsewhere.
    """
    known = {guid.upper(): name for guid, name in USAGE_PROVIDERS.items()}
    frames = [
        df.withColumns({"provider_guid": F.lit(guid), "provider": F.lit(known[guid.upper()])})
        for guid, df in tables.items()
        if guid.upper() in known
    ]
    if not frames:
        raise ValueError("no known provider table given")
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return cap_per_group(merged, ["host", "provider"], cap, [("auto_inc_id", False)])


def usage_events(rows: DataFrame, ids: DataFrame, values: list[str]) -> DataFrame:
    """Usage-monitor rows as events: ids resolved, ``values`` kept as fields.

    Network providers are category Network, the others System.
    """
    resolved = resolve_ids(rows, srum_id_map(ids)).where(F.col("ts").isNotNull())
    app = F.coalesce(not_blank(F.col("app")), F.lit("(unknown app)"))
    summary = _words("SRUM ", F.col("provider"), ": ", app)
    if {"BytesSent", "BytesRecvd"} <= set(values):
        counters = F.col("BytesSent").isNotNull() & F.col("BytesRecvd").isNotNull()
        summary = F.when(
            (F.col("provider") == NETWORK_USAGE) & counters,
            _words(
                f"SRUM {NETWORK_USAGE}: ", app, " sent=", F.col("BytesSent").cast("string"),
                " recvd=", F.col("BytesRecvd").cast("string"),
            ),
        ).otherwise(summary)
    return to_events(
        resolved,
        ts=F.col("ts"),
        category=F.when(F.col("provider").isin(NETWORK_PROVIDERS), F.lit("Network")).otherwise(F.lit("System")),
        action=F.lit("Query"),
        summary=summary,
        fields=string_map(
            {
                "Mode": "Offline",
                "Parser": "SRUM",
                "Provider": F.col("provider"),
                "ProviderGuid": F.col("provider_guid"),
                "App": not_blank(F.col("app")),
                "UserSid": not_blank(F.col("user_sid")),
                **{v: F.col(v) for v in values},
            }
        ),
        evidence=F.array(evidence_ref("SrumDb", F.col("database"))),
    )


def transfer_events(rows: DataFrame) -> DataFrame:
    """Background-transfer records: ``host, database, kind, record_id, blob, anchor``."""
    located = rows.withColumn("_s", transfers.classify_strings(transfers.utf16_strings(F.col("blob"))))
    s = F.col("_s")
    first = lambda part: F.get(s[part], F.lit(0))
    joined = lambda part: F.when(F.size(s[part]) > 0, F.array_join(s[part], " | "))
    url, path, name = first("urls"), first("local_paths"), first("names")
    is_file = F.col("kind") == "File"
    summary = (
        F.when(is_file & url.isNotNull() & path.isNotNull(), _words("BITS download: ", url, " → ", path))
        .when(is_file & url.isNotNull(), _words("BITS download: ", url))
        .when(is_file & path.isNotNull(), _words("BITS file: ", path))
        .when(is_file, _words("BITS file record ", F.col("record_id")))
        .when(name.isNotNull(), _words("BITS job: ", name))
        .otherwise(_words("BITS job ", F.col("record_id")))
    )
    return to_events(
        located,
        ts=F.col("anchor"),
        category=F.when(is_file, F.lit("Network")).otherwise(F.lit("System")),
        action=F.lit("Query"),
        summary=summary,
        fields=string_map(
            {
                "Mode": "Offline",
                "Parser": "BITS",
                "RecordKind": F.col("kind"),
                "RecordId": F.col("record_id"),
                "Urls": joined("urls"),
                "LocalPaths": joined("local_paths"),
                "OwnerSid": joined("owner_sids"),
                "Strings": joined("names"),
            }
        ),
        evidence=F.array(evidence_ref("BitsDb", F.col("database"))),
    )


def subscription_events(runs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Management subscriptions as events; ``anchors`` gives ``host, file, anchor`` times."""
    # One anchor a file: the hint keeps a list of very many files from being broadcast.
    found = subscriptions(runs).join(anchors.hint("merge"), ["host", "file"], "left")
    summary = (
        F.when(
            F.col("kind") == "Binding",
            _words(
                "WMI binding: consumer '", F.col("consumer_name"), "' (", F.col("consumer_class"),
                ") ← filter '", F.col("filter_name"), "'",
            ),
        )
        .when(F.col("kind") == "Filter", _words("WMI filter '", F.col("name"), "': ", F.col("query")))
        .otherwise(_words("WMI consumer '", F.col("consumer_name"), "' (", F.col("consumer_class"), ")"))
    )
    columns = {
        "Name": "name",
        "ConsumerClass": "consumer_class",
        "ConsumerName": "consumer_name",
        "FilterName": "filter_name",
        "Namespace": "namespace",
        "Query": "query",
        "QueryLanguage": "query_language",
    }
    return to_events(
        found,
        ts=F.col("anchor"),
        category=F.lit("Persistence"),
        action=F.lit("WmiSubscription"),
        summary=summary,
        fields=string_map(
            {
                "Mode": "Offline",
                "Parser": "WMI",
                "WmiKind": F.col("kind"),
                **{k: F.when(F.length(F.col(c)) > 0, F.col(c)) for k, c in columns.items()},
            }
        ),
        evidence=F.array(evidence_ref("WmiRepository", F.col("file"))),
    )


def service_events(rows: DataFrame) -> DataFrame:
    """Installed services: ``name, display_name, path_name, state, start_mode, service_type, start_name, ts``."""
    kept = rows.where(not_blank(F.col("name")).isNotNull())
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return to_events(
        kept,
        ts=F.col("ts"),
        category=F.lit("Service"),
        action=F.lit("Query"),
        summary=_words(
            "Service: ", text("name"), " (", text("display_name"), ") — ", text("state"), "/", text("start_mode")
        ),
        fields=string_map(
            {
                "ServiceName": text("name"),
                "DisplayName": text("display_name"),
                "ImagePath": text("path_name"),
                "State": text("state"),
                "StartMode": text("start_mode"),
                "ServiceType": text("service_type"),
                "StartName": text("start_name"),
                "Source": "WMI Win32_Service",
            }
        ),
        evidence=F.array(
            evidence_ref("LiveService", _words("Win32_Service:", F.col("name")), collected_at=F.col("ts"))
        ),
        confidence=F.lit("High"),
    )


def process_events(transitions: DataFrame) -> DataFrame:
    """Process Start and Stop rows as events.

    Needs ``action, pid, create_time, ts``; ``boot_id`` and ``fields`` are used
    where present.
    """
    boot = F.col("boot_id") if "boot_id" in transitions.columns else F.lit(0)
    extra = F.col("fields") if "fields" in transitions.columns else F.create_map().cast("map<string,string>")
    pid = F.col("pid").cast("string")
    started = F.col("action") == "Start"
    verb = F.when(started, F.lit("Process started: ")).otherwise(F.lit("Process stopped: "))
    return to_events(
        transitions,
        ts=F.when(started, F.col("create_time")).otherwise(F.col("ts")),
        category=F.lit("Process"),
        action=F.col("action"),
        subject_process=keys.process_key(boot, F.col("pid"), F.col("create_time")),
        summary=_words(verb, "PID ", pid),
        fields=merge_fields(extra, {"ProcessId": pid}),
        evidence=F.array(evidence_ref("LiveProcessProvider", _words("PID:", pid), collected_at=F.col("ts"))),
        confidence=F.lit("High"),
    )


def connection_events(transitions: DataFrame) -> DataFrame:
    """Connection transitions as events."""
    flow = keys.flow_key(
        F.col("protocol"), F.col("local_ep"), F.col("remote_ep"), F.col("pid"), F.col("time_bucket"), bucketed=True
    )
    arrow = _words(F.col("local_ep"), " -> ", F.col("remote_ep"))
    return to_events(
        transitions,
        ts=F.col("ts"),
        category=F.lit("Network"),
        action=F.col("action"),
        object_flow=flow,
        summary=_words("Network ", F.lower("action"), ": ", F.col("protocol"), " ", arrow),
        fields=string_map(
            {
                "Protocol": F.col("protocol"),
                "LocalEndpoint": F.col("local_ep"),
                "RemoteEndpoint": F.col("remote_ep"),
                "ProcessId": F.coalesce(F.col("pid"), F.lit(0)),
                "State": F.col("state"),
            }
        ),
        evidence=F.array(
            evidence_ref(
                "NetConnectionProvider",
                _words(F.col("protocol"), ":", F.col("local_ep"), "->", F.col("remote_ep")),
                collected_at=F.col("ts"),
            )
        ),
        confidence=F.lit("High"),
    )
