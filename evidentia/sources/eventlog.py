"""Event-log records exported as XML text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bags, eventmap, keys, times
from ..functions.endpoints import build_endpoints
from ..functions.paths import log_name_from_path
from ..operators.asof import EVENT_LOG_TTL, TRACE_TTL, resolve_process_keys
from ..operators.windows import first_properties
from ..schema import evidence_ref, string_map, to_events
from ..session import staging_path

RECORD_XML = (
    "System struct<Provider:struct<_Name:string>,EventID:string,Level:string,"
    "TimeCreated:struct<_SystemTime:string>,EventRecordID:string,Channel:string,Computer:string,"
    "Execution:struct<_ProcessID:string>>,"
    "EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>"
)


def parse_record(xml: Column) -> Column:
    """Record struct; malformed text gives nulls, never a failed job."""
    return F.from_xml(xml, RECORD_XML)


_DATA = "array<struct<_Name:string,_VALUE:string>>"


def _with_fields(rows: DataFrame, data: Column, base: dict[str, Column], numbered: Column | None = None) -> DataFrame:
    """Add ``_fields``: the base members and ``numbered`` values overlaid by the record's data.

    Unnamed data become ``EventData_n``; of a repeated name the last value
    counts. The steps are separate projections so that none is copied into
    the next.
    """
    named = F.transform(
        F.coalesce(data, F.array().cast(_DATA)),
        lambda d, i: F.struct(
            F.coalesce(F.nullif(F.trim(d["_Name"]), F.lit("")), F.concat(F.lit("EventData_"), i.cast("string"))).alias("key"),
            F.coalesce(d["_VALUE"], F.lit("")).alias("value"),
        ),
    )
    last = F.filter(
        "_named",
        lambda e, i: ~F.exists(F.slice("_named", i + 2, F.size("_named")), lambda later: later["key"] == e["key"]),
    )
    members = string_map(base)
    if numbered is not None:
        listed = F.transform(numbered, lambda v, i: F.struct(F.concat(F.lit("Property_"), i.cast("string")).alias("key"), v.alias("value")))
        members = F.map_concat(members, F.map_from_entries(listed))
    return (
        rows.withColumn("_named", named)
        .withColumns({"_data": F.map_from_entries(last), "_base": members})
        .withColumn(
            "_fields",
            F.map_concat(F.map_filter("_base", lambda k, _: ~F.map_contains_key("_data", k)), F.col("_data")),
        )
        .drop("_named", "_data", "_base")
    )


def _pid(fields: Column, *groups: list[str]) -> Column:
    """First group whose first present field parses as a pid."""
    return F.coalesce(*[bags.parse_pid(F.coalesce(*[bags.field(fields, n) for n in names])) for names in groups])


def read_event_log(
    records: DataFrame,
    boot_id: Column | None = None,
    offline_path: str | None = None,
    ttl_minutes: tuple[int, int, int] = EVENT_LOG_TTL,
    long_lived: tuple[str, ...] = (),
    max_properties: int | None = None,
) -> DataFrame:
    """Events from ``host, collection_id, ingest_seq, xml`` rows.

    Every data item is also a field ``Property_n``; ``max_properties`` bounds
    these fields, but not the search for the user's SID.

    ``offline_path`` names the column with the exported log file; it sets the
    log name, the evidence and the offline marks. Process keys are resolved
    over the whole table by :func:`resolve_process_keys`.
    """
    # Exploded out of an array of one: the planner copies no parse through that into the filter, nor below an exchange.
    parsed = records.withColumn("_r", F.explode(F.array(parse_record(F.col("xml")))))
    system, data = F.col("_r.System"), F.col("_r.EventData.Data")
    log = log_name_from_path(F.col(offline_path)) if offline_path else F.coalesce(system["Channel"], F.lit(""))
    values = F.transform(F.coalesce(data, F.array().cast(_DATA)), lambda d: F.coalesce(d["_VALUE"], F.lit("")))
    header = parsed.select(
        *records.columns,
        data.alias("_items"),
        log.alias("_log"),
        F.coalesce(system["Level"], F.lit("Unknown")).alias("_level"),
        F.coalesce(system["Provider"]["_Name"], F.lit("Unknown")).alias("_source"),
        F.coalesce(system["EventRecordID"], F.lit("0")).alias("_record"),
        F.coalesce(system["Computer"], F.col("host")).alias("_computer"),
        system["Execution"]["_ProcessID"].alias("_execution"),
        values.alias("_properties"),
        times.parse_iso(system["TimeCreated"]["_SystemTime"]).alias("ts"),
        times.iso_ticks(system["TimeCreated"]["_SystemTime"]).alias("_ticks"),
        system["EventID"].try_cast("bigint").alias("_id"),
    ).where(F.col("ts").isNotNull())
    base = {
        "EventId": F.col("_id"),
        "Level": F.col("_level"),
        "Source": F.col("_source"),
        "LogName": F.col("_log"),
        "RecordId": F.col("_record"),
        "MachineName": F.col("_computer"),
        "ExecutionProcessId": bags.parse_pid(F.col("_execution")),
    }
    if offline_path:
        base.update({"Mode": F.lit("Offline"), "OfflineSource": F.col(offline_path)})
    numbered = F.col("_properties") if max_properties is None else first_properties(F.col("_properties"), max_properties)
    rows = _with_fields(header, F.col("_items"), base, numbered)
    mapped = eventmap.map_event_id(F.col("_log"), F.col("_id"))
    fields = F.col("_fields")
    prepared = rows.select(
        "*",
        mapped["category"].alias("_category"),
        mapped["action"].alias("_action"),
        _pid(fields, ["NewProcessId"], ["ProcessId", "ProcessID"], ["ExecutionProcessId"]).alias("pid"),
        times.create_time_field(fields, times.EVENT_LOG_CREATE_FIELDS).alias("create_hint"),
        _is_long_lived(fields, ("ProcessName", "ImageName"), long_lived).alias("is_long_lived"),
    ).withColumn("is_stop", (F.col("_category") == "Process") & (F.col("_action") == "Stop"))
    resolved = _resolve(prepared, ttl_minutes, bool(long_lived))
    reference = F.col(offline_path) if offline_path else F.concat(
        F.col("_log"), F.lit(":"), bags.field(fields, "RecordId")
    )
    return to_events(
        resolved,
        ts=F.col("ts"),
        ts_ticks=F.col("_ticks"),
        category=F.col("_category"),
        action=F.col("_action"),
        subject_process=keys.process_key(
            F.lit(0) if boot_id is None else boot_id, F.col("pid"), F.col("process_create_time")
        ),
        subject_user=keys.user_key(eventmap.subject_sid(F.col("_properties"), fields)),
        summary=F.concat(
            F.col("_log"), F.lit(" Event "), F.col("_id").cast("string"), F.lit(": "),
            F.col("_level"), F.lit(" from "), F.col("_source"),
        ),
        fields=fields,
        evidence=F.array(
            evidence_ref("EvtxFile" if offline_path else "EventLog", reference, collected_at=F.col("ts"))
        ),
        confidence=eventmap.event_log_confidence(F.col("_log")),
    )


def _is_long_lived(fields: Column, names: tuple[str, ...], long_lived: tuple[str, ...]) -> Column:
    if not long_lived:
        return F.lit(False)
    image = F.coalesce(*[bags.field(fields, n) for n in names])
    leaf = F.regexp_extract(image, r"([^\\/]*)$", 1)
    return F.coalesce(F.lower(leaf).isin([p.lower() for p in long_lived]), F.lit(False))


def _resolve(rows: DataFrame, ttl_minutes: tuple[int, int, int], has_long_lived: bool) -> DataFrame:
    """Create times per host, collection and pid; a record without a pid stays unresolved.

    The walk and the events it is joined to both read the rows: they are parsed once and staged.
    """
    path = staging_path(rows.sparkSession, "records")
    rows.drop("xml").write.parquet(path)
    rows = rows.sparkSession.read.schema(rows.drop("xml").schema).parquet(path)
    return resolve_process_keys(rows, ttl_minutes, has_long_lived=has_long_lived).drop("resolution", "life_seq")


def read_kernel_trace(
    records: DataFrame,
    boot_id: Column | None = None,
    ttl_minutes: tuple[int, int, int] = TRACE_TTL,
    long_lived: tuple[str, ...] = (),
) -> DataFrame:
    """Events from captured kernel-trace rows.

    ``host, collection_id, ingest_seq, ts, log_name, record_id, event_id,
    opcode, level, task, provider, xml``.
    """
    prepared = trace_fields(records).select(
        "*",
        _pid(F.col("_fields"), ["ProcessId", "ProcessID", "PID"], ["ExecutionProcessId"]).alias("pid"),
        times.create_time_field(F.col("_fields"), times.TRACE_CREATE_FIELDS).alias("create_hint"),
        _is_long_lived(F.col("_fields"), ("ImageName", "ProcessName"), long_lived).alias("is_long_lived"),
    ).withColumn("is_stop", (F.col("_category") == "Process") & (F.col("_action") == "Stop"))
    resolved = _resolve(prepared, ttl_minutes, bool(long_lived))
    return trace_events(
        resolved,
        keys.process_key(F.lit(0) if boot_id is None else boot_id, F.col("pid"), F.col("process_create_time")),
    )


def trace_fields(records: DataFrame) -> DataFrame:
    """Parse and normalise trace fields; stateless, so it also serves streams."""
    parsed = records.withColumn("_r", parse_record(F.col("xml"))).select(
        *records.columns,
        F.col("_r.EventData.Data").alias("_items"),
        F.col("_r.System.Execution._ProcessID").alias("_execution"),
    )
    base = {
        "EventId": F.col("event_id"),
        "Provider": F.col("provider"),
        "LogName": F.col("log_name"),
        "Opcode": F.col("opcode"),
        "Level": F.col("level"),
        "Task": F.col("task"),
        "ExecutionProcessId": bags.parse_pid(F.col("_execution")),
    }
    rows = _with_fields(parsed, F.col("_items"), base).withColumnRenamed("_fields", "_raw")
    raw = F.col("_raw")
    file_path = bags.first_field(raw, "FileName", "FilePath", "TargetFilename", "Path")
    key_path = bags.first_field(raw, "KeyName", "ObjectName", "RegistryPath", "KeyPath")
    rows = rows.withColumns({"_file": file_path, "_key": key_path, "_ep": build_endpoints(raw)})
    located = bags.merge_fields(
        raw,
        {
            "Path": F.coalesce("_key", "_file"),
            "LocalEndpoint": F.col("_ep.local_ep"),
            "RemoteEndpoint": F.col("_ep.remote_ep"),
            "Protocol": F.col("_ep.protocol"),
        },
    )
    mapped = eventmap.map_trace(F.col("log_name"), F.col("event_id"), F.col("opcode"))
    return rows.select(
        "*",
        bags.normalize_trace_fields(located, F.col("opcode")).alias("_fields"),
        mapped["category"].alias("_category"),
        mapped["action"].alias("_action"),
    )


def trace_events(rows: DataFrame, process: Column) -> DataFrame:
    """Rows of :func:`trace_fields` with a resolved process key as events."""
    flow = F.when(
        F.col("_ep").isNotNull(),
        keys.flow_key(
            F.col("_ep.protocol"), F.col("_ep.local_ep"), F.col("_ep.remote_ep"), F.col("pid"), F.col("ts")
        ),
    )
    return to_events(
        rows,
        ts=F.col("ts"),
        category=F.col("_category"),
        action=F.col("_action"),
        subject_process=process,
        object_file=F.when(F.col("_file").isNotNull(), keys.file_key(path=F.col("_file"))),
        object_registry=keys.registry_key(F.col("_key")),
        object_flow=flow,
        summary=F.concat(F.lit("ETW "), F.col("_category"), F.lit("."), F.col("_action")),
        fields=F.col("_fields"),
        evidence=F.array(
            evidence_ref(
                "ETW", F.concat(F.col("log_name"), F.lit(":"), F.col("record_id").cast("string")),
                collected_at=F.col("ts"),
            )
        ),
        confidence=F.lit("High"),
    )
