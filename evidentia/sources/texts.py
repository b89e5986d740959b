"""Text artifacts: console histories, task definitions, printable runs, ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, times
from ..functions.paths import is_rooted, task_name_from_path, user_from_path
from ..functions.text import not_blank, strip, suspicious_keywords
from ..schema import evidence_ref, string_map, to_events

MIN_RUN = 3

# Trigger and action elements of a task definition.
TRIGGER_KINDS = [
    "BootTrigger",
    "CalendarTrigger",
    "EventTrigger",
    "IdleTrigger",
    "LogonTrigger",
    "RegistrationTrigger",
    "SessionStateChangeTrigger",
    "TimeTrigger",
    "WnfStateChangeTrigger",
]
ACTION_KINDS = ["Exec", "ComHandler", "SendEmail", "ShowMessage"]

_TRIGGER = "array<struct<Enabled:string,StartBoundary:string>>"
_ACTION = "array<struct<Command:string,Arguments:string,WorkingDirectory:string,ClassId:string>>"
TASK_XML = (
    "RegistrationInfo struct<Date:string,Author:string,Description:string,URI:string>,"
    "Principals struct<Principal:array<struct<UserId:string,GroupId:string,RunLevel:string,LogonType:string>>>,"
    f"Triggers struct<{','.join(f'{k}:{_TRIGGER}' for k in TRIGGER_KINDS)}>,"
    f"Actions struct<{','.join(f'{k}:{_ACTION}' for k in ACTION_KINDS)}>,"
    "Settings struct<Enabled:string,Hidden:string>,"
    "_corrupt_record string"
)


def console_lines(files: DataFrame) -> DataFrame:
    """``host, path, content`` files as one row per non-blank line, numbered from 1.

    Line ends of all three kinds count alike.
    """
    lines = F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")
    rows = files.select(
        *[c for c in files.columns if c != "content"], F.posexplode(lines).alias("_pos", "_line")
    )
    command = strip(F.col("_line"))
    return rows.select(
        *[c for c in files.columns if c != "content"],
        (F.col("_pos") + 1).alias("line_number"),
        command.alias("command"),
        suspicious_keywords(command).alias("keywords"),
    ).where(F.col("command") != "")


def console_events(files: DataFrame) -> DataFrame:
    """Console history as events; the file's own time is the only anchor.

    ``files``: ``host, path, content, modified``. Arrival numbers are the line
    numbers of the file.
    """
    rows = console_lines(files).withColumn("ingest_seq", F.col("line_number"))
    user = user_from_path(F.col("path"))
    words = F.when(F.size("keywords") > 0, F.array_join("keywords", ", "))
    return to_events(
        rows,
        ts=F.col("modified"),
        category=F.lit("PowerShell"),
        action=F.lit("ConsoleHostHistory"),
        summary=F.concat(F.lit("PowerShell history ("), user, F.lit("): "), F.col("command")),
        fields=string_map(
            {
                "User": user,
                "Command": F.col("command"),
                "LineNumber": F.col("line_number"),
                "HistoryFilePath": F.col("path"),
                "SuspiciousKeywords": words,
            }
        ),
        evidence=F.array(evidence_ref("PowerShellHistory", F.col("path"))),
        confidence=F.lit("Medium"),
    )


def read_text_files(spark: SparkSession, path: str, host: str) -> DataFrame:
    """Whole text files as ``host, path, content, modified``."""
    return spark.read.option("wholetext", True).text(path).select(
        F.lit(host).alias("host"),
        F.col("_metadata.file_path").alias("path"),
        F.col("value").alias("content"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def read_task_files(spark: SparkSession, path: str, host: str) -> DataFrame:
    """Task definition files with content decoded by byte-order mark and its SHA-256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    mark = F.hex(F.substring("content", 1, 2))
    text = F.when(mark == "FFFE", F.decode("content", "UTF-16")).when(mark == "FEFF", F.decode("content", "UTF-16"))
    return files.select(
        F.lit(host).alias("host"),
        F.col("path"),
        F.regexp_replace(text.otherwise(F.decode("content", "UTF-8")), "^﻿", "").alias("xml"),
        F.sha2("content", 256).alias("hash"),
        F.col("modificationTime").alias("modified"),
    )


def _value(text: Column) -> Column:
    return F.when(strip(text) != "", strip(text))


def _boolean(text: Column) -> Column:
    return F.when(F.lower(strip(text)).isin("true", "1"), F.lit(True)).when(
        F.lower(strip(text)).isin("false", "0"), F.lit(False)
    )


def _local_time(text: Column, zone: str) -> Column:
    """Times without an offset are local to the collected machine."""
    stated = times.parse_iso(text)
    zoned = F.coalesce(strip(text).rlike(r"(Z|z|[+-]\d{2}:?\d{2})$"), F.lit(False))
    return F.when(zoned, stated).otherwise(F.to_utc_timestamp(stated, zone))


def _tags(xml: Column, block: str) -> Column:
    """Names of the elements of a block in document order."""
    body = F.regexp_extract(xml, rf"(?s)<(?:\w+:)?{block}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{block}>", 1)
    return F.regexp_extract_all(
        F.regexp_replace(body, r"(?s)<!--.*?-->", ""),
        F.lit(r"(?s)<(?:\w+:)?(\w+)(?:\s[^>]*)?(?:/>|>.*?</(?:\w+:)?\1>)"),
        F.lit(1),
    )


def _in_document_order(tags: Column, groups: Column, kinds: list[str], pick) -> Column:
    """Elements of a block in document order.

    The XML reader groups elements by kind; the order of the tags in the text
    tells which of its kind each one is.
    """

    def element(tag: Column, i: Column) -> Column:
        nth = F.size(F.filter(F.slice(tags, F.lit(1), i + 1), lambda t: t == tag)) - 1
        chosen = F.lit(None)
        for kind in reversed(kinds):
            chosen = F.when(tag == kind, F.get(groups[kind], nth)).otherwise(chosen)
        return F.struct(tag.alias("tag"), chosen.alias("element"))

    return F.transform(F.transform(tags, element), lambda x: pick(x["tag"], x["element"]))


def parse_tasks(files: DataFrame, local_zone: str = "UTC") -> DataFrame:
    """One row per task definition; files that are no task are dropped.

    ``files``: ``host, path, xml, hash, modified``.
    """
    is_task = F.col("xml").rlike(r"(?s)^\s*(<\?xml.*?\?>)?\s*(<!--.*?-->\s*)*<(\w+:)?Task[\s>]")
    body = F.regexp_replace("xml", r"(?s)^\s*<\?xml.*?\?>", "")
    document = F.struct(
        F.from_xml(body, TASK_XML, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("t"),
        _tags(body, "Triggers").alias("triggers"),
        _tags(body, "Actions").alias("actions"),
    )
    # Exploded out of an array of one: the planner copies no parse through that, neither into the filter nor into a lambda.
    parsed = files.where(is_task).select("*", F.explode(F.array(document)).alias("_d"))
    parsed = parsed.where(F.col("_d.t").isNotNull() & F.col("_d.t._corrupt_record").isNull())
    t = F.col("_d.t")
    principal = F.get(t["Principals"]["Principal"], F.lit(0))
    triggers = _in_document_order(
        F.col("_d.triggers"),
        t["Triggers"],
        TRIGGER_KINDS,
        lambda tag, e: F.struct(
            tag.alias("kind"),
            _boolean(e["Enabled"]).alias("enabled"),
            _value(e["StartBoundary"]).alias("start"),
            _local_time(_value(e["StartBoundary"]), local_zone).alias("start_utc"),
        ),
    )
    actions = _in_document_order(
        F.col("_d.actions"),
        t["Actions"],
        ACTION_KINDS,
        lambda tag, e: F.struct(
            tag.alias("kind"),
            F.when(tag == "Exec", _value(e["Command"])).alias("command"),
            F.when(tag == "Exec", _value(e["Arguments"])).alias("arguments"),
            F.when(tag == "Exec", _value(e["WorkingDirectory"])).alias("working_directory"),
            F.when(tag == "ComHandler", _value(e["ClassId"])).alias("class_id"),
        ),
    )
    info, settings = t["RegistrationInfo"], t["Settings"]
    return parsed.select(
        *[c for c in files.columns if c != "xml"],
        task_name_from_path(F.col("path")).alias("task_name"),
        _value(info["Author"]).alias("author"),
        _value(info["Description"]).alias("description"),
        _value(info["URI"]).alias("uri"),
        _local_time(_value(info["Date"]), local_zone).alias("registered"),
        _value(principal["UserId"]).alias("user_id"),
        _value(principal["GroupId"]).alias("group_id"),
        _value(principal["RunLevel"]).alias("run_level"),
        _value(principal["LogonType"]).alias("logon_type"),
        _boolean(settings["Enabled"]).alias("enabled"),
        _boolean(settings["Hidden"]).alias("hidden"),
        F.coalesce(triggers, F.array()).alias("triggers"),
        F.coalesce(actions, F.array()).alias("actions"),
    )


def task_time(registered: Column, triggers: Column, modified: Column) -> Column:
    """Registration, else the earliest trigger, else the file time."""
    return F.coalesce(registered, F.array_min(F.transform(triggers, lambda t: t["start_utc"])), modified)


def format_triggers(triggers: Column) -> Column:
    text = lambda t: F.concat(
        t["kind"],
        F.coalesce(F.concat(F.lit("@"), t["start"]), F.lit("")),
        F.when(~t["enabled"], F.lit(" (disabled)")).otherwise(F.lit("")),
    )
    return F.array_join(F.transform(triggers, text), "; ")


def format_actions(actions: Column) -> Column:
    def text(a: Column) -> Column:
        arguments = F.coalesce(F.concat(F.lit(" "), a["arguments"]), F.lit(""))
        return (
            F.when(a["kind"] == "Exec", F.concat(F.lit("Exec:"), F.coalesce(a["command"], F.lit("")), arguments))
            .when(a["kind"] == "ComHandler", F.concat(F.lit("ComHandler:"), F.coalesce(a["class_id"], F.lit(""))))
            .otherwise(a["kind"])
        )

    return F.array_join(F.transform(actions, text), "; ")


def task_summary(task_name: Column, actions: Column) -> Column:
    run = F.get(F.filter(actions, lambda a: a["command"].isNotNull()), F.lit(0))
    handler = F.get(F.filter(actions, lambda a: a["kind"] == "ComHandler"), F.lit(0))
    arguments = F.coalesce(F.concat(F.lit(" "), run["arguments"]), F.lit(""))
    target = F.coalesce(
        F.concat(F.lit(" → "), run["command"], arguments),
        F.concat(F.lit(" → COM handler "), handler["class_id"]),
        F.lit(""),
    )
    return F.concat(F.lit("Scheduled task: "), task_name, target)


def task_events(tasks: DataFrame) -> DataFrame:
    """Rows of :func:`parse_tasks` as events."""
    run = F.get(F.filter("actions", lambda a: a["command"].isNotNull()), F.lit(0))
    command = run["command"]
    present = lambda c: F.when(F.size(c) > 0, F.lit(True))
    return to_events(
        tasks,
        ts=task_time(F.col("registered"), F.col("triggers"), F.col("modified")),
        category=F.lit("Persistence"),
        action=F.lit("ScheduledTask"),
        object_file=F.when(is_rooted(command), keys.file_key(path=command)),
        summary=task_summary(F.col("task_name"), F.col("actions")),
        fields=string_map(
            {
                "TaskName": F.col("task_name"),
                "TriggerCount": F.size("triggers"),
                "ActionCount": F.size("actions"),
                "TaskFilePath": F.col("path"),
                "Author": F.col("author"),
                "Description": F.col("description"),
                "URI": F.col("uri"),
                "RegistrationDate": times.format_iso(F.col("registered")),
                "PrincipalUserId": F.col("user_id"),
                "PrincipalGroupId": F.col("group_id"),
                "RunLevel": F.col("run_level"),
                "LogonType": F.col("logon_type"),
                "Enabled": F.initcap(F.col("enabled").cast("string")),
                "Hidden": F.initcap(F.col("hidden").cast("string")),
                "ExecCommand": command,
                "ExecArguments": not_blank(run["arguments"]),
                "ExecWorkingDirectory": not_blank(run["working_directory"]),
                "Triggers": F.when(present("triggers"), format_triggers(F.col("triggers"))),
                "Actions": F.when(present("actions"), format_actions(F.col("actions"))),
            }
        ),
        evidence=F.array(evidence_ref("ScheduledTask", F.col("path"), F.col("hash"), F.col("registered"))),
        confidence=F.lit("High"),
    )


def printable_runs(files: DataFrame) -> DataFrame:
    """``host, file, content`` binaries as runs of three or more printable ASCII characters."""
    text = F.decode("content", "ISO-8859-1")
    runs = F.regexp_extract_all(text, F.lit(r"[\x20-\x7E]{%d,}" % MIN_RUN), F.lit(0))
    return files.select("host", "file", F.posexplode(runs).alias("pos", "run"))


def read_repository_files(spark: SparkSession, path: str, host: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(
        F.lit(host).alias("host"), F.col("path").alias("file"), "content", F.col("modificationTime").alias("anchor")
    )


def read_reference_csv(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth CSV: quoted fields with doubled quotes, a header, perhaps a byte-order mark."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
