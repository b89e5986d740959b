"""Event-id and trace-channel mapping to category and action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bags import field
from .text import icontains

POWERSHELL_LOG = "Microsoft-Windows-PowerShell/Operational"
WMI_LOG = "Microsoft-Windows-WMI-Activity/Operational"
TASK_LOG = "Microsoft-Windows-TaskScheduler/Operational"
DEFENDER_LOG = "Microsoft-Windows-Windows Defender/Operational"
SYSMON_LOGS = ["Microsoft-Windows-Sysmon/Operational", "Sysmon/Operational"]

# Fixed values: (log, event id, category, action).
EVENT_RULES = [
    ("Security", 4624, "Logon", "Start"),
    ("Security", 4625, "Logon", "Failed"),
    ("Security", 4634, "Logon", "Stop"),
    ("Security", 4648, "Logon", "Start"),
    ("Security", 4672, "Logon", "Start"),
    ("Security", 4688, "Process", "Start"),
    ("Security", 4689, "Process", "Stop"),
    ("Security", 4697, "Service", "Query"),
    ("Security", 4698, "ScheduledTask", "Query"),
    ("Security", 4699, "ScheduledTask", "Query"),
    ("Security", 4700, "ScheduledTask", "Query"),
    ("Security", 4701, "ScheduledTask", "Query"),
    ("System", 6005, "System", "Start"),
    ("System", 6006, "System", "Stop"),
    ("System", 6008, "System", "Stop"),
    ("System", 6009, "System", "Start"),
    ("System", 1074, "System", "Stop"),
    (POWERSHELL_LOG, 4103, "PowerShell", "Module"),
    (POWERSHELL_LOG, 4104, "PowerShell", "ScriptBlock"),
    (TASK_LOG, 106, "ScheduledTask", "Register"),
    (TASK_LOG, 129, "ScheduledTask", "Register"),
    (TASK_LOG, 140, "ScheduledTask", "Modify"),
    (TASK_LOG, 141, "ScheduledTask", "Delete"),
    (TASK_LOG, 102, "ScheduledTask", "Delete"),
    (TASK_LOG, 200, "ScheduledTask", "Start"),
    (TASK_LOG, 201, "ScheduledTask", "Stop"),
    (DEFENDER_LOG, 1116, "Antimalware", "Detection"),
    (DEFENDER_LOG, 1118, "Antimalware", "Detection"),
    (DEFENDER_LOG, 1117, "Antimalware", "Action"),
    (DEFENDER_LOG, 5007, "Antimalware", "ConfigChange"),
] + [
    (log, event_id, category, action)
    for log in SYSMON_LOGS
    for event_id, category, action in [
        (1, "Process", "Start"),
        (5, "Process", "Stop"),
        (3, "Network", "Query"),
        (7, "Image", "Load"),
        (11, "File", "Create"),
        (22, "DNS", "Query"),
        (23, "File", "Delete"),
    ]
]

# Category of ids without a rule, per log; the action is Query.
LOG_DEFAULTS = {
    "Security": "Security",
    "System": "System",
    "Application": "Application",
    POWERSHELL_LOG: "PowerShell",
    WMI_LOG: "WMI",
    TASK_LOG: "ScheduledTask",
    DEFENDER_LOG: "Antimalware",
    SYSMON_LOGS[0]: "Sysmon",
    SYSMON_LOGS[1]: "Sysmon",
}
OTHER_LOG = "Log"

# Trace channel part, opcode parts that decide the action, default action.
TRACE_RULES = [
    ("Kernel-Process", [(["Start"], "Start"), (["Stop"], "Stop")], "Process"),
    (
        "Kernel-File",
        [(["Create", "Write", "Delete"], "Write"), (["Read", "Open"], "Open"), (["Close"], "Stop")],
        "File",
    ),
    ("Kernel-Registry", [(["Set", "Create", "Delete"], "Write"), (["Open"], "Open")], "Registry"),
    ("Kernel-Network", [(["Connect"], "Connect")], "Network"),
]
TRACE_PROCESS_IDS = {1: "Start", 2: "Stop"}


def event_rule_frame(spark: SparkSession) -> DataFrame:
    """The id rules as a fixed-size table for a broadcast join."""
    return spark.createDataFrame(
        EVENT_RULES, "rule_log string, rule_event_id bigint, rule_category string, rule_action string"
    )


def log_default_category(log: Column) -> Column:
    defaults = F.create_map(*[F.lit(x) for pair in LOG_DEFAULTS.items() for x in pair])
    return F.coalesce(F.try_element_at(defaults, log), F.lit(OTHER_LOG))


def map_event_id(log: Column, event_id: Column) -> Column:
    """Struct ``category, action`` by ``(log, id)`` with the per-log default."""
    by_key = F.create_map(
        *[
            part
            for rule_log, rule_id, category, action in EVENT_RULES
            for part in (
                F.lit(f"{rule_log}#{rule_id}"),
                F.struct(F.lit(category).alias("category"), F.lit(action).alias("action")),
            )
        ]
    )
    default = F.struct(log_default_category(log).alias("category"), F.lit("Query").alias("action"))
    key = F.concat(F.coalesce(log, F.lit("")), F.lit("#"), event_id.cast("bigint").cast("string"))
    return F.coalesce(F.try_element_at(by_key, key), default)


def join_event_rules(records: DataFrame, log: str = "log_name", event_id: str = "event_id") -> DataFrame:
    """Add ``category`` and ``action`` by a broadcast join with the fixed rule table."""
    rules = F.broadcast(event_rule_frame(records.sparkSession))
    joined = records.join(
        rules,
        (records[log] == rules["rule_log"]) & (records[event_id].cast("bigint") == rules["rule_event_id"]),
        "left",
    )
    return joined.withColumns(
        {
            "category": F.coalesce(F.col("rule_category"), log_default_category(F.col(log))),
            "action": F.coalesce(F.col("rule_action"), F.lit("Query")),
        }
    ).drop("rule_log", "rule_event_id", "rule_category", "rule_action")


def map_trace(channel: Column, event_id: Column, opcode: Column) -> Column:
    """Struct ``category, action`` by channel and opcode; parts match ignoring case.

    A Disconnect opcode contains Connect and therefore maps to Connect.
    """
    category, action = F.lit("ETW"), F.lit("Query")
    for part, opcodes, name in reversed(TRACE_RULES):
        decided = F.lit("Query")
        for needles, verb in reversed(opcodes):
            hit = F.lit(False)
            for needle in needles:
                hit = hit | icontains(opcode, needle)
            decided = F.when(hit, F.lit(verb)).otherwise(decided)
        if name == "Process":
            for rule_id, verb in TRACE_PROCESS_IDS.items():
                decided = F.when(event_id == rule_id, F.lit(verb)).otherwise(decided)
        category = F.when(icontains(channel, part), F.lit(name)).otherwise(category)
        action = F.when(icontains(channel, part), decided).otherwise(action)
    return F.struct(category.alias("category"), action.alias("action"))


def event_log_confidence(log: Column) -> Column:
    return F.when(log == "Security", F.lit("High")).otherwise(F.lit("Medium"))


def subject_sid(properties: Column, fields: Column) -> Column:
    """First property that is a SID, else the subject's, else the target's."""

    def sid(value: Column) -> Column:
        return F.when(F.upper(value).startswith("S-1-"), value)

    listed = F.get(F.filter(properties, lambda p: F.upper(p).startswith("S-1-")), F.lit(0))
    return F.coalesce(listed, sid(field(fields, "SubjectUserSid")), sid(field(fields, "TargetUserSid")))
