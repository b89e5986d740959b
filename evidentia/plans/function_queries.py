"""Scalar functions over the given tables: normalisation, time, keys, fields, endpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bags, browser, endpoints, eventmap, keys, text, times
from ..functions.actions import normalize_action, normalize_event
from ..functions.bags import field
from ..functions.paths import log_name_from_path
from ..operators.windows import stream_event_key
from ..schema import evidence_ref, string_map
from .base import activity, big, iso_sql, joined_bytes, le_binary, query, raw_events, spread, table, ticks, us, with_ev

_FT = "116444736000000000"


@query(
    "fn_normalize_action",
    with_ev("SELECT raw_action, action, count(*)::BIGINT AS n FROM ev GROUP BY raw_action, action"),
)
def fn_normalize_action(spark, sf):
    rows = activity(spark, sf, normalize=False).select("action")
    return (
        rows.select(F.col("action").alias("raw_action"), normalize_action(F.col("action")).alias("action"))
        .groupBy("raw_action", "action")
        .agg(F.count("*").alias("n"))
    )


@query(
    "fn_normalize_event",
    with_ev("SELECT seq, action, raw_action AS original_action FROM ev"),
)
def fn_normalize_event(spark, sf):
    rows = normalize_event(activity(spark, sf, normalize=False))
    return rows.select(
        F.col("ingest_seq").alias("seq"), "action", field(F.col("fields"), "OriginalAction").alias("original_action")
    )


@query("fn_filetime", "SELECT event_id, epoch_us(ts) AS us FROM events")
def fn_filetime(spark, sf):
    rows = raw_events(spark, sf)
    return rows.select("event_id", us(times.filetime(ticks(F.col("ts")) + F.col("event_id") % 10)).alias("us"))


@query(
    "fn_filetime_checked",
    f"""WITH f AS (
      SELECT event_id, CASE event_id % 6
        WHEN 0 THEN 0 WHEN 1 THEN -1 WHEN 2 THEN 9223372036854775807
        WHEN 3 THEN (epoch_us(ts) - 20 * 31557600000000) * 10 + {_FT}
        WHEN 4 THEN (epoch_us(ts) + 20 * 31557600000000) * 10 + {_FT}
        ELSE epoch_us(ts) * 10 + {_FT} END AS ft FROM events),
    t AS (SELECT event_id, ft, CASE WHEN ft > 0 AND ft < 9223372036854775807 THEN (ft - {_FT}) // 10 END AS us FROM f),
    y AS (SELECT *, year(make_timestamp(us)) AS y FROM t)
    SELECT event_id, CASE WHEN y BETWEEN 1990 AND 2038 THEN us END AS run_us,
           CASE WHEN y BETWEEN 2000 AND 2100 THEN us END AS registry_us,
           CASE WHEN y BETWEEN 1970 AND 2100 THEN us END AS jump_us, us AS record_us FROM y""",
)
def fn_filetime_checked(spark, sf):
    span = 20 * 31_557_600_000_000
    base = us(F.col("ts"))
    case = F.col("event_id") % 6
    ft = (
        F.when(case == 0, F.lit(0))
        .when(case == 1, F.lit(-1))
        .when(case == 2, F.lit(2**63 - 1))
        .when(case == 3, (base - span) * 10 + times.FILETIME_UNIX_EPOCH)
        .when(case == 4, (base + span) * 10 + times.FILETIME_UNIX_EPOCH)
        .otherwise(base * 10 + times.FILETIME_UNIX_EPOCH)
    )
    rows = raw_events(spark, sf).select("event_id", ft.alias("ft"))
    return rows.select(
        "event_id",
        us(times.filetime_checked(F.col("ft"), times.RUN_ARTIFACT_YEARS)).alias("run_us"),
        us(times.filetime_checked(F.col("ft"), times.REGISTRY_ARTIFACT_YEARS)).alias("registry_us"),
        us(times.filetime_checked(F.col("ft"), times.JUMP_LIST_YEARS)).alias("jump_us"),
        us(times.filetime_not_sentinel(F.col("ft"))).alias("record_us"),
    )


@query("fn_unix_s", "SELECT event_id, epoch_us(ts) // 1000000 * 1000000 AS us FROM events")
def fn_unix_s(spark, sf):
    seconds = text.floor_div(us(F.col("ts")), 1_000_000)
    return raw_events(spark, sf).select("event_id", us(times.unix_seconds(seconds)).alias("us"))


@query("fn_unix_ms", "SELECT event_id, epoch_us(ts) // 1000 * 1000 AS us FROM events")
def fn_unix_ms(spark, sf):
    millis = text.floor_div(us(F.col("ts")), 1000)
    return raw_events(spark, sf).select("event_id", us(times.unix_millis(millis)).alias("us"))


@query("fn_chromium_time", "SELECT event_id, epoch_us(ts) AS us FROM events")
def fn_chromium_time(spark, sf):
    since_1601 = us(F.col("ts")) + times.CHROMIUM_UNIX_EPOCH_MICROS
    return raw_events(spark, sf).select("event_id", us(times.chromium_time(since_1601)).alias("us"))


@query("fn_firefox_time", "SELECT event_id, epoch_us(ts) // 1000 * 1000 AS us FROM events")
def fn_firefox_time(spark, sf):
    return raw_events(spark, sf).select("event_id", us(times.firefox_time(us(F.col("ts")))).alias("us"))


@query(
    "fn_to_utc",
    """SELECT event_id, epoch_us(CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 8 HOUR ELSE ts END) AS us FROM events""",
)
def fn_to_utc(spark, sf):
    kind = F.element_at(F.array(F.lit("Local"), F.lit("Utc"), F.lit("Unspecified")), (F.col("event_id") % 3 + 1).cast("int"))
    return raw_events(spark, sf).select("event_id", us(times.to_utc(F.col("ts"), kind, "Asia/Taipei")).alias("us"))


@query(
    "fn_guess_time",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) // 1000 * 1000
       WHEN 2 THEN epoch_us(ts) // 1000000 * 1000000 WHEN 3 THEN epoch_us(ts) END AS us FROM events""",
)
def fn_guess_time(spark, sf):
    case, micros = F.col("event_id") % 6, us(F.col("ts"))
    value = (
        F.when(case == 0, ticks(F.col("ts")).cast("string"))
        .when(case == 1, text.floor_div(micros, 1000).cast("string"))
        .when(case == 2, text.floor_div(micros, 1_000_000).cast("string"))
        .when(case == 3, times.format_iso(F.col("ts")))
        .when(case == 4, F.lit("17"))
        .otherwise(F.lit("not a time"))
    )
    return raw_events(spark, sf).select("event_id", us(times.guess_time(value)).alias("us"))


@query(
    "fn_create_time_field",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts) + 1000000 END AS log_us,
       CASE event_id % 3 WHEN 0 THEN epoch_us(ts) + 1000000 WHEN 1 THEN epoch_us(ts) + 1000000 END AS trace_us FROM events""",
)
def fn_create_time_field(spark, sf):
    case = F.col("event_id") % 3
    later = F.timestamp_micros(us(F.col("ts")) + 1_000_000)
    bag = string_map(
        {
            "CreationUtcTime": F.when(case == 0, times.format_iso(F.col("ts"))).when(case == 1, F.lit("bad")),
            "StartTime": F.when(case != 2, times.format_iso(later)),
        }
    )
    rows = spread(raw_events(spark, sf).select("event_id", "ts")).select("event_id", bag.alias("b"))
    return rows.select(
        "event_id",
        us(times.create_time_field(F.col("b"), times.EVENT_LOG_CREATE_FIELDS)).alias("log_us"),
        us(times.create_time_field(F.col("b"), times.TRACE_CREATE_FIELDS)).alias("trace_us"),
    )


@query(
    "fn_tz_display",
    """SELECT event_id, left(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), 23) AS utc,
       left(strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S.%f'), 23) AS local FROM events""",
)
def fn_tz_display(spark, sf):
    ts = F.col("ts")
    return raw_events(spark, sf).select(
        "event_id", times.format_display(ts).alias("utc"), times.format_display(ts, "Asia/Taipei").alias("local")
    )


@query(
    "fn_hour_bucket",
    "SELECT epoch_us(date_trunc('hour', ts)) AS bucket_us, count(*)::BIGINT AS n FROM events GROUP BY 1",
)
def fn_hour_bucket(spark, sf):
    return (
        raw_events(spark, sf)
        .groupBy(times.hour_bucket(F.col("ts")).alias("b"))
        .agg(F.count("*").alias("n"))
        .select(us(F.col("b")).alias("bucket_us"), "n")
    )


@query("fn_process_key", with_ev("SELECT seq, process_key FROM ev"))
def fn_process_key(spark, sf):
    return activity(spark, sf).select(F.col("ingest_seq").alias("seq"), F.col("subject_process.key").alias("process_key"))


@query(
    "fn_process_key_parse",
    with_ev("""SELECT seq, CASE WHEN k % 5 > 1 THEN boot_id::VARCHAR END AS boot_id,
      CASE WHEN k % 5 > 1 THEN pid END AS pid, CASE WHEN k % 5 > 1 THEN epoch_us(created) END AS created_us FROM ev"""),
)
def fn_process_key_parse(spark, sf):
    k = field(F.col("fields"), "k").cast("int") % 5
    good = F.col("subject_process.key")
    mangled = F.when(k == 0, F.replace(good, F.lit("P:"), F.lit("Q:"))).when(
        k == 1, F.regexp_replace(good, r"Z$", "?")
    ).otherwise(good)
    rows = activity(spark, sf).select("ingest_seq", keys.parse_process_key(mangled).alias("p"))
    return rows.select(
        F.col("ingest_seq").alias("seq"),
        F.col("p.boot_id").cast("string").alias("boot_id"),
        F.col("p.pid").alias("pid"),
        us(F.col("p.create_time")).alias("created_us"),
    )


@query("fn_flow_key", with_ev("SELECT seq, flow_key FROM evk WHERE protocol IS NOT NULL"))
def fn_flow_key(spark, sf):
    rows = activity(spark, sf).where(F.col("object_flow").isNotNull())
    return rows.select(F.col("ingest_seq").alias("seq"), F.col("object_flow.key").alias("flow_key"))


@query(
    "fn_flow_key_parse",
    with_ev("""SELECT seq, protocol, local_ep, remote_ep, flow_pid AS pid, epoch_us(bucket) AS bucket_us
      FROM evk WHERE protocol IS NOT NULL"""),
)
def fn_flow_key_parse(spark, sf):
    rows = activity(spark, sf).where(F.col("object_flow").isNotNull())
    parsed = rows.select("ingest_seq", keys.parse_flow_key(F.col("object_flow.key")).alias("f"))
    return parsed.select(
        F.col("ingest_seq").alias("seq"),
        "f.protocol",
        "f.local_ep",
        "f.remote_ep",
        "f.pid",
        us(F.col("f.time_bucket")).alias("bucket_us"),
    )


@query("fn_user_key", with_ev("SELECT seq, 'U:' || sid AS key_text, sid AS parsed FROM ev"))
def fn_user_key(spark, sf):
    rows = activity(spark, sf).select("ingest_seq", keys.user_key_text(F.col("subject_user")).alias("key_text"))
    return rows.select(
        F.col("ingest_seq").alias("seq"), "key_text", keys.parse_user_key(F.col("key_text"))["sid"].alias("parsed")
    )


@query(
    "fn_registry_key",
    r"""SELECT p_partkey, 'R:SOFTWARE\' || p_name AS key_text,
        CASE WHEN p_size % 2 = 0 THEN 'SOFTWARE\' || p_name END AS parsed FROM part""",
)
def fn_registry_key(spark, sf):
    path = F.concat(F.lit("SOFTWARE\\"), F.col("p_name"))
    rows = table(spark, sf, "part").select(
        "p_partkey", "p_size", keys.registry_key_text(keys.registry_key(path)).alias("key_text")
    )
    stored = F.when(F.col("p_size") % 2 == 0, F.col("key_text")).otherwise(F.substring("key_text", 3, 1000))
    return rows.select("p_partkey", "key_text", keys.parse_registry_key(stored)["path"].alias("parsed"))


@query("fn_host_key", "SELECT s_suppkey, 'H:S-1-5-' || s_nationkey || ':' || s_name AS key_text FROM supplier")
def fn_host_key(spark, sf):
    sid = F.concat(F.lit("S-1-5-"), F.col("s_nationkey").cast("string"))
    return table(spark, sf, "supplier").select("s_suppkey", keys.host_key_text(sid, F.col("s_name")).alias("key_text"))


def _file_keys(spark, sf):
    """Four shapes of file key from ``part``."""
    case = F.col("p_size") % 4
    path = F.concat(F.lit("C:\\parts\\"), F.col("p_name"))
    key = (
        F.when(case == 0, keys.file_key(volume_serial=F.lit("AB12CD34"), file_id=F.col("p_partkey")))
        .when(case == 1, keys.file_key(path=path))
        .when(case == 2, keys.file_key(path=path, hash_=F.sha2(F.col("p_name"), 256)))
        .otherwise(keys.file_key())
    )
    return table(spark, sf, "part").select("p_partkey", keys.file_key_text(key).alias("key_text"))


_FILE_KEY_SQL = r"""CASE p_size % 4 WHEN 0 THEN 'F:AB12CD34:' || p_partkey WHEN 1 THEN 'F:C:\parts\' || p_name
    WHEN 2 THEN 'F:C:\parts\' || p_name || ':' || left(sha256(p_name), 8) ELSE 'F:Unknown' END"""


@query("fn_file_key", f"SELECT p_partkey, {_FILE_KEY_SQL} AS key_text FROM part")
def fn_file_key(spark, sf):
    return _file_keys(spark, sf)


@query(
    "fn_file_key_parse",
    r"""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'AB12CD34' END AS volume_serial,
        CASE WHEN p_size % 4 = 0 THEN p_partkey::VARCHAR END AS file_id,
        CASE WHEN p_size % 4 IN (1, 2) THEN 'C:\parts\' || p_name END AS path FROM part""",
)
def fn_file_key_parse(spark, sf):
    rows = _file_keys(spark, sf).select("p_partkey", keys.parse_file_key(F.col("key_text")).alias("f"))
    return rows.select("p_partkey", "f.volume_serial", F.col("f.file_id").cast("string").alias("file_id"), "f.path")


@query(
    "fn_evidence_ref",
    "SELECT event_id, 'ETW' AS source, 'log:' || event_id AS reference, epoch_us(ts) AS collected_us FROM events",
)
def fn_evidence_ref(spark, sf):
    ref = evidence_ref("ETW", F.concat(F.lit("log:"), F.col("event_id").cast("string")), collected_at=F.col("ts"))
    rows = raw_events(spark, sf).select("event_id", ref.alias("r"))
    return rows.select("event_id", "r.source", "r.reference", us(F.col("r.collected_at")).alias("collected_us"))


@query(
    "fn_first_field",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'u' || user_id END AS first_value
       FROM events""",
)
def fn_first_field(spark, sf):
    case = F.col("event_id") % 3
    bag = string_map(
        {
            "A": F.when(case == 0, F.col("event_type")).otherwise(F.lit("  ")),
            "B": F.when(case == 1, F.concat(F.lit("u"), F.col("user_id").cast("string"))),
        }
    )
    return raw_events(spark, sf).select("event_id", bags.first_field(bag, "A", "B", "C").alias("first_value"))


def _numbers(spark, sf):
    case, n = F.col("p_size") % 4, F.col("p_partkey")
    value = (
        F.when(case == 0, n.cast("string"))
        .when(case == 1, F.concat(F.lit(" 0x"), F.conv(n.cast("string"), 10, 16)))
        .when(case == 2, F.concat(F.lit("-"), n.cast("string")))
        .otherwise(F.concat(F.lit("p"), n.cast("string")))
    )
    return table(spark, sf, "part").select("p_partkey", value.alias("v"))


@query(
    "fn_parse_pid",
    """SELECT p_partkey, CASE WHEN p_size % 4 IN (0, 1) OR (p_size % 4 = 2 AND p_partkey = 0) THEN p_partkey END AS pid
       FROM part""",
)
def fn_parse_pid(spark, sf):
    return _numbers(spark, sf).select("p_partkey", bags.parse_pid(F.col("v")).alias("pid"))


@query(
    "fn_parse_port",
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey WHEN 2 THEN -p_partkey END AS port
       FROM part""",
)
def fn_parse_port(spark, sf):
    return _numbers(spark, sf).select("p_partkey", bags.parse_port(F.col("v")).alias("port"))


@query(
    "fn_normalize_fields",
    """SELECT event_id, event_type AS operation, CASE WHEN event_id % 2 = 0 THEN 'ok' ELSE 'kept' END AS result,
       CASE WHEN event_id % 3 = 0 THEN '12' END AS duration, 'img' || user_id AS process_name,
       CASE WHEN event_id % 5 = 0 THEN '7' END AS parent_pid FROM events""",
)
def fn_normalize_fields(spark, sf):
    i = F.col("event_id")
    bag = string_map(
        {
            "Status": F.lit("ok"),
            "Result": F.when(i % 2 == 1, F.lit("kept")),
            "ElapsedTime": F.when(i % 3 == 0, F.lit("12")).otherwise(F.lit("")),
            "ImageName": F.concat(F.lit("img"), F.col("user_id").cast("string")),
            "ParentPID": F.when(i % 5 == 0, F.lit("7")),
        }
    )
    rows = raw_events(spark, sf).select("event_id", bags.normalize_trace_fields(bag, F.col("event_type")).alias("b"))
    names = ["Operation", "Result", "Duration", "ProcessName", "ParentProcessId"]
    columns = ["operation", "result", "duration", "process_name", "parent_pid"]
    return rows.select("event_id", *[field(F.col("b"), n).alias(c) for n, c in zip(names, columns)])


@query(
    "fn_build_endpoints",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 3 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'TCP' ELSE 'UDP' END END AS protocol,
       CASE WHEN s_suppkey % 4 <> 3 THEN '10.0.0.' || s_suppkey || ':' || (s_suppkey + 1) END AS local_ep,
       CASE WHEN s_suppkey % 4 <> 3 THEN '[fe80::' || s_suppkey || ']:255' END AS remote_ep FROM supplier""",
)
def fn_build_endpoints(spark, sf):
    key = F.col("s_suppkey")
    text_key = key.cast("string")
    bag = string_map(
        {
            "SourceAddress": F.concat(F.lit("10.0.0."), text_key),
            "sport": (key + 1).cast("string"),
            "DestAddress": F.concat(F.lit("fe80::"), text_key),
            "dport": F.when(key % 4 == 3, F.lit("none")).otherwise(F.lit("0xFF")),
            "ProtocolName": F.when(key % 2 == 1, F.lit("UDP")),
        }
    )
    rows = table(spark, sf, "supplier").select("s_suppkey", endpoints.build_endpoints(bag).alias("e"))
    return rows.select("s_suppkey", "e.protocol", "e.local_ep", "e.remote_ep")


def _endpoints(spark, sf):
    case, key = F.col("c_custkey") % 5, F.col("c_custkey").cast("string")
    ep = (
        F.when(case == 0, F.concat(F.lit("10.0."), (F.col("c_nationkey")).cast("string"), F.lit(".9:"), key))
        .when(case == 1, F.concat(F.lit("[2001:db8::"), (F.col("c_nationkey")).cast("string"), F.lit("]:"), key))
        .when(case == 2, F.concat(F.lit("host"), key))
        .when(case == 3, F.concat(F.lit("*:*")))
        .otherwise(F.lit(""))
    )
    return table(spark, sf, "customer").select("c_custkey", ep.alias("ep"))


@query(
    "fn_endpoint_addr",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '10.0.' || c_nationkey || '.9' WHEN 1 THEN '2001:db8::' || c_nationkey
       WHEN 2 THEN 'host' || c_custkey WHEN 3 THEN '*' ELSE '' END AS address FROM customer""",
)
def fn_endpoint_addr(spark, sf):
    return _endpoints(spark, sf).select("c_custkey", endpoints.endpoint_address(F.col("ep")).alias("address"))


@query(
    "fn_endpoint_port",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN c_custkey::VARCHAR
       WHEN 3 THEN '*' ELSE '' END AS port FROM customer""",
)
def fn_endpoint_port(spark, sf):
    return _endpoints(spark, sf).select("c_custkey", endpoints.endpoint_port(F.col("ep")).alias("port"))


@query(
    "fn_addr_family",
    """SELECT CASE c_custkey % 5 WHEN 0 THEN 'v4' WHEN 1 THEN 'v6' ELSE 'other' END AS family, count(*)::BIGINT AS n
       FROM customer GROUP BY 1""",
)
def fn_addr_family(spark, sf):
    family = endpoints.address_family(F.col("ep")).alias("family")
    return _endpoints(spark, sf).groupBy(family).agg(F.count("*").alias("n"))


@query(
    "fn_conn_state",
    with_ev("""SELECT upper(CASE WHEN state <> '' THEN state WHEN k % 2 = 0 THEN action ELSE 'unknown' END) AS state,
      count(*)::BIGINT AS n FROM ev GROUP BY 1"""),
)
def fn_conn_state(spark, sf):
    bag = F.col("fields")
    action = F.when(field(bag, "k").cast("int") % 2 == 0, F.col("action")).otherwise(F.lit(" "))
    state = endpoints.connection_state(field(bag, "State"), action).alias("state")
    return activity(spark, sf).groupBy(state).agg(F.count("*").alias("n"))


_LOGS = [
    "Security",
    "System",
    "Application",
    eventmap.POWERSHELL_LOG,
    eventmap.TASK_LOG,
    eventmap.DEFENDER_LOG,
    eventmap.SYSMON_LOGS[0],
    "Custom",
]
_IDS = sorted({rule[1] for rule in eventmap.EVENT_RULES} | {9999})
_LOG_SQL = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{log}'" for i, log in enumerate(_LOGS)) + " END"
_ID_SQL = f"list_extract({_IDS}, CAST((event_id // 8) % {len(_IDS)} AS INTEGER) + 1)"


def _log_records(spark, sf):
    """Every log paired with every rule id along the events table."""
    log = F.element_at(F.array(*[F.lit(x) for x in _LOGS]), (F.col("event_id") % 8 + 1).cast("int"))
    number = F.element_at(
        F.array(*[F.lit(i) for i in _IDS]),
        (F.call_function("div", F.col("event_id"), F.lit(8)) % len(_IDS) + 1).cast("int"),
    )
    return raw_events(spark, sf).select("event_id", log.alias("log_name"), big(number).alias("log_event_id"))


_RULE_VALUES = ", ".join(f"('{log}', {i}, '{c}', '{a}')" for log, i, c, a in eventmap.EVENT_RULES)
_DEFAULT_VALUES = ", ".join(f"('{log}', '{c}')" for log, c in eventmap.LOG_DEFAULTS.items())
_RULE_SQL = f"""WITH r(log, id, category, action) AS (VALUES {_RULE_VALUES}), d(log, category) AS (VALUES {_DEFAULT_VALUES}),
  e AS (SELECT event_id, {_LOG_SQL} AS log, {_ID_SQL} AS id FROM events)
  SELECT e.event_id, coalesce(r.category, d.category, 'Log') AS category, coalesce(r.action, 'Query') AS action
  FROM e LEFT JOIN r ON e.log = r.log AND e.id = r.id LEFT JOIN d ON e.log = d.log"""


@query("fn_map_event_id", _RULE_SQL)
def fn_map_event_id(spark, sf):
    rows = _log_records(spark, sf)
    mapped = eventmap.map_event_id(F.col("log_name"), F.col("log_event_id"))
    return rows.select("event_id", mapped.alias("m")).select("event_id", "m.category", "m.action")


@query("jn_rule_lookup", _RULE_SQL)
def jn_rule_lookup(spark, sf):
    rows = _log_records(spark, sf)
    return eventmap.join_event_rules(rows, "log_name", "log_event_id").select("event_id", "category", "action")


@query(
    "fn_map_trace",
    """WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'X-Kernel-Process/A' WHEN 1 THEN 'X-kernel-file/A'
         WHEN 2 THEN 'X-Kernel-Registry/A' WHEN 3 THEN 'X-Kernel-Network/A' ELSE 'Other' END AS ch,
         (event_id // 5) % 3 AS id, list_extract(['create', 'ReadFile', 'CloseFile', 'SetValue', 'OpenKey', 'Disconnect', 'StartIt', 'Stopping', 'zzz'],
         CAST((event_id // 15) % 9 AS INTEGER) + 1) AS op FROM events)
       SELECT event_id,
         CASE WHEN ch ILIKE '%kernel-process%' THEN 'Process' WHEN ch ILIKE '%kernel-file%' THEN 'File'
              WHEN ch ILIKE '%kernel-registry%' THEN 'Registry' WHEN ch ILIKE '%kernel-network%' THEN 'Network' ELSE 'ETW' END AS category,
         CASE WHEN ch ILIKE '%kernel-process%' THEN CASE WHEN id = 1 THEN 'Start' WHEN id = 2 THEN 'Stop'
                WHEN op ILIKE '%start%' THEN 'Start' WHEN op ILIKE '%stop%' THEN 'Stop' ELSE 'Query' END
              WHEN ch ILIKE '%kernel-file%' THEN CASE WHEN op ILIKE '%create%' OR op ILIKE '%write%' OR op ILIKE '%delete%' THEN 'Write'
                WHEN op ILIKE '%read%' OR op ILIKE '%open%' THEN 'Open' WHEN op ILIKE '%close%' THEN 'Stop' ELSE 'Query' END
              WHEN ch ILIKE '%kernel-registry%' THEN CASE WHEN op ILIKE '%set%' OR op ILIKE '%create%' OR op ILIKE '%delete%' THEN 'Write'
                WHEN op ILIKE '%open%' THEN 'Open' ELSE 'Query' END
              WHEN ch ILIKE '%kernel-network%' AND op ILIKE '%connect%' THEN 'Connect' ELSE 'Query' END AS action FROM t""",
)
def fn_map_trace(spark, sf):
    i = F.col("event_id")
    pick = lambda items, n: F.element_at(F.array(*[F.lit(x) for x in items]), (n + 1).cast("int"))
    channel = pick(["X-Kernel-Process/A", "X-kernel-file/A", "X-Kernel-Registry/A", "X-Kernel-Network/A", "Other"], i % 5)
    opcode = pick(
        ["create", "ReadFile", "CloseFile", "SetValue", "OpenKey", "Disconnect", "StartIt", "Stopping", "zzz"],
        F.call_function("div", i, F.lit(15)) % 9,
    )
    rows = raw_events(spark, sf).select(
        "event_id", eventmap.map_trace(channel, F.call_function("div", i, F.lit(5)) % 3, opcode).alias("m")
    )
    return rows.select("event_id", "m.category", "m.action")


@query(
    "fn_eventlog_confidence",
    f"""SELECT CASE WHEN log = 'Security' THEN 'High' ELSE 'Medium' END AS confidence, count(*)::BIGINT AS n
        FROM (SELECT {_LOG_SQL} AS log FROM events) GROUP BY 1""",
)
def fn_eventlog_confidence(spark, sf):
    confidence = eventmap.event_log_confidence(F.col("log_name")).alias("confidence")
    return _log_records(spark, sf).groupBy(confidence).agg(F.count("*").alias("n"))


@query(
    "fn_subject_sid",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'S-1-5-' || user_id WHEN 1 THEN 's-1-9' WHEN 2 THEN 'S-1-7' END AS sid
       FROM events""",
)
def fn_subject_sid(spark, sf):
    case, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    listed = F.when(case == 0, F.array(F.lit("x"), F.concat(F.lit("S-1-5-"), user), F.lit("S-1-0"))).otherwise(
        F.array(F.lit("x"))
    )
    bag = string_map(
        {
            "SubjectUserSid": F.when(case == 1, F.lit("s-1-9")).otherwise(F.lit("none")),
            "TargetUserSid": F.when(case != 3, F.lit("S-1-7")),
        }
    )
    return raw_events(spark, sf).select("event_id", eventmap.subject_sid(listed, bag).alias("sid"))


@query(
    "fn_evtx_log_name",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'OfflineEvtx' ELSE 'Log-' || s_name || '/Operational' END AS log_name
       FROM supplier""",
)
def fn_evtx_log_name(spark, sf):
    path = F.when(F.col("s_suppkey") % 3 == 0, F.lit("  ")).otherwise(
        F.concat(F.lit("C:\\logs\\Log-"), F.col("s_name"), F.lit("%4Operational.evtx"))
    )
    return table(spark, sf, "supplier").select("s_suppkey", log_name_from_path(path).alias("log_name"))


@query(
    "fn_visit_type",
    """SELECT event_id, CASE k % 12 WHEN 0 THEN 'Link' WHEN 1 THEN 'Typed' WHEN 2 THEN 'Auto Bookmark' WHEN 3 THEN 'Auto Subframe'
         WHEN 4 THEN 'Manual Subframe' WHEN 5 THEN 'Generated' WHEN 6 THEN 'Start Page' WHEN 7 THEN 'Form Submit' WHEN 8 THEN 'Reload'
         ELSE (k % 12)::VARCHAR END AS chromium,
       CASE k % 12 WHEN 1 THEN 'Link' WHEN 2 THEN 'Typed' WHEN 3 THEN 'Bookmark' WHEN 4 THEN 'Embed' WHEN 5 THEN 'Redirect Perm'
         WHEN 6 THEN 'Redirect Temp' WHEN 7 THEN 'Download' ELSE (k % 12)::VARCHAR END AS firefox
       FROM (SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events)""",
)
def fn_visit_type(spark, sf):
    code = F.col("k") % 12
    return raw_events(spark, sf).select(
        "event_id",
        browser.chromium_visit_type(code + 0x30000000).alias("chromium"),
        browser.firefox_visit_type(code).alias("firefox"),
    )


@query(
    "fn_browser_context",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Chrome (Chromium-based)' WHEN 1 THEN 'Edge (Chromium-based)'
         WHEN 2 THEN 'Chromium' ELSE 'Firefox' END AS browser, 'u' || c_custkey AS user_profile,
       CASE c_custkey % 4 WHEN 0 THEN 'Profile ' || c_nationkey WHEN 3 THEN 'ab' || c_nationkey || '.default' ELSE 'Default' END AS browser_profile
       FROM customer""",
)
def fn_browser_context(spark, sf):
    case, nation = F.col("c_custkey") % 4, F.col("c_nationkey").cast("string")
    home = F.concat(F.lit("C:\\Users\\u"), F.col("c_custkey").cast("string"), F.lit("\\AppData\\"))
    path = (
        F.when(case == 0, F.concat(home, F.lit("Local\\Google\\Chrome\\User Data\\Profile "), nation, F.lit("\\History")))
        .when(case == 1, F.concat(home, F.lit("Local\\microsoft\\edge\\User Data\\Default\\History")))
        .when(case == 2, F.concat(home, F.lit("Local\\Other\\History")))
        .otherwise(F.concat(home, F.lit("Roaming\\Mozilla\\Firefox\\Profiles\\ab"), nation, F.lit(".default\\places.sqlite")))
    )
    rows = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(case == 3, browser.firefox_context(path)).otherwise(browser.chromium_context(path)).alias("c"),
    )
    return rows.select("c_custkey", "c.browser", "c.user_profile", "c.browser_profile")


@query(
    "fn_stream_event_key",
    with_ev(f"""SELECT seq, category || '.' || action || '.' || {iso_sql("ts")} || '.' || summary || '.' || seq AS event_key
      FROM ev"""),
)
def fn_stream_event_key(spark, sf):
    key = stream_event_key(
        F.col("category"),
        F.col("action"),
        times.format_iso(F.col("ts")),
        F.col("summary"),
        field(F.col("fields"), "RecordId"),
    )
    return activity(spark, sf).select(F.col("ingest_seq").alias("seq"), key.alias("event_key"))


def blob(*numbers):
    """Little-endian blob of (column, size) pairs."""
    return joined_bytes(*[le_binary(c, size) for c, size in numbers])
