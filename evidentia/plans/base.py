"""How the given tables stand in for activity data, in Spark and in SQL.

``events`` becomes an activity timeline, ``lineitem`` a table of network
flows, ``customer`` a process tree. Every binding reads its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, times
from ..functions.actions import normalize_action
from ..functions.registry import swap_hex
from ..schema import EVIDENCE, to_events
from ..session import COMPILED_METHODS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its operator id, with its SQL twin if there is one."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for key, value in {"spark.sql.session.timeZone": "UTC", **COMPILED_METHODS}.items():
                spark.conf.set(key, value)
            return function(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = function.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt over all cores: narrow tables are few splits, but what is built and parsed from a row is much work."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def big(column: Column) -> Column:
    return column.cast("bigint")


def us(ts: Column) -> Column:
    """Microseconds since 1970: engine-neutral form of a timestamp."""
    return F.unix_micros(ts.cast("timestamp"))


CATEGORIES = {"signup": "Process", "purchase": "File", "view": "Browser", "click": "Network", "error": "Logon"}
RAW_ACTIONS = {"signup": "start", "purchase": "write", "view": "visit", "click": "connected", "error": "failed"}
VERBS = {"signup": "Start", "purchase": "Write", "view": "Open", "click": "Connect", "error": "Query"}


def _choose(table_: dict[str, str]) -> Column:
    value = F.lit(None).cast("string")
    for event_type, text in table_.items():
        value = F.when(F.col("event_type") == event_type, F.lit(text)).otherwise(value)
    return value


def _case(table_: dict[str, str]) -> str:
    body = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items())
    return f"CASE event_type {body} END"


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with exact integers: cents for the value and ``k`` from the properties."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        big(F.round(F.col("value") * 100)).alias("cents"),
        big(F.get_json_object("props", "$.k")).alias("k"),
    )


def activity(spark: SparkSession, sf_dir: str, normalize: bool = True) -> DataFrame:
    """The activity timeline; with ``normalize`` the actions are canonical."""
    ev = spread(raw_events(spark, sf_dir))
    user, k = F.col("user_id").cast("string"), F.col("k").cast("string")
    pid, created = F.col("user_id") + 1, F.date_trunc("day", "ts")
    raw = _choose(RAW_ACTIONS)
    kind = F.col("event_type")
    local = F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string"), F.lit(":"), (F.col("k") + 1000).cast("string"))
    remote = F.when(
        F.col("k") % 10 == 0, F.concat(F.lit("[2001:db8::"), k, F.lit("]:443"))
    ).otherwise(F.concat(F.lit("93.184.216."), k, F.lit(":443")))
    flow = keys.flow_key(
        F.when(F.col("k") % 2 == 0, F.lit("TCP")).otherwise(F.lit("UDP")),
        local,
        remote,
        F.when(F.col("k") % 7 != 0, pid),
        F.col("ts"),
    )
    path = F.concat(F.lit("C:\\Data\\u"), user, F.lit("\\f"), k, F.lit(".bin"))
    image = F.concat(F.lit("proc"), (F.col("user_id") % 20).cast("string"), F.lit(".exe"))
    bag = {
        "k": k,
        "Size": F.col("cents").cast("string"),
        "Operation": kind,
        "Result": F.when(F.col("k") % 10 == 0, F.lit("FAIL")).otherwise(F.lit("OK")),
        "ProcessName": image,
        "ProcessId": pid.cast("string"),
        "ParentProcessId": F.call_function("div", F.col("user_id"), F.lit(10)).cast("string"),
        "ImagePath": F.concat(F.lit("C:\\Apps\\"), image),
        "CommandLine": F.concat(image, F.lit(" --k "), k),
        "UserName": F.concat(F.lit("user"), user),
        "State": F.when(F.col("k") % 3 == 0, F.lit("")).otherwise(F.lit("Established")),
        "Opcode": F.when(F.col("k") % 2 == 0, F.lit("TcpSend")).otherwise(F.lit("UdpReceive")),
        "RecordId": F.col("event_id").cast("string"),
        "LogName": F.when(F.col("k") % 2 == 0, F.lit("Security")).otherwise(F.lit("System")),
    }
    fields = F.create_map(*[part for name, value in bag.items() for part in (F.lit(name), value)])
    first = F.struct(
        F.lit("EventLog").alias("source"),
        F.concat(F.lit("events:"), F.col("event_id").cast("string")).alias("reference"),
        F.lit(None).cast("string").alias("hash"),
        F.col("ts").alias("collected_at"),
    )
    second = F.struct(
        F.lit("EvtxFile").alias("source"),
        F.concat(F.lit("C:\\Logs\\u"), user, F.lit(".evtx")).alias("reference"),
        F.lit(None).cast("string").alias("hash"),
        F.col("ts").alias("collected_at"),
    )
    evidence = F.when(F.col("k") % 3 == 0, F.array(first, second)).otherwise(F.array(first))
    return to_events(
        ev,
        host=F.concat(F.lit("H"), (F.col("user_id") % 4).cast("string")),
        collection_id=F.lit("C0"),
        ingest_seq=F.col("event_id"),
        ts=F.col("ts"),
        category=_choose(CATEGORIES),
        action=normalize_action(raw) if normalize else raw,
        subject_process=keys.process_key(F.lit(4096) + F.col("user_id") % 4, pid, created),
        subject_user=keys.user_key(F.concat(F.lit("S-1-5-21-"), user)),
        object_file=F.when(kind == "purchase", keys.file_key(path=path)),
        object_flow=F.when(kind == "click", flow),
        object_url=F.when(kind == "view", F.concat(F.lit("https://site"), k, F.lit(".example/p"))),
        summary=F.concat(kind, F.lit(" by user "), user),
        fields=fields,
        evidence=evidence.cast(EVIDENCE),
    )


ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') || '0Z'"


def iso_sql(expression: str) -> str:
    return "(" + ISO.format(expression) + ")"


EV = f"""ev0 AS (
  SELECT event_id AS seq, ts, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k
  FROM events
), ev AS (
  SELECT seq, ts, user_id, event_type, cents, k, epoch_us(ts) AS us,
         'H' || (user_id % 4) AS host, {_case(CATEGORIES)} AS category, {_case(RAW_ACTIONS)} AS raw_action,
         {_case(VERBS)} AS action, user_id + 1 AS pid, 4096 + user_id % 4 AS boot_id,
         date_trunc('day', ts) AS created,
         'P:' || printf('%X', 4096 + user_id % 4) || ':' || (user_id + 1) || ':' || {iso_sql("date_trunc('day', ts)")} AS process_key,
         'S-1-5-21-' || user_id AS sid,
         CASE WHEN event_type = 'purchase' THEN 'C:\\Data\\u' || user_id || '\\f' || k || '.bin' END AS file_path,
         CASE WHEN event_type = 'click' THEN CASE WHEN k % 2 = 0 THEN 'TCP' ELSE 'UDP' END END AS protocol,
         CASE WHEN event_type = 'click' THEN '10.0.0.' || (user_id % 250) || ':' || (k + 1000) END AS local_ep,
         CASE WHEN event_type = 'click' THEN CASE WHEN k % 10 = 0 THEN '[2001:db8::' || k || ']:443'
              ELSE '93.184.216.' || k || ':443' END END AS remote_ep,
         CASE WHEN event_type = 'click' AND k % 7 <> 0 THEN user_id + 1 END AS flow_pid,
         CASE WHEN event_type = 'click' THEN date_trunc('hour', ts) END AS bucket,
         CASE WHEN event_type = 'view' THEN 'https://site' || k || '.example/p' END AS url,
         event_type || ' by user ' || user_id AS summary,
         CASE WHEN k % 10 = 0 THEN 'FAIL' ELSE 'OK' END AS result,
         'proc' || (user_id % 20) || '.exe' AS image, user_id // 10 AS parent_pid,
         CASE WHEN k % 3 = 0 THEN '' ELSE 'Established' END AS state,
         CASE WHEN k % 2 = 0 THEN 'TcpSend' ELSE 'UdpReceive' END AS opcode,
         CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS n_evidence
  FROM ev0
), evk AS (
  SELECT *, 'N:' || protocol || ':' || local_ep || '->' || remote_ep || ':' || coalesce(CAST(flow_pid AS VARCHAR), '')
         || ':' || {iso_sql("bucket")} AS flow_key,
         CASE WHEN file_path IS NOT NULL THEN 'F:' || file_path END AS file_key
  FROM ev
)"""


def with_ev(sql: str) -> str:
    return f"WITH {EV} {sql}"


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as network events: endpoints from supplier and part, size from quantity."""
    li = table(spark, sf_dir, "lineitem")
    ts = F.col("l_shipdate").cast("timestamp")
    local = F.concat(F.lit("10.1.0."), F.col("l_suppkey").cast("string"), F.lit(":445"))
    remote = F.concat(F.lit("172.16.0."), (F.col("l_partkey") % 50).cast("string"), F.lit(":80"))
    protocol = F.when(F.col("l_linestatus") == "O", F.lit("TCP")).otherwise(F.lit("UDP"))
    opcode = (
        F.when(F.col("l_returnflag") == "A", F.lit("Send"))
        .when(F.col("l_returnflag") == "R", F.lit("Recv"))
        .otherwise(F.lit("Other"))
    )
    fields = F.create_map(
        F.lit("Opcode"), opcode,
        F.lit("Size"), big(F.col("l_quantity")).cast("string"),
        F.lit("State"), F.col("l_linestatus"),
        F.lit("ProcessId"), F.col("l_suppkey").cast("string"),
    )
    pid = F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey"))
    return to_events(
        li,
        host=F.concat(F.lit("H"), (F.col("l_suppkey") % 4).cast("string")),
        collection_id=F.lit("C0"),
        ingest_seq=F.col("l_orderkey") * 8 + F.col("l_linenumber"),
        ts=ts,
        category=F.lit("Network"),
        action=normalize_action(F.when(F.col("l_returnflag") == "N", F.lit("listen")).otherwise(F.lit("close"))),
        object_flow=keys.flow_key(protocol, local, remote, pid, F.date_trunc("month", ts), bucketed=True),
        fields=fields,
    )


FL = """fl AS (
  SELECT 'H' || (l_suppkey % 4) AS host, l_orderkey * 8 + l_linenumber AS seq, l_shipdate AS ts, epoch_us(l_shipdate) AS us,
         CASE WHEN l_linestatus = 'O' THEN 'TCP' ELSE 'UDP' END AS protocol,
         '10.1.0.' || l_suppkey || ':445' AS local_ep, '172.16.0.' || (l_partkey % 50) || ':80' AS remote_ep,
         CASE WHEN l_suppkey % 5 <> 0 THEN l_suppkey END AS pid, date_trunc('month', l_shipdate) AS bucket,
         CASE l_returnflag WHEN 'N' THEN 'Connect' ELSE 'Stop' END AS action, l_linestatus AS state,
         CASE l_returnflag WHEN 'A' THEN 'Send' WHEN 'R' THEN 'Recv' ELSE 'Other' END AS opcode,
         CAST(l_quantity AS BIGINT) AS size, l_suppkey
  FROM lineitem
)"""


def with_fl(sql: str) -> str:
    return f"WITH {FL} {sql}"


def process_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as a process inventory: the parent of pid n is n div 10."""
    return table(spark, sf_dir, "customer").select(
        F.lit("H0").alias("host"),
        F.lit("C0").alias("collection_id"),
        F.concat(F.lit("P:"), F.col("c_custkey").cast("string")).alias("process_key"),
        F.col("c_custkey").alias("pid"),
        F.timestamp_seconds(F.col("c_custkey") + 1_600_000_000).alias("start_time"),
        F.col("c_custkey").alias("first_seq"),
        F.call_function("div", F.col("c_custkey"), F.lit(10)).alias("parent_pid"),
        F.concat(F.lower("c_mktsegment"), F.lit("-"), (F.col("c_custkey") % 7).cast("string")).alias("process_name"),
    )


PT = """pt AS (
  SELECT c_custkey AS pid, c_custkey // 10 AS parent_pid, lower(c_mktsegment) || '-' || (c_custkey % 7) AS process_name
  FROM customer
)"""


def le_binary(number: Column, size: int) -> Column:
    """Little-endian bytes of a non-negative number, for building artifact blobs."""
    return F.unhex(swap_hex(F.lpad(F.conv(number.cast("string"), 10, 16), 2 * size, "0")))


def joined_bytes(*parts: Column) -> Column:
    return F.unhex(F.concat(*[F.hex(p) for p in parts]))


def padded_utf16(text: Column, size: int) -> Column:
    """UTF-16LE text zero-padded to ``size`` bytes."""
    return F.unhex(F.rpad(F.hex(F.encode(text, "UTF-16LE")), 2 * size, "0"))


def ticks(ts: Column) -> Column:
    return us(ts) * 10 + times.FILETIME_UNIX_EPOCH
