"""Connection inventory, traffic totals and process enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bags import field, parse_pid
from ..functions.endpoints import address_family, connection_state, endpoint_address, endpoint_port
from ..functions.text import strip
from ..session import cut_lineage
from .asof import running_max
from .filters import matches_text
from .processes import latest_per_key, module_name
from .ranking import last_by, null_safe_join

FLOW = ("protocol", "local_ep", "remote_ep", "pid", "time_bucket")


def _flow_columns() -> list[Column]:
    return [F.col(f"object_flow.{c}").alias(c) for c in FLOW]


def network_events(events: DataFrame) -> DataFrame:
    return events.where((F.lower("category") == "network") & F.col("object_flow").isNotNull())


def connection_summary(events: DataFrame) -> DataFrame:
    """Per flow: first and last time, state of the last event, event count."""
    return _summarised(network_events(events), {})


def _summarised(events: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """Network events as one row a flow, with further sums over them."""
    rows = events.select(
        "host",
        *_flow_columns(),
        connection_state(field(F.col("fields"), "State"), F.col("action")).alias("_state"),
        "ts",
        "ingest_seq",
        *([] if not counters else ["_sent", "_received", "_size"]),
    )
    grouped = (
        rows.groupBy("host", *FLOW)
        .agg(
            F.min("ts").alias("create_time"),
            F.max("ts").alias("last_seen"),
            F.count("*").alias("event_count"),
            last_by(F.col("_state"), F.col("ts"), -F.col("ingest_seq")).alias("state"),
            *[v.alias(c) for c, v in counters.items()],
        )
    )
    return grouped.select(
        "host",
        *FLOW,
        "state",
        endpoint_address(F.col("local_ep")).alias("local_address"),
        endpoint_port(F.col("local_ep")).alias("local_port"),
        endpoint_address(F.col("remote_ep")).alias("remote_address"),
        endpoint_port(F.col("remote_ep")).alias("remote_port"),
        "create_time",
        "last_seen",
        "event_count",
        *counters,
    )


def network_view(events: DataFrame) -> DataFrame:
    """Per flow: state of the first-arrived Connect, pid from the key or the latest event that has one."""
    bag = F.col("fields")
    # Values first, so that the aggregation parses each of them once.
    rows = events.where(F.col("object_flow").isNotNull()).select(
        "host",
        *_flow_columns(),
        (F.lower("category") == "network").alias("_listed"),
        F.when(F.col("action") == "Connect", F.col("ingest_seq")).alias("_connect_seq"),
        field(bag, "State").alias("_state"),
        parse_pid(field(bag, "ProcessId")).alias("_own_pid"),
        "ts",
        "ingest_seq",
    )
    has_pid = F.col("_own_pid").isNotNull()
    grouped = (
        rows.groupBy("host", *FLOW)
        .agg(
            F.bool_or("_listed").alias("_listed"),
            F.min_by("_state", "_connect_seq").alias("state"),
            last_by(F.col("_own_pid"), F.col("ts"), -F.col("ingest_seq"), where=has_pid).alias("_pid"),
            F.count("*").alias("event_count"),
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
        )
        .where("_listed")
    )
    return grouped.select(
        "host",
        "protocol",
        "local_ep",
        "remote_ep",
        F.col("pid").alias("flow_pid"),
        "time_bucket",
        F.coalesce(F.col("pid"), F.col("_pid")).alias("process_id"),
        F.coalesce(F.col("state"), F.lit("Unknown")).alias("state"),
        "event_count",
        "first_seen",
        "last_seen",
    )


def transfer_size(fields: Column) -> Column:
    """TransferSize, else Size, else 0."""
    sizes = [
        F.when(strip(field(fields, n)).rlike(r"^[+-]?\d{1,18}$"), strip(field(fields, n)).try_cast("bigint"))
        for n in ("TransferSize", "Size")
    ]
    return F.coalesce(*sizes, F.lit(0).cast("bigint"))


def traffic_totals(events: DataFrame, opcode: str = "Opcode") -> DataFrame:
    """Sent and received bytes and packets per connection; the hour bucket is not part of the key."""
    bag = F.col("fields")
    code = F.lower(field(bag, opcode))
    sent = F.coalesce(F.contains(code, F.lit("send")), F.lit(False))
    received = ~sent & F.coalesce(
        F.contains(code, F.lit("recv")) | F.contains(code, F.lit("receive")), F.lit(False)
    )
    size = transfer_size(bag)
    return (
        network_events(events)
        .where(sent | received)
        .groupBy(
            "host",
            F.col("object_flow.protocol").alias("protocol"),
            F.col("object_flow.local_ep").alias("local_ep"),
            F.col("object_flow.remote_ep").alias("remote_ep"),
            F.coalesce(F.col("object_flow.pid"), F.lit(0)).alias("pid"),
        )
        .agg(
            F.sum(F.when(sent, size).otherwise(0)).alias("sent_bytes"),
            F.sum(F.when(received, size).otherwise(0)).alias("recv_bytes"),
            F.count_if(sent).alias("sent_packets"),
            F.count_if(received).alias("recv_packets"),
        )
    )


def connections_with_traffic(events: DataFrame, opcode: str = "Opcode") -> DataFrame:
    """:func:`connection_summary` with the totals of :func:`traffic_totals`, from one scan and one shuffle of the events.

    Bytes and packets are summed per flow and hour with the summary; a connection's
    totals are then sums over its hours, one row each.
    """
    bag = F.col("fields")
    code, size = F.lower(field(bag, opcode)), transfer_size(bag)
    sent = F.coalesce(F.contains(code, F.lit("send")), F.lit(False))
    received = ~sent & F.coalesce(F.contains(code, F.lit("recv")) | F.contains(code, F.lit("receive")), F.lit(False))
    counters = {
        "sent_bytes": F.sum(F.when(F.col("_sent"), F.col("_size")).otherwise(0)),
        "recv_bytes": F.sum(F.when(F.col("_received"), F.col("_size")).otherwise(0)),
        "sent_packets": F.count_if("_sent"),
        "recv_packets": F.count_if("_received"),
    }
    hours = _summarised(network_events(events).withColumns({"_sent": sent, "_received": received, "_size": size}), counters)
    whole = Window.partitionBy("host", "protocol", "local_ep", "remote_ep", F.coalesce("pid", F.lit(0)))
    return hours.withColumns({c: F.sum(c).over(whole).cast("bigint") for c in counters})


def with_traffic(connections: DataFrame, totals: DataFrame) -> DataFrame:
    """Attach totals; they repeat on every hour bucket of a connection and must not be summed again."""
    counters = ["sent_bytes", "recv_bytes", "sent_packets", "recv_packets"]
    keys = ["host", "protocol", "local_ep", "remote_ep"]
    keyed = connections.withColumn("_pid", F.coalesce(F.col("pid"), F.lit(0)))
    joined = keyed.join(totals.withColumnRenamed("pid", "_pid"), [*keys, "_pid"], "left")
    return joined.select(
        *[keyed[c] for c in connections.columns],
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counters],
    )


def process_names(events: DataFrame) -> DataFrame:
    """Latest name and image per pid from Process events."""
    bag = F.col("fields")
    rows = events.where(
        (F.lower("category") == "process") & F.col("subject_process").isNotNull()
    ).select(
        "host",
        F.col("subject_process.pid").alias("pid"),
        F.coalesce(field(bag, "ProcessName"), F.lit("")).alias("process_name"),
        F.coalesce(field(bag, "ImagePath"), F.lit("")).alias("image_path"),
        "ts",
        "ingest_seq",
    )
    return latest_per_key(rows, ["host", "pid"], "ts", ["process_name", "image_path"])


def with_process(connections: DataFrame, names: DataFrame) -> DataFrame:
    """Name and image by pid alone, as the live view shows it (pid reuse is ignored)."""
    joined = null_safe_join(connections, names.where(F.col("pid").isNotNull()), ["host", "pid"], "left")
    named = joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit("")) for c in ("process_name", "image_path")}
    )
    return named.withColumn("module_name", module_name(F.col("image_path"), F.col("process_name")))


def process_spans(events: DataFrame) -> DataFrame:
    """When processes began and ended: ``at``, ``ended``, name and image per host, collection and pid, from Process events."""
    bag, action = F.col("fields"), F.col("action")
    return events.where((F.lower("category") == "process") & F.col("subject_process").isNotNull() & action.isin("Start", "Stop")).select(
        "host",
        "collection_id",
        F.col("subject_process.pid").alias("pid"),
        F.when(action == "Stop", F.col("ts")).otherwise(F.col("subject_process.create_time")).alias("at"),
        (action == "Stop").alias("ended"),
        F.coalesce(field(bag, "ProcessName"), F.lit("")).alias("process_name"),
        F.coalesce(field(bag, "ImagePath"), F.lit("")).alias("image_path"),
    )


def with_process_then(connections: DataFrame, spans: DataFrame, at: str = "create_time", chunk_seconds: int = 3600) -> DataFrame:
    """Name and image of the process that had the pid at the time ``at`` of each connection; blank if none lived.

    Connections and process spans form one sequence per host, collection (if the
    connections have one) and pid; the last span up to a connection is the
    running maximum along it, taken within hours and carried over them, so a pid
    with any share of the rows is spread over its hours. A start counts at its own
    instant, and before a stop of that instant.
    """
    keys = [k for k in ("host", "collection_id", "pid") if k in connections.columns]
    # At one instant: ends first, then starts, then connections.
    place = lambda ts, kind: F.unix_micros(ts) * 4 + kind
    begun = spans.where("pid is not null and at is not null").select(
        *keys, place(F.col("at"), F.when(F.col("ended"), 0).otherwise(1)).alias("_place"), "ended", "process_name", "image_path"
    )
    life = F.struct(F.col("_place").alias("place"), "ended", "process_name", "image_path")
    rows = connections.withColumn("_row", F.struct(*connections.columns)).select(*keys, place(F.col(at), F.lit(2)).alias("_place"), "_row", F.lit(None).cast("struct<place:bigint,ended:boolean,process_name:string,image_path:string>").alias("_span"))
    both = rows.unionByName(begun.select(*keys, "_place", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), life.alias("_span")))
    both = cut_lineage(both.withColumn("_chunk", F.call_function("div", F.col("_place"), F.lit(chunk_seconds * 4_000_000))))
    walked = running_max(both, keys, "_place", "_chunk", {"_last": F.col("_span")}).where("_row is not null")
    lives = F.col("_last").isNotNull() & ~F.col("_last.ended")
    named = {c: F.when(lives, F.col(f"_last.{c}")).otherwise("") for c in ("process_name", "image_path")}
    out = walked.select("_row.*", *[v.alias(c) for c, v in named.items()])
    return out.withColumn("module_name", module_name(F.col("image_path"), F.col("process_name")))


def family_filter(
    connections: DataFrame, tcp_v4: bool = True, tcp_v6: bool = True, udp_v4: bool = True, udp_v6: bool = True
) -> DataFrame:
    """Protocol and family toggles; other protocols and families always stay."""
    protocol, family = F.upper("protocol"), address_family(F.col("local_ep"))
    shown = F.lit(True)
    toggles = {("TCP", "v4"): tcp_v4, ("TCP", "v6"): tcp_v6, ("UDP", "v4"): udp_v4, ("UDP", "v6"): udp_v6}
    for (name, kind), enabled in toggles.items():
        if not enabled:
            shown = shown & ~((protocol == name) & (family == kind))
    return connections.where(shown)


def state_filter(connections: DataFrame, states: list[str]) -> DataFrame:
    return connections.where(F.col("state").isin(states)) if states else connections


TEXT_COLUMNS = [
    "protocol",
    "local_address",
    "remote_address",
    "local_port",
    "remote_port",
    "process_name",
    "image_path",
    "module_name",
    "pid",
    "state",
]


def text_filter(connections: DataFrame, text: str) -> DataFrame:
    if not text.strip():
        return connections
    present = [F.col(c).cast("string") for c in TEXT_COLUMNS if c in connections.columns]
    return connections.where(matches_text(text, present))


def most_recent_first(connections: DataFrame) -> DataFrame:
    return connections.orderBy(F.col("last_seen").desc())
