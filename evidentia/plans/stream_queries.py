"""Streams over the given tables: each feed is staged as files and read to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..schema import EVENT_SCHEMA
from ..session import staging_path
from ..sources.live import read_event_stream, read_record_stream
from ..streaming import ingest, keyed, stateful, throttle
from .base import EV, FL, activity, big, flows, query, us, with_ev
from .correlation_queries import ANCHORED_LIMITS, ANCHORED_SQL, _SNAPS, _WALK, _connection_snapshots, _pid_events, anchored_feed
from .view_queries import _TRAFFIC

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _seq():
    return F.col("ingest_seq").alias("seq")


def _feed(spark, rows):
    """Stage rows as files and open them as a stream of the same schema."""
    path = staging_path(spark, "feed")
    rows.write.parquet(path)
    return read_record_stream(spark, "parquet", rows.schema, path=path)


def _drain(spark, stream, mode="append"):
    """Run a stream over all its input and return what it wrote."""
    out = staging_path(spark, "drained")
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", out + "-log")
    if mode == "append":
        writer.format("parquet").start(out).awaitTermination()
    else:
        writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.parquet(out)


def _deliver(spark, rows, writer, deliveries=3):
    """Events arrive in deliveries; after each a stream takes up where the last one ended."""
    path = staging_path(spark, "feed")
    for part in range(deliveries):
        rows.where(F.pmod("ingest_seq", F.lit(deliveries)) == part).write.mode("append").parquet(path)
        writer(read_event_stream(spark, path)).trigger(availableNow=True).start().awaitTermination()


def _stateful(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


@query(
    "st_dedup",
    with_ev("SELECT category, count(*)::BIGINT AS n FROM ev GROUP BY category"),
)
def st_dedup(spark, sf):
    """Every event arrives twice; one of each stays."""
    once = activity(spark, sf).select(*EVENT_SCHEMA.names)
    path = staging_path(spark, "feed")
    once.unionByName(once).write.parquet(path)
    kept = ingest.deduplicate(read_event_stream(spark, path), "40 days")
    return _drain(spark, kept.select("category", "ingest_seq")).groupBy("category").agg(F.count("*").alias("n"))


@query("st_traffic", f"WITH {FL}, {_TRAFFIC} SELECT * FROM tr")
def st_traffic(spark, sf):
    folder = staging_path(spark, "totals")
    _deliver(spark, flows(spark, sf), lambda stream: keyed.traffic_table(stream, folder, every=2))
    return keyed.read_keyed(spark, folder, keyed.TRAFFIC_KEYS, keyed.COUNTERS, True, every=2).select(
        "host", "protocol", "local_ep", "remote_ep", "pid", big(F.col("sent_bytes")).alias("sent_bytes"),
        big(F.col("recv_bytes")).alias("recv_bytes"), "sent_packets", "recv_packets",
    )


@query(
    "st_hourly_flows",
    with_ev("""SELECT host, epoch_us(bucket) AS bucket_us, protocol, local_ep, remote_ep, flow_pid AS pid, count(*)::BIGINT AS event_count FROM ev
      WHERE protocol IS NOT NULL GROUP BY ALL"""),
)
def st_hourly_flows(spark, sf):
    folder = staging_path(spark, "hours")
    _deliver(spark, activity(spark, sf), lambda stream: keyed.hourly_table(stream, folder, "40 days"))
    return keyed.read_keyed(spark, folder, keyed.HOURLY_KEYS, ["event_count"], False).select(
        "host", us(F.col("time_bucket")).alias("bucket_us"), "protocol", "local_ep", "remote_ep", "pid", "event_count"
    )


@query(
    "st_completeness",
    with_ev("SELECT host, count(*)::BIGINT AS event_count, CASE WHEN count(*) >= 90 THEN 1 ELSE 0 END::BIGINT AS level FROM ev GROUP BY host"),
)
def st_completeness(spark, sf):
    path, out = staging_path(spark, "feed"), staging_path(spark, "levels")
    activity(spark, sf).write.parquet(path)
    files = spark.read.parquet(path).select(F.input_file_name().alias("file")).distinct().count()
    third = max(-(-files // 3), 1)  # three batches, whatever the number of files
    append = lambda rows, batch_id: rows.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)
    (
        ingest.running_levels(read_event_stream(spark, path, max_files=third), 100)
        .writeStream.outputMode("update").foreachBatch(append)
        .option("checkpointLocation", out + "-log")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    last = F.max_by(F.struct("event_count", F.col("status.level").alias("level")), "batch_id").alias("last")
    rows = spark.read.parquet(out).groupBy("host").agg(last)
    return rows.select("host", "last.event_count", big(F.col("last.level")).alias("level"))


@query("st_throttle", ANCHORED_SQL)
def st_throttle(spark, sf):
    """Three deliveries, each read by a restarted stream; the same rows as of the batch operator."""
    rows, folder, path = anchored_feed(spark, sf), staging_path(spark, "throttled"), staging_path(spark, "feed")
    last = rows.agg(F.max("ingest_seq")).first()[0] or 0
    for part in range(3):
        rows.where(F.col("ingest_seq").between(last * part // 3 + (part > 0), last * (part + 1) // 3)).write.mode("append").parquet(path)
        stream = read_record_stream(spark, "parquet", rows.schema, path=path)
        throttle.throttle_stream(stream, folder, ANCHORED_LIMITS).trigger(availableNow=True).start().awaitTermination()
    return throttle.read_throttled(spark, folder).select(_seq(), "category", "kind", "dropped")


@query("st_process_key", f"WITH RECURSIVE {EV}, {_WALK} SELECT pid, seq, created AS created_us, how AS resolution FROM w")
def st_process_key(spark, sf):
    _stateful(spark)
    rows = _pid_events(spark, sf).withColumn("collection_id", F.lit("C0"))
    resolved = stateful.process_key_stream(_feed(spark, rows), lateness="400 days")
    return _drain(spark, resolved).select("pid", _seq(), F.col("create_us").alias("created_us"), "resolution")


def _with_absences(rows, item, value):
    """One row per sighting, and an unseen row at the snapshot after the last of a run."""
    seen = rows.select("host", item.cast("string").alias("item"), "snapshot_id", value.cast("string").alias("value"), F.lit(True).alias("seen"))
    calendar = rows.select("host", "snapshot_id").distinct()
    after = seen.select("host", "item", (F.col("snapshot_id") + 1).alias("snapshot_id"))
    gone = after.join(calendar, ["host", "snapshot_id"], "left_semi").join(seen, ["host", "item", "snapshot_id"], "left_anti")
    return seen.unionByName(gone.select("host", "item", "snapshot_id", F.lit(None).cast("string").alias("value"), F.lit(False).alias("seen")))


@query(
    "st_connection_state",
    f"""WITH {_SNAPS}, j AS (SELECT coalesce(c.host, p.host) AS host, coalesce(c.pid, p.pid) AS pid, coalesce(c.n, p.n + 1) AS n, c.state AS cs, p.state AS ps FROM x c FULL JOIN x p ON c.host = p.host AND c.pid = p.pid AND c.n = p.n + 1),
       k AS (SELECT j.* FROM j JOIN cal ON j.host = cal.host AND j.n = cal.n)
       SELECT host, pid::VARCHAR AS item, n::BIGINT AS snapshot_id, CASE WHEN ps IS NULL THEN 'Connect' WHEN cs IS NULL THEN 'Disconnect' ELSE 'Update' END AS action, coalesce(cs, ps) AS value
       FROM k WHERE cs IS DISTINCT FROM ps""",
)
def st_connection_state(spark, sf):
    _stateful(spark)
    rows = _with_absences(_connection_snapshots(spark, sf), F.col("pid"), F.col("state"))
    changes = stateful.connection_state_stream(_feed(spark, rows))
    return _drain(spark, changes).select("host", "item", "snapshot_id", "action", "value")


@query(
    "st_process_state",
    f"""WITH {_SNAPS}, y AS (SELECT host, pid, n, 1000 * ascii(state) + pid AS ct FROM x),
       j AS (SELECT coalesce(c.host, p.host) AS host, coalesce(c.pid, p.pid) AS pid, coalesce(c.n, p.n + 1) AS n, c.ct AS now, p.ct AS before FROM y c FULL JOIN y p ON c.host = p.host AND c.pid = p.pid AND c.n = p.n + 1),
       k AS (SELECT j.* FROM j JOIN cal ON j.host = cal.host AND j.n = cal.n WHERE now IS DISTINCT FROM before)
       SELECT host, pid::VARCHAR AS item, n::BIGINT AS snapshot_id, 'Start' AS action, now::VARCHAR AS value FROM k WHERE now IS NOT NULL
       UNION ALL SELECT host, pid::VARCHAR, n::BIGINT, 'Stop', before::VARCHAR FROM k WHERE before IS NOT NULL""",
)
def st_process_state(spark, sf):
    _stateful(spark)
    rows = _connection_snapshots(spark, sf)
    listed = _with_absences(rows, F.col("pid"), F.lit(1000) * F.ascii("state") + F.col("pid"))
    changes = stateful.process_state_stream(_feed(spark, listed))
    return _drain(spark, changes).select("host", "item", "snapshot_id", "action", "value")
