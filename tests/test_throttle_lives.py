"""Anchored windows against the walk, and the process-key stream's state."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import asof, throttle
from evidentia.streaming import stateful, throttle as streamed


def walk(rows, limits, interval=5_000_000):
    """The rule itself, one event after another."""
    out, state = [], {}
    for host, category, seq, us in sorted(rows, key=lambda r: r[2]):
        limit = limits.get(category, 0)
        if limit <= 0:
            out.append((host, category, seq, "pass", None))
            continue
        start, count, dropped, reported = state.get((host, category), (None, 0, 0, None))
        if start is None or us - start >= 1_000_000:
            if dropped > 0 and (reported is None or us - reported >= interval):
                out.append((host, category, seq, "warning", dropped))
                reported, dropped = us, 0
            start, count = us, 1
        else:
            count += 1
        if count <= limit:
            out.append((host, category, seq, "pass", None))
        else:
            dropped += 1
        state[host, category] = start, count, dropped, reported
    return sorted(out, key=repr)


def events(seed, n, step):
    """Bursts and silences; some times lie back; one category has most of the rows; one host is unnamed."""
    r, us, out = random.Random(seed), 1_700_000_000_000_000, []
    for i in range(n):
        us += r.choice([0, step, step * 3]) if r.random() < 0.98 else r.choice([900_000, 1_000_000, 20_000_000, 3_600_000_000])
        host = r.choice(["A", "A", "A", None])
        category = r.choice(["File", "File", "File", "Network", "Free"])
        out.append((host, category, 2 * i, us - (r.choice([100_000, 1_500_000]) if r.random() < 0.1 else 0)))
    return out


SCHEMA = "host string, category string, ingest_seq long, us long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("us")).drop("us")


def result(rows):
    return sorted(((r.host, r.category, r.ingest_seq, r.kind, r.dropped) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("seed,step,width,chunk", [(1, 120_000, 4_000_000, 64), (2, 30_000, 16_000_000, 1 << 20), (3, 400_000, 1_000_000, 7)])
def test_anchored_windows_follow_the_walk(spark, seed, step, width, chunk):
    rows = events(seed, 900, step)
    limits = {"File": 3, "Network": 1}
    kept, state = throttle.throttled(frame(spark, rows), limits, width=width, chunk_width=chunk)
    assert result(kept) == walk(rows, limits)
    assert state.count() == len({(h, c) for h, c, *_ in rows if c != "Free"})


def test_anchored_windows_in_batches(spark, tmp_path):
    rows, limits = events(4, 600, 150_000), {"File": 2, "Network": 2}
    folder, path = str(tmp_path / "out"), str(tmp_path / "in")
    for part in range(3):
        frame(spark, rows[part * 200 : (part + 1) * 200]).write.mode("append").parquet(path)
        stream = spark.readStream.schema("host string, category string, ingest_seq long, ts timestamp").parquet(path)
        streamed.throttle_stream(stream, folder, limits).trigger(availableNow=True).start().awaitTermination()
    assert result(streamed.read_throttled(spark, folder)) == walk(rows, limits)


def test_anchored_windows_of_nothing(spark):
    kept, state = throttle.throttled(frame(spark, []), {"File": 1})
    assert kept.count() == 0 and state.count() == 0
    only = [("A", "Free", 1, 5)]
    assert result(throttle.throttled(frame(spark, only), {"File": 1})[0]) == walk(only, {"File": 1})


MINUTE = 60_000_000


def lives():
    """Two collections of one host with equal pids and numbers; pids 100.. are seen once, pid 7 goes on."""
    out, base = [], 1_700_000_000_000_000
    for day in range(3):
        for i in range(40):
            us = base + day * 1440 * MINUTE + i * 20 * MINUTE
            for collection, shift in (("C0", 0), ("C1", 7 * MINUTE)):
                pid = 7 if i % 2 else 100 + day * 100 + i
                out.append(("H", collection, pid, day * 40 + i, us + shift, us - MINUTE if pid != 7 and i % 4 == 0 else None, i == 30, False))
    return out


def test_idle_pids_leave_the_state(spark, tmp_path):
    schema = "host string, collection_id string, pid long, ingest_seq long, us long, hint long, is_stop boolean, is_long_lived boolean"
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame(lives(), schema).select(
        "host", "collection_id", "pid", "ingest_seq", F.timestamp_micros("us").alias("ts"), F.timestamp_micros("hint").alias("create_hint"), "is_stop", "is_long_lived"
    )
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    held = []
    for day in range(3):
        rows.where(F.expr(f"ingest_seq div 40 = {day}")).write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        resolved = stateful.process_key_stream(stream, (30, 120, 10_080), lateness="1 hour")
        query = resolved.writeStream.format("parquet").option("checkpointLocation", out + "-log").trigger(availableNow=True).start(out)
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    want = asof.resolve_process_keys(rows, (30, 120, 10_080))
    columns = ["host", "collection_id", "pid", "ingest_seq", "created", "resolution"]
    walked = want.select(*columns[:4], F.unix_micros("process_create_time").alias("created"), "resolution")
    streamed_rows = spark.read.parquet(out).withColumnRenamed("create_us", "created").select(*columns)
    assert sorted(map(tuple, streamed_rows.collect())) == sorted(map(tuple, walked.collect()))
    assert len({(r[1], r[2]) for r in lives()}) > 100 and max(held) < 20, held
