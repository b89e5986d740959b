"""Caps with doubled numbers, keyed stream tables, processes by time."""

import pytest
from pyspark.sql import functions as F

from evidentia.operators import connections, ranking
from evidentia.operators.windows import cap_per_group
from evidentia.plans.base import flows
from evidentia.streaming import keyed

from .conftest import SMALL


@pytest.mark.parametrize("limit", [1000, 2])
def test_caps_do_not_depend_on_partitions(spark, monkeypatch, limit):
    monkeypatch.setattr(ranking, "NATIVE_LIMIT", limit)
    rows = spark.createDataFrame([(h, n, t, {"k": t}) for h in "AB" for n, t in zip([1, 1, 1, 1, 2, None, None], "gbdcaef")], "host string, ingest_seq long, name string, bag map<string,string>")
    for keep, per_host, overall in (
        (ranking.keep_newest, {"a", "b", "c"}, [("A", "a"), ("A", "b"), ("A", "c"), ("A", "d"), ("B", "a")]),
        (ranking.keep_first, {"b", "c", "d"}, [("A", "b"), ("A", "c"), ("A", "d"), ("A", "g"), ("B", "b")]),
    ):
        for n in (1, 3, 6):
            spread = rows.repartition(n)
            found = keep(spread, 3, keys=("host",)).collect()
            assert len(found) == 6 and all({r.name for r in found if r.host == h} == per_host for h in "AB")
            assert sorted((r.host, r.name) for r in keep(spread, 5).collect()) == overall
            assert {r.name for r in cap_per_group(spread.where("ingest_seq is not null"), ["host"], 2).collect()} == {"b", "c"}
            every = keep(spread, 11).collect()
            assert len(every) == 11 and sum(r.ingest_seq is None for r in every) == 1


def test_pages_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(ranking, "NATIVE_LIMIT", 3)
    rows = spark.range(40).select(F.lit(7).cast("long").alias("ingest_seq"), F.format_string("%02d", "id").alias("name")).repartition(5)
    pages = [[r.name for r in ranking.page(rows, [("ingest_seq", False)], at, 9).collect()] for at in range(0, 45, 9)]
    assert [x for p in pages for x in p] == [f"{i:02d}" for i in range(40)]


def test_keyed_tables_restart_and_repeat(spark, tmp_path):
    rows, path, folder = flows(spark, SMALL), str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(5):
        rows.where(F.pmod("ingest_seq", F.lit(5)) == part).write.mode("append").parquet(path)
        writer = keyed.traffic_table(spark.readStream.schema(rows.schema).parquet(path), folder, every=2)
        writer.trigger(availableNow=True).start().awaitTermination()
    read = lambda: keyed.read_keyed(spark, folder, keyed.TRAFFIC_KEYS, keyed.COUNTERS, True, every=2)
    want = sorted(map(tuple, connections.traffic_totals(rows).select(*keyed.TRAFFIC_KEYS, *keyed.COUNTERS).collect()), key=repr)
    assert sorted(map(tuple, read().collect()), key=repr) == want
    assert {f.split("/base/")[1].split("/")[0] for f in read().inputFiles() if "/base/" in f} == {"4"}


def test_hours_leave_the_state(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "out")
    rows = flows(spark, SMALL).withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.pmod("ingest_seq", F.lit(5)) * 86_400 + F.pmod(F.xxhash64("ingest_seq"), F.lit(7200))))
    held = []
    for part in range(5):
        rows.where(F.pmod("ingest_seq", F.lit(5)) == part).write.mode("append").parquet(path)
        query = keyed.hourly_table(spark.readStream.schema(rows.schema).parquet(path), folder, "2 hours").trigger(availableNow=True).start()
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    total = keyed.read_keyed(spark, folder, keyed.HOURLY_KEYS, ["event_count"], False).agg(F.sum("event_count"), F.count("*")).first()
    assert total[0] == rows.count() and max(held) < total[1] / 2, (held, total)


def test_process_by_time(spark):
    spans = [("H", 7, "2024-01-01 00:00:00", False, "one"), ("H", 7, "2024-01-01 02:00:00", True, "one"), ("H", 7, "2024-01-01 05:00:00", False, "two"), ("G", 7, "2024-01-01 00:00:00", False, "other"), ("H", None, "2024-01-01 00:00:00", False, "none")]
    began = spark.createDataFrame(spans, "host string, pid long, at string, ended boolean, process_name string").withColumn("at", F.to_timestamp("at")).withColumn("image_path", F.lit(""))
    times = {"2023-12-31 23:59:59": "", "2024-01-01 00:00:00": "one", "2024-01-01 01:59:59": "one", "2024-01-01 02:00:00": "", "2024-01-01 04:00:00": "", "2024-01-01 05:00:00": "two", "2024-03-01 00:00:00": "two"}
    rows = spark.createDataFrame([("H", 7, t) for t in times] + [("H", None, "2024-01-01 01:00:00"), ("X", 7, "2024-01-01 01:00:00")], "host string, pid long, t string").withColumn("create_time", F.to_timestamp("t"))
    found = {(r.host, r.pid, r.t): r.process_name for r in connections.with_process_then(rows, began).collect()}
    assert found == {**{("H", 7, t): n for t, n in times.items()}, ("H", None, "2024-01-01 01:00:00"): "", ("X", 7, "2024-01-01 01:00:00"): ""}


@pytest.mark.parametrize("width", [1, 3, 4096])
def test_process_transitions_over_chunks(spark, width):
    """Runs that break off, create times that are read late, pids that are used again."""
    import random

    from evidentia.operators.transitions import process_transitions

    r, rows = random.Random(width), []
    for pid in (1, 2, 3, None):
        create = None
        for n in range(1, 40):
            if r.random() < 0.25:
                create = None
                continue
            if r.random() < 0.3:
                create = 100 + n
            rows.append(("H", n, 1000 + n, pid, create if r.random() < 0.7 else None))
    frame = spark.createDataFrame(rows, "host string, snapshot_id long, t long, pid long, c long").select(
        "host", "snapshot_id", F.timestamp_seconds("t").alias("snapshot_ts"), "pid", F.timestamp_seconds("c").alias("create_time")
    )
    found = process_transitions(frame, width).select("pid", "snapshot_id", "action", F.unix_seconds("create_time").alias("c"))
    want = []
    for pid in (1, 2, 3):
        mine, effective, last = {n: (t, c) for _, n, t, p, c in rows if p == pid}, {}, None
        for n in range(1, 40):
            if n in mine:
                last = mine[n][1] if mine[n][1] is not None else (last if n - 1 in mine else None) or mine[n][0]
                effective[n] = last
        snapshots = {n for _, n, *_ in rows}
        for n in sorted(snapshots):
            now, before = effective.get(n), effective.get(n - 1)
            if now != before:
                want += [(pid, n, "Stop", before)] if before is not None else []
                want += [(pid, n, "Start", now)] if now is not None else []
    assert sorted((x.pid, x.snapshot_id, x.action, x.c) for x in found.where("pid is not null").collect()) == sorted(want)
