"""Findings of the round on growth: how rows are dealt, parsed, sorted and held."""

import glob
import os
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from evidentia.functions import blobs
from evidentia.operators import throttle
from evidentia.plans import base, catalog, source_queries, stream_queries, view_queries
from evidentia.sinks import bundle
from evidentia.sources import eventlog
from evidentia.streaming import stateful
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from .conftest import SMALL

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="table set not present")


def test_f18_f23_f28_wide_rows_are_compiled_and_dealt(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    plan = catalog.queries()["src_published_case"](spark, SMALL)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000" and plan.count() > 0
    assert base.activity(spark, SMALL).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_f12_feed_is_dealt_over_all_cores(spark, monkeypatch):
    paths = {}
    staged = stream_queries.staging_path
    monkeypatch.setattr(stream_queries, "staging_path", lambda s, name: paths.setdefault(name, staged(s, name)))
    rows = catalog.queries()["st_completeness"](spark, SMALL).collect()
    assert sum(r["event_count"] for r in rows) == base.raw_events(spark, SMALL).count()
    assert len(glob.glob(paths["feed"] + "/*.parquet")) > 3
    assert spark.read.parquet(paths["levels"]).select("batch_id").distinct().count() == 3


def test_f17_a_record_is_parsed_once(spark):
    records = source_queries._several_collections(source_queries._log_records(spark, SMALL))
    plan = eventlog.read_event_log(records, F.lit(7))._jdf.queryExecution().optimizedPlan().toString()
    assert "from_xml" not in plan


def test_f20_parts_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    key, seen, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.json
    before = spark.conf.get(key)
    monkeypatch.setattr(DataFrameWriter, "json", lambda self, *a, **k: (seen.append(spark.conf.get(key)), write(self, *a, **k))[1])
    bundle.write_timeline_parts(base.activity(spark, SMALL), str(tmp_path / "parts"), 4)
    assert seen == [str(bundle.OPEN_FILES)] and spark.conf.get(key) == before
    assert spark.read.json(str(tmp_path / "parts")).count() == base.raw_events(spark, SMALL).count()


def test_f21_join_carries_only_what_is_asked(spark, monkeypatch):
    seen, joined = [], view_queries.connections.with_process_then
    monkeypatch.setattr(view_queries.connections, "with_process_then", lambda rows, spans: (seen.append(rows), joined(rows, spans))[1])
    catalog.queries()["jn_conn_process_then"](spark, SMALL)
    assert "SortAggregate" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_f25_blobs_are_split_a_slice_at_a_time():
    entry = "C:\\Apps\\a.exe".encode("utf-16-le").ljust(520, b"\0") + (133_000_000_000_000_000).to_bytes(8, "little") * 2 + bytes(16)
    rows = pd.Series([bytes(128) + entry * 2, None, b"", b"x" * 2000] * 1500, index=range(7, 6007))
    tracemalloc.start()
    got = blobs.shim_cache_entries.func(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(e) for e in got[:4]] == [2, 0, 0, 0] and list(got.index) == list(rows.index)
    assert list(got) == list(blobs._entry_lists(rows)) and peak < 80 << 20
    items = blobs.shell_items.func(rows)
    assert len(items) == len(rows) and items.astype(object).where(items.notna(), None).values.tolist() == (
        lambda t: t.astype(object).where(t.notna(), None).values.tolist())(blobs.shell_item_table(rows))


def test_f15_slots_are_taken_by_the_stretch_and_pointers_once(spark, monkeypatch):
    seen, reached = [], throttle._reached
    monkeypatch.setattr(throttle, "_reached", lambda pointers, keys: (seen.append(pointers), reached(pointers, keys))[1])
    rows = spark.range(400).select(
        F.lit("A").alias("host"), F.lit("File").alias("category"), F.col("id").alias("ingest_seq"), F.timestamp_micros(F.col("id") * 300_000).alias("ts")
    )
    kept, _ = throttle.throttled(rows, {"File": 2}, width=4_000_000)
    passed = [r["ingest_seq"] for r in kept.where("kind = 'pass'").collect()]
    assert sorted(passed) == [n for n in range(400) if n % 4 < 2]
    assert "FlatMapGroupsInPandas" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    slots = spark.createDataFrame([("A", 4 * s, s, None if s % 2 else s) for s in range(70)], "host string, slot bigint, at bigint, left bigint")
    out = throttle._by_slot(slots, ["host"], 4, lambda slot, r: {"n": np.array([len(r["at"])]), "left": r["left"]}, {"n": "bigint", "left": "bigint"})
    assert sorted(r["left"] for r in out.collect() if r["left"] is not None) == list(range(0, 70, 2)) and {r["n"] for r in out.collect()} == {1}


def test_f24_a_life_is_read_once_and_rows_may_come_in_parts():
    class State:
        calls, value = 0, None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.value = value

    minute, keys = 60_000_000, stateful.ProcessKeys((30, 120, 10_080))
    keys.state, keys.handle = State(), SimpleNamespace(registerTimer=lambda t: None, deleteTimer=lambda t: None)
    part = lambda *rows: pd.DataFrame(rows, columns=stateful.PROCESS_KEY_INPUT).assign(host="H", collection_id="C", pid=7)
    late = part((3, 200 * minute, float("nan"), False, False), (1, 10 * minute, float("nan"), False, False))
    (out,) = keys.handleInputRows(("H", "C", 7), iter([late, part((2, 20 * minute, 5.0 * minute, False, False))]), None)
    assert out[["ingest_seq", "create_us", "resolution"]].values.tolist() == [
        [1, 10 * minute, "provisional"], [2, 5 * minute, "explicit"], [3, 200 * minute, "provisional"]]
    assert keys.state.calls == 1 and keys.state.value[:3] == (200 * minute, 200 * minute, "provisional")
