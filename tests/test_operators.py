"""Operators against brute force on small random inputs, with the scale paths forced."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import asof, cross_source, enrich, integrity, mft_paths, ranking, sets, transitions, trust, windows, wmi
from evidentia.streaming import stateful
from evidentia.session import staging_path
from evidentia.sources.live import read_record_stream


@pytest.fixture
def narrow(monkeypatch):
    """Tiny histogram and native limits, so that every refinement step runs."""
    monkeypatch.setattr(ranking, "BUCKETS", 3)
    monkeypatch.setattr(ranking, "NATIVE_LIMIT", 2)


@pytest.mark.parametrize("descending", [False, True])
def test_kth_value(spark, narrow, descending):
    rng = random.Random(1)
    values = [rng.choice([5, 5, 5, 7, -3, rng.randrange(1_000_000)]) for _ in range(200)]
    frame = spark.createDataFrame([(v,) for v in values], "v bigint")
    ordered = sorted(values, reverse=descending)
    for k in (1, 2, 50, 137, 200):
        value, left = ranking.kth_value(frame, "v", k, descending)
        assert value == ordered[k - 1]
        assert left == k - sum(1 for v in ordered if (v > value if descending else v < value))
    assert ranking.kth_value(frame, "v", 201) is None


@pytest.mark.parametrize("offset,limit", [(0, 3), (10, 20), (95, 10), (100, 5), (5, 0)])
def test_page(spark, narrow, offset, limit):
    rng = random.Random(2)
    rows = [(rng.randrange(4), i) for i in range(100)]
    frame = spark.createDataFrame(rows, "t bigint, seq bigint")
    got = [tuple(r) for r in ranking.page(frame, [("t", True), ("seq", False)], offset, limit).collect()]
    assert got == sorted(rows, key=lambda r: (-r[0], r[1]))[offset : offset + limit]


def test_caps(spark, narrow):
    frame = spark.createDataFrame([(i * 3,) for i in range(50)], "ingest_seq bigint")
    assert [r[0] for r in ranking.keep_first(frame, 7).orderBy("ingest_seq").collect()] == [i * 3 for i in range(7)]
    assert ranking.keep_newest(frame, 7).agg(F.min("ingest_seq"), F.count("*")).first()[:] == (43 * 3, 7)
    assert ranking.keep_newest(frame, 0).count() == 50
    assert ranking.keep_newest(frame, 99).count() == 50


def test_top_n_of_a_hot_key(spark, narrow):
    rows = [("hot", i) for i in range(300)] + [("cold", i) for i in range(5)]
    frame = spark.createDataFrame(rows, "k string, v bigint")
    got = ranking.top_n_per_key(frame, ["k"], [("v", True)], 10, salts=4).groupBy("k").agg(F.sort_array(F.collect_list("v")))
    assert dict(got.collect()) == {"hot": list(range(290, 300)), "cold": [0, 1, 2, 3, 4]}


def test_lag_by_chunk(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), i, i * 10) for i in range(120)]
    frame = spark.createDataFrame(rows, "k string, seq bigint, v bigint")
    chunk = F.call_function("div", F.col("seq"), F.lit(7).cast("bigint"))
    got = {r["seq"]: r["prev_v"] for r in ranking.lag_by_chunk(frame, ["k"], ["seq"], chunk, ["v"]).collect()}
    last = {}
    for key, seq, value in rows:
        assert got[seq] == last.get(key)
        last[key] = value


def walk(rows, ttl):
    """The per-pid cache, one event at a time."""
    minute, cache, out = 60_000_000, {}, {}
    for pid, seq, now, hint, stop, long_lived in rows:
        life = cache.get(pid)
        if hint is not None:
            life, how = (hint, now, "l" if long_lived else "a"), "explicit"
        elif life and now - life[1] <= {"p": ttl[0], "a": ttl[1], "l": ttl[2]}[life[2]] * minute:
            life, how = (life[0], now, life[2]), "cached"
        else:
            life, how = (now, now, "l" if long_lived else "p"), "provisional"
        out[seq] = (life[0], how)
        cache[pid] = None if stop else life
    return out


def pid_rows(seed, n):
    rng = random.Random(seed)
    rows, now = [], 1_700_000_000_000_000
    for seq in range(n):
        now += rng.choice([1, 5, 20, 40, -3]) * 60_000_000
        hint = now - 1000 if rng.random() < 0.1 else None
        rows.append((rng.choice([1, 1, 1, 2, 3]), seq, now, hint, rng.random() < 0.05, rng.random() < 0.08))
    return rows


def pid_frame(spark, rows):
    frame = spark.createDataFrame(rows, "pid bigint, ingest_seq bigint, us bigint, hint bigint, is_stop boolean, is_long_lived boolean")
    return frame.select(
        F.lit("h").alias("host"), "pid", "ingest_seq", F.timestamp_micros("us").alias("ts"),
        F.timestamp_micros("hint").alias("create_hint"), "is_stop", "is_long_lived",
    )


@pytest.mark.parametrize("seed,width", [(1, 10), (2, 37), (3, 1 << 20)])
def test_process_keys_match_the_walk(spark, seed, width):
    ttl, rows = (30, 60, 200), pid_rows(seed, 400)
    got = asof.resolve_process_keys(pid_frame(spark, rows), ttl, chunk_width=width)
    found = {r["ingest_seq"]: (r["us"], r["resolution"]) for r in got.select("ingest_seq", F.unix_micros("process_create_time").alias("us"), "resolution").collect()}
    assert found == walk(rows, ttl)


def test_process_keys_without_long_lived(spark):
    ttl, rows = (30, 60, 200), [r[:5] + (False,) for r in pid_rows(9, 300)]
    got = asof.resolve_process_keys(pid_frame(spark, rows), ttl, chunk_width=25, has_long_lived=False)
    found = {r["ingest_seq"]: (r["us"], r["resolution"]) for r in got.select("ingest_seq", F.unix_micros("process_create_time").alias("us"), "resolution").collect()}
    assert found == walk(rows, ttl)


def test_lifetimes_must_not_decrease(spark):
    with pytest.raises(ValueError):
        asof.resolve_process_keys(pid_frame(spark, pid_rows(1, 5)), (60, 30, 90))


def paths_by_hand(rows):
    by_id = {(s, i): (n, p) for s, i, n, p in rows}
    out = {}
    for source, index, name, parent in rows:
        path, here, up, seen = name, index, parent, {index}
        while up is not None and up != here and up not in seen and (source, up) in by_id:
            seen.add(up)
            above, further = by_id[(source, up)]
            path = above + "\\" + path if above else path
            here, up = up, further
        out[(source, index)] = path
    return out


@pytest.mark.parametrize("seed,cycles", [(1, False), (2, True), (3, True)])
def test_full_paths(spark, seed, cycles):
    rng = random.Random(seed)
    rows = []
    for source in ("C:", "D:"):
        for i in range(60):
            parent = rng.randrange(60) if cycles else (rng.randrange(max(i, 1)) if i else 0)
            rows.append((source, i, "" if rng.random() < 0.05 else f"n{i}", rng.choice([parent, parent, parent, None, 999])))
    frame = spark.createDataFrame(rows, "source string, record_index bigint, file_name string, parent_record_index bigint")
    got = mft_paths.full_paths(frame.withColumn("host", F.lit("h"))).collect()
    assert {(r["source"], r["record_index"]): r["full_path"] for r in got} == paths_by_hand(rows)


def test_deep_chain(spark):
    frame = spark.range(300).select(
        F.lit("h").alias("host"), F.lit("C:").alias("source"), F.col("id").alias("record_index"),
        F.concat(F.lit("d"), F.col("id").cast("string")).alias("file_name"), (F.col("id") - 1).alias("parent_record_index"),
    )
    deepest = mft_paths.full_paths(frame).where("record_index = 299").first()["full_path"]
    assert deepest == "\\".join(f"d{i}" for i in range(300))


def items(spark, rows):
    return spark.createDataFrame([(h, k, k, v, i) for i, (h, k, v) in enumerate(rows)], "host string, key string, display string, value string, seq int")


@pytest.mark.parametrize(
    "live,offline,values,expected",
    [
        ([("h", "a", None), ("h", "b", None)], [("h", "a", None), ("h", "b", None), ("h", "evil", None)], True, [("MissingFromLive", "evil")]),
        ([("h", "a", None), ("h", "ghost", None)], [("h", "a", None)], True, [("MissingFromOffline", "ghost")]),
        ([("h", "a", None), ("h", "b", None)], [("h", "b", None), ("h", "a", None)], True, []),
        ([("h", "svc", "1")], [("h", "svc", "2")], True, [("ValueMismatch", "svc")]),
        ([("h", "svc", "1")], [("h", "svc", "2")], False, []),
        ([("h", "WuauServ", "X")], [("h", "wuauserv", "x")], True, []),
        ([("h", " ", None)], [("h", "", None)], True, []),
    ],
)
def test_cross_source(spark, live, offline, values, expected):
    found = cross_source.compare("Service", items(spark, live), items(spark, offline), compare_values=values)
    assert [(r["kind"], r["key"]) for r in found.collect()] == expected


def test_guard_is_per_host(spark):
    live = items(spark, [("h1", "a", None), ("h2", "a", None)])
    offline = items(spark, [("h1", "b", None)])
    found = cross_source.compare("Service", live, offline, require_both=True)
    assert {(r["host"], r["kind"]) for r in found.collect()} == {("h1", "MissingFromLive"), ("h1", "MissingFromOffline")}


def test_last_item_wins_and_first_spelling_stays(spark):
    live = items(spark, [("h", "Svc", "old"), ("h", "SVC", "new")])
    found = cross_source.compare("Service", live, items(spark, [("h", "x", None)])).where("kind = 'MissingFromOffline'").first()
    assert (found["key"], found["display"], found["live_value"]) == ("Svc", "SVC", "new")


def manifest(spark, **values):
    schema = trust.MANIFEST_SCHEMA
    clean = dict(
        host="h", collection_id="c", manifest_present=True, integrity_status="Verified", complete=True, was_event_count_capped=False,
        source_event_count=10, exported_event_count=10, event_cap=500000, trace_dropped_total=0, render_dropped_total=0, failed_evidence_count=0,
        skipped_evidence_count=0, was_artifact_copy_incomplete=False, artifact_copy_warning=None, copied_artifact_count=1, evidence_count=1,
        used_shadow_copy=True, preflight_present=True, preflight_errors=[], preflight_warnings=[], is_administrator=True,
        registry_mode="offline_only", registry_live_enabled=False, mode_profile="forensic_strict",
    )
    clean.update(values)
    return spark.createDataFrame([tuple(clean[f.name] for f in schema)], schema)


def test_clean_manifest_is_green(spark):
    signals = trust.trust_signals(manifest(spark))
    assert signals.count() == 11
    row = trust.trust_overall(signals).first()
    assert (row["overall_level"], row["red_count"], row["amber_count"]) == (0, 0, 0)


@pytest.mark.parametrize(
    "values,signal,level,fragment",
    [
        (dict(was_event_count_capped=True, source_event_count=600000, exported_event_count=500000), "Event truncation", 2, "100,000 of 600,000"),
        (dict(trace_dropped_total=None), "ETW completeness", 1, "not recorded"),
        (dict(failed_evidence_count=2), "Raw artifact copy", 2, "2 evidence file(s) FAILED"),
        (dict(skipped_evidence_count=3, artifact_copy_warning="w"), "Raw artifact copy", 1, "(3 skipped; w)"),
        (dict(preflight_errors=["bad"]), "Preflight", 2, "1 error(s): bad"),
        (dict(registry_mode="live_non_forensic"), "Registry mode", 1, "Live Registry"),
        (dict(mode_profile="CUSTOM"), "Mode profile", 1, "Custom profile"),
        (dict(integrity_status="Failed"), "Integrity", 2, "FAILED"),
    ],
)
def test_trust_signals(spark, values, signal, level, fragment):
    row = trust.trust_signals(manifest(spark, **values)).where(F.col("signal") == signal).first()
    assert row["level"] == level and fragment in row["detail"]


def test_missing_manifest_is_red(spark):
    signals = trust.trust_signals(manifest(spark, manifest_present=False, integrity_status=None)).collect()
    assert [(r["signal"], r["level"]) for r in signals] == [("Manifest", 2)]


@pytest.mark.parametrize("path,bad", [("raw/a", False), ("../x", True), ("a/../../x", True), ("a/../b", False), ("/etc/x", True), ("C:\\x", True), ("a\\..\\..\\b", True)])
def test_escaping_paths(spark, path, bad):
    frame = spark.createDataFrame([(path,)], "p string")
    assert frame.select(integrity.escapes(F.col("p"))).first()[0] is bad


def test_integrity_statuses(spark):
    declared = spark.createDataFrame([("h", "ok", "a", "1"), ("h", "bad", "a", "1")], "host string, collection_id string, relative_path string, sha256 string")
    actual = spark.createDataFrame([("h", "ok", "A", "1"), ("h", "bad", "a", "2")], declared.schema)
    names = ["timeline.json", "manifest.json", "hashes.txt"]
    files = spark.createDataFrame(
        [("h", c, n) for c in ("ok", "bad") for n in names] + [("h", "none", n) for n in names[:2]] + [("h", "part", names[0])],
        "host string, collection_id string, relative_path string",
    )
    got = integrity.integrity_status(integrity.compare_hashes(declared, actual), files)
    assert {r["collection_id"]: r["status"] for r in got.collect()} == {"ok": "Verified", "bad": "Failed", "none": "Unverified", "part": "Failed"}


def test_hash_lines_are_parsed(spark):
    lines = spark.createDataFrame([("# c",), ("",), ("AB  raw/x y.txt",), ("broken line",)], "value string")
    assert [tuple(r) for r in integrity.parse_hash_lines(lines).collect()] == [("ab", "raw/x y.txt")]


def test_calendar_throttle(spark):
    rows = [("h", "File", i, i // 5) for i in range(20)] + [("h", "Other", 100 + i, 0) for i in range(9)]
    frame = spark.createDataFrame(rows, "host string, category string, ingest_seq bigint, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    kept = windows.throttle(frame, limits={"File": 2}).groupBy("category").count()
    assert dict(kept.collect()) == {"File": 8, "Other": 9}
    assert windows.throttle_drops(frame, limits={"File": 2}).agg(F.sum("dropped")).first()[0] == 12
    assert windows.throttle(frame, max_per_second=1).count() == 5


def test_subscriptions(spark):
    runs = ["__FilterToConsumerBinding", 'CommandLineEventConsumer.Name="c"', '__EventFilter.Name="f"', "__EventFilter", "root\\cimv2", "f", "select * from X", "WQL", "__EventFilter", "Query"]
    frame = spark.createDataFrame([("h", "o", i, r) for i, r in enumerate(runs)], "host string, file string, pos int, run string")
    got = {r["kind"]: r for r in wmi.subscriptions(frame).collect()}
    assert set(got) == {"Binding", "Filter", "Consumer"}
    assert (got["Filter"]["name"], got["Filter"]["namespace"], got["Filter"]["query"], got["Filter"]["query_language"]) == ("f", "root\\cimv2", "select * from X", "WQL")
    noise = ["__EventFilter", "Name", "Query", "QueryLanguage", "__FilterToConsumerBinding", "Consumer", "Filter"]
    frame = spark.createDataFrame([("h", "o", i, r) for i, r in enumerate(noise)], "host string, file string, pos int, run string")
    assert wmi.subscriptions(frame).count() == 0


def test_connection_hour_roll(spark):
    rows = [("h", 1, 0, "A"), ("h", 2, 60, "A"), ("h", 3, 120, "B"), ("h", 4, 3600, "B"), ("h", 6, 7200, "B")]
    frame = spark.createDataFrame(rows, "host string, snapshot_id bigint, s bigint, state string").select(
        "host", "snapshot_id", F.timestamp_seconds("s").alias("snapshot_ts"), F.lit("TCP").alias("protocol"), F.lit("a:1").alias("local_ep"),
        F.lit("b:2").alias("remote_ep"), F.lit(5).cast("bigint").alias("pid"), "state",
    )
    other = frame.where("snapshot_id = 6").withColumns({"snapshot_id": F.lit(5).cast("bigint"), "pid": F.lit(9).cast("bigint"), "snapshot_ts": F.timestamp_seconds(F.lit(3660))})
    got = transitions.connection_transitions(frame.unionByName(other)).where("pid = 5").orderBy("snapshot_id", "action")
    assert [(r["snapshot_id"], r["action"]) for r in got.collect()] == [(1, "Connect"), (3, "Update"), (4, "Connect"), (4, "Disconnect"), (5, "Disconnect"), (6, "Connect")]


def test_process_reuse_and_late_time(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [("h", 1, 7, None), ("h", 2, 7, base), ("h", 3, 7, None), ("h", 4, 7, base + dt.timedelta(days=1)), ("h", 5, 8, base)]
    frame = spark.createDataFrame(rows, "host string, snapshot_id bigint, pid bigint, create_time timestamp").withColumn("snapshot_ts", F.timestamp_seconds(F.col("snapshot_id")))
    got = transitions.process_transitions(frame).where("pid = 7").orderBy("snapshot_id", "action").collect()
    assert [(r["snapshot_id"], r["action"]) for r in got] == [(1, "Start"), (2, "Start"), (2, "Stop"), (4, "Start"), (4, "Stop"), (5, "Stop")]


def test_merge_mft_cap(spark):
    first = spark.range(5).withColumnRenamed("id", "record_index")
    kept, flag = sets.merge_mft([first, first], 7)
    assert kept.groupBy("source_ordinal").count().orderBy("source_ordinal").collect()[:] == [(0, 5), (1, 2)]
    assert flag.first()["truncated"] is True
    assert sets.merge_mft([first, first], 0)[1].first()["truncated"] is False


def test_stream_state_crosses_batches(spark):
    """Process keys and the anchored throttle over several micro-batches equal the walk over all rows."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ttl, rows = (30, 60, 200), pid_rows(5, 120)
    path, out = staging_path(spark, "t"), staging_path(spark, "t")
    for at in range(0, 120, 40):
        pid_frame(spark, rows[at : at + 40]).coalesce(1).write.mode("append").parquet(path)
        stream = read_record_stream(spark, "parquet", pid_frame(spark, rows[:1]).schema, path=path)
        keyed = stateful.process_key_stream(stream, ttl)
        keyed.writeStream.format("parquet").option("checkpointLocation", out + "-log").trigger(availableNow=True).start(out).awaitTermination()
    found = {r["ingest_seq"]: (r["create_us"], r["resolution"]) for r in spark.read.parquet(out).collect()}
    assert found == walk(rows, ttl)


@pytest.mark.parametrize("native", [0, 1000])
def test_page_ties_and_nulls(spark, monkeypatch, native):
    """Any page is the same slice of the sorted rows, on either side of the shallow form."""
    monkeypatch.setattr(ranking, "NATIVE_LIMIT", native)
    monkeypatch.setattr(ranking, "BUCKETS", 3)
    rows = [(None if i % 5 == 0 else i // 4, i % 3 if i % 7 else None, f"r{i % 9}") for i in range(60)]
    frame = spark.createDataFrame(rows, "a long, b long, name string")
    for order in ([("a", True)], [("a", False), ("b", True)]):
        sorting = [*ranking.sort_columns(order), *ranking.tie_columns(frame, order)]
        whole = [tuple(r) for r in frame.orderBy(*sorting).collect()]
        for offset, limit in ((0, 1), (3, 11), (10, 13), (40, 30), (59, 5), (60, 5), (0, 100)):
            assert [tuple(r) for r in ranking.page(frame, order, offset, limit).collect()] == whole[offset : offset + limit]


def test_caps_with_ties_nulls_and_keys(spark):
    rows = [("h1" if i % 3 else "h2", i // 2 if i % 10 else None, i) for i in range(40)]
    frame = spark.createDataFrame(rows, "host string, ingest_seq long, x int")
    for cap in range(1, 45, 3):
        for keep, descending in ((ranking.keep_first, False), (ranking.keep_newest, True)):
            known = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1] if descending else r[1], r[0], r[2]))
            unknown = sorted((r for r in rows if r[1] is None), key=lambda r: (r[0], r[2]))
            assert {tuple(r) for r in keep(frame, cap).collect()} == set((known + unknown)[:cap])
            per_host = {r["host"]: r["n"] for r in keep(frame, cap, keys=("host",)).groupBy("host").agg(F.count("*").alias("n")).collect()}
            assert per_host == {h: min(cap, sum(r[0] == h for r in rows)) for h in ("h1", "h2")}
    assert {r["host"]: r["evicted"] for r in ranking.evicted(frame, 15, ("host",)).collect()} == {"h1": 11, "h2": 0}


def test_collections_are_kept_apart(spark):
    events = spark.createDataFrame(
        [("H", c, n, "2024-01-01 00:00:00", 7, None, False, False) for c in ("A", "B") for n in (1, 2)],
        "host string, collection_id string, ingest_seq long, ts string, pid long, create_hint timestamp, is_stop boolean, is_long_lived boolean",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    resolved = asof.resolve_process_keys(events)
    assert sorted((r["collection_id"], r["ingest_seq"], r["life_seq"]) for r in resolved.collect()) == [("A", 1, 1), ("A", 2, 1), ("B", 1, 1), ("B", 2, 1)]
    assert asof.cache_stats(resolved).first()["total_entries"] == 2


def test_evidence_stays_with_its_collection(spark):
    evidence = "array<struct<source:string,reference:string,hash:string,collected_at:timestamp>>"
    rows = [("H", c, n, [("s", ref, None, None) for ref in refs]) for c, n, refs in (("A", 1, "ab"), ("A", 2, "c"), ("B", 1, "ab"), ("B", 2, "d"))]
    events = spark.createDataFrame(rows, f"host string, collection_id string, ingest_seq long, evidence {evidence}")
    copied = spark.createDataFrame([("H", "A", "A", "raw/a"), ("G", "B", "b", "raw/b")], "host string, collection_id string, reference string, copied_path string")
    got = {(r["collection_id"], r["ingest_seq"]): [e["reference"] for e in r["evidence"]] for r in enrich.rewrite_evidence(events, copied).collect()}
    assert got == {("A", 1): ["raw/a", "b"], ("A", 2): ["c"], ("B", 1): ["a", "b"], ("B", 2): ["d"]}


def test_last_id_wins(spark):
    blob = lambda t: bytearray(f"{t}\0".encode("utf-16-le"))
    rows = [("H", 1, 0, blob("!!z"), 1), ("H", 1, 0, blob("!!a"), 2), ("H", 2, 0, blob("!!b"), 1), ("H", 2, 0, None, 2)]
    ids = spark.createDataFrame(rows, "host string, id_index long, id_type int, id_blob binary, row_number long")
    assert {r["id_index"]: r["id_value"] for r in enrich.srum_id_map(ids).collect()} == {1: "!!a", 2: ""}


def test_new_items_of_each_host(spark):
    rows = lambda *pairs: spark.createDataFrame([(h, (k,)) for h, k in pairs], "host string, object_flow struct<key:string>")
    got = sets.new_connections(rows(("A", "0.0.0.0:445"), ("B", "x")), rows(("B", "0.0.0.0:445"), ("B", "x")))
    assert [tuple(r) for r in got.collect()] == [("A", "0.0.0.0:445")]
