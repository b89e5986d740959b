"""Sources and sinks on small files."""

import datetime as dt
import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.functions.bags import field
from evidentia.operators import cross_source, integrity, views
from evidentia.plans.base import activity
from evidentia.sinks import bundle as bundle_sink
from evidentia.sinks import repository, store as store_sink
from evidentia.sources import artifacts, bundle, eventlog, mft, registry, store, texts

from .conftest import SMALL

needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="table set not present")


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


EVENT = {
    "timestamp": "2024-01-02T03:04:05.1234567Z",
    "category": "Network",
    "action": "Connect",
    "subjectProcess": "P:1F:7:2024-01-01T00:00:00.0000001Z",
    "objectNetworkFlow": "N:TCP:[::1]:8080->[2001:db8::2]:443:7:2024-01-02T03:00:00.0000000Z",
    "fields": {"n": 5, "s": "x", "o": {"a": 1}, "b": True},
    "evidence": [{"source": "EvtxFile", "reference": "raw/evtx/a.evtx"}, {"source": "X", "reference": "raw/../../b"}],
}


def test_case_repository(spark, tmp_path):
    bad = [{**EVENT, "timestamp": "soon"}, {k: v for k, v in EVENT.items() if k != "action"}]
    for host in ("h1", "h 2"):
        write(tmp_path / host / "c1" / "timeline.json", json.dumps({"events": [bad[0], EVENT, bad[1]]}, indent=1))
    rows = bundle.read_case_repository(spark, str(tmp_path)).orderBy("host").collect()
    assert [(r["host"], r["collection_id"], r["ingest_seq"]) for r in rows] == [("h 2", "c1", 1), ("h1", "c1", 1)]
    row = rows[1]
    assert row["ts_ticks"] % 10 == 7
    assert row["subject_process"]["key"] == EVENT["subjectProcess"]
    assert row["object_flow"]["remote_ep"] == "[2001:db8::2]:443"
    assert row["fields"]["n"] == "5" and row["fields"]["b"] == "true" and json.loads(row["fields"]["o"]) == {"a": 1}
    assert row["evidence"][0]["reference"].endswith("/h1/c1/raw/evtx/a.evtx")
    assert row["evidence"][1]["reference"] == "raw/../../b"


def test_integrity_of_files(spark, tmp_path):
    base = tmp_path / "h" / "c"
    for name in ("timeline.json", "manifest.json", "raw/a.bin"):
        write(base / name, name)
    files = bundle.read_actual_hashes(spark, str(tmp_path))
    lines = [r["value"] for r in bundle_sink.hash_lines(files).collect()]
    assert len(lines) == 3
    write(base / "hashes.txt", "# header\n" + "\n".join(lines) + "\n")

    def status():
        actual = bundle.read_actual_hashes(spark, str(tmp_path))
        checks = integrity.compare_hashes(bundle.read_declared_hashes(spark, str(tmp_path)), actual)
        return integrity.integrity_status(checks, actual).first()["status"], {r["status"] for r in checks.collect()}

    assert status() == ("Verified", {"ok"})
    write(base / "raw/extra.bin", "x")
    assert status() == ("Failed", {"ok", "undeclared"})
    write(base / "timeline.json", "changed")
    assert status() == ("Failed", {"ok", "undeclared", "mismatch"})


def test_manifests(spark, tmp_path):
    good = {"complete": True, "collectionSummary": {"sourceEventCount": "12", "etwDroppedEventTotal": 0}, "preflight": {"isAdministrator": False, "errors": []}, "host": {"hostname": "pc"}}
    write(tmp_path / "h" / "c1" / "manifest.json", json.dumps(good))
    write(tmp_path / "h" / "c2" / "manifest.json", "{broken")
    write(tmp_path / "h" / "c3" / "timeline.json", "{}")
    rows = {r["collection_id"]: r for r in bundle.read_manifests(spark, str(tmp_path)).collect()}
    assert (rows["c1"]["manifest_present"], rows["c1"]["source_event_count"], rows["c1"]["is_administrator"], rows["c1"]["hostname"]) == (True, 12, False, "pc")
    assert not rows["c2"]["manifest_present"] and not rows["c3"]["manifest_present"]


def test_entities_document(spark, tmp_path):
    document = {"processes": [{"bootId": 18446744073709551615, "processId": 4, "createTime": "2024-01-01T00:00:00Z"}], "users": [{"sid": "S-1"}], "files": [], "networkFlows": []}
    write(tmp_path / "h" / "c" / "entities.json", json.dumps(document, indent=1))
    lists = bundle.read_entities(spark, f"{tmp_path}/*/*/entities.json")
    assert lists["processes"].first()["bootId"] == 18446744073709551615
    assert lists["users"].first()["sid"] == "S-1"
    assert lists["files"].count() == 0


@needs_tables
def test_session_outcomes(spark, tmp_path):
    events = activity(spark, SMALL)
    bundle_sink.write_session(events, f"{tmp_path}/s", cap=50)
    rows, outcome = bundle.read_session(spark, f"{tmp_path}/s")
    assert (rows.count(), outcome.first()["outcome"]) == (50, "Loaded")
    rows, outcome = bundle.read_session(spark, f"{tmp_path}/s", supported_version=0)
    assert (rows.count(), outcome.first()["outcome"]) == (0, "UnsupportedSchemaVersion")
    bundle_sink.write_timeline_lines(events.limit(0), f"{tmp_path}/s/timeline")
    assert bundle.read_session(spark, f"{tmp_path}/s")[1].first()["outcome"] == "MissingOrEmptyTimeline"


@needs_tables
def test_publish_is_idempotent(spark, tmp_path):
    root, events = f"{tmp_path}/repo", activity(spark, SMALL)
    verified = events.select("host", "collection_id").distinct().withColumn("status", F.lit("Verified"))
    decisions = lambda df: {r["decision"] for r in df.collect()}
    assert decisions(repository.publish(events, verified, root)) == {"Publish"}
    total = spark.read.parquet(root).count()
    assert decisions(repository.publish(events, verified, root)) == {"AlreadyPresent"}
    shorter = events.where("host != 'H1' OR ingest_seq % 2 = 0")
    assert {r["host"] for r in repository.publish(shorter, verified, root).collect() if r["decision"] == "Publish"} == {"H1"}
    assert spark.read.parquet(root).count() == shorter.count() < total
    refused = verified.withColumn("status", F.lit("Failed"))
    assert decisions(repository.publish(events, refused, root)) == {"Failed"}


@needs_tables
def test_store_prunes_days(spark, tmp_path):
    path = f"{tmp_path}/store"
    store_sink.write_store(activity(spark, SMALL), path)
    spark.conf.set("spark.sql.maxMetadataStringLength", 10000)
    rows = store.read_store(spark, path, "2024-01-05 00:00:00", "2024-01-06 12:00:00", "File")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "EqualTo(category,File)" in plan and "GreaterThanOrEqual(ts" in plan


TASK = """<?xml version="1.0" encoding="UTF-16"?>
<Task xmlns="http://schemas.microsoft.com/windows/2004/02/mit/task">
 <RegistrationInfo><Author>Acme &amp; Co</Author></RegistrationInfo>
 <Triggers><LogonTrigger><Enabled>false</Enabled></LogonTrigger><TimeTrigger><StartBoundary>2024-01-01T09:00:00</StartBoundary></TimeTrigger><LogonTrigger/><OddTrigger><X>1</X></OddTrigger></Triggers>
 <Actions><Exec><Command>powershell.exe</Command><Arguments>-enc AAAA</Arguments></Exec></Actions>
</Task>"""


def test_task_files(spark, tmp_path):
    (tmp_path / "Tasks").mkdir()
    (tmp_path / "Tasks" / "Evil").write_bytes(b"\xff\xfe" + TASK.encode("utf-16-le"))
    write(tmp_path / "Tasks" / "Other", "<NotATask/>")
    write(tmp_path / "Tasks" / "Broken", "<Task><Triggers>")
    rows = texts.parse_tasks(texts.read_task_files(spark, f"{tmp_path}/Tasks", "h"), "Asia/Taipei").collect()
    assert [r["task_name"] for r in rows] == ["\\Evil"]
    assert rows[0]["author"] == "Acme & Co"
    assert [(t["kind"], t["enabled"]) for t in rows[0]["triggers"]] == [("LogonTrigger", False), ("TimeTrigger", None), ("LogonTrigger", None), ("OddTrigger", None)]
    assert rows[0]["triggers"][1]["start_utc"] == dt.datetime(2024, 1, 1, 1)
    event = texts.task_events(texts.parse_tasks(texts.read_task_files(spark, f"{tmp_path}/Tasks", "h"))).first()
    assert event["summary"] == "Scheduled task: \\Evil → powershell.exe -enc AAAA"
    assert event["fields"]["Triggers"] == "LogonTrigger (disabled); TimeTrigger@2024-01-01T09:00:00; LogonTrigger; OddTrigger"


def test_console_history(spark):
    rows = spark.createDataFrame([("h", "C:\\Users\\bob\\x\\ConsoleHost_history.txt", "dir\r\n\r\n  iex (a)\rcertutil -x\n")], "host string, path string, content string")
    events = texts.console_events(rows.withColumn("modified", F.current_timestamp())).orderBy("ingest_seq").collect()
    assert [(e["ingest_seq"], e["fields"]["Command"], e["fields"].get("SuspiciousKeywords")) for e in events] == [(1, "dir", None), (3, "iex (a)", "iex"), (4, "certutil -x", "certutil")]
    assert events[0]["summary"] == "PowerShell history (bob): dir"


def test_event_log_processes_share_a_life(spark):
    def record(seq, minute, data):
        xml = (
            f"<Event><System><Provider Name='P'/><EventID>4688</EventID><TimeCreated SystemTime='2024-01-01T00:{minute:02d}:00.0000000Z'/>"
            f"<EventRecordID>{seq}</EventRecordID><Channel>Security</Channel></System><EventData>{data}</EventData></Event>"
        )
        return ("h", "c", seq, xml)

    rows = [
        record(1, 1, "<Data Name='NewProcessId'>0x10</Data><Data Name='CreationUtcTime'>2024-01-01T00:00:30Z</Data>"),
        record(2, 2, "<Data Name='NewProcessId'>0x10</Data>"),
        record(3, 3, "<Data Name='Note'>no pid</Data>"),
        ("h", "c", 4, "<Event><System>"),
    ]
    frame = spark.createDataFrame(rows, "host string, collection_id string, ingest_seq bigint, xml string")
    got = {e["ingest_seq"]: e["subject_process"] for e in eventlog.read_event_log(frame, F.lit(255)).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["key"] == got[2]["key"] == "P:FF:16:2024-01-01T00:00:30.0000000Z"
    assert got[3] is None
    offline = frame.withColumn("path", F.lit("C:\\x\\Microsoft-Windows-Sysmon%4Operational.evtx"))
    event = eventlog.read_event_log(offline, F.lit(1), offline_path="path").first()
    assert event["fields"]["LogName"] == "Microsoft-Windows-Sysmon/Operational" and event["fields"]["Mode"] == "Offline"


def test_file_record_names(spark):
    raw = spark.createDataFrame(
        [("h", "C:", 5, True, None, None, [("DOS~1", 2, 5, 0, 0, True), ("Long name", 1, 5, 0, 0, True), ("Posix", 0, 5, 0, 0, True)]), ("h", "C:", 6, True, None, None, [("\x01 ", 1, 5, 0, 0, False)])],
        mft._RAW,
    )
    assert [r["file_name"] for r in mft.entries_from_attributes(raw).collect()] == ["Long name"]


@pytest.mark.parametrize("payload", [b"", b"FILE", bytes(1024), b"FILE" + b"\xff" * 1020, b"FILE" + bytes(1020), b"\xff" * 4096])
def test_file_records_survive_any_bytes(payload):
    batch = pa.RecordBatch.from_arrays([pa.array(["h"]), pa.array(["s"]), pa.array([1], pa.int64()), pa.array([payload], pa.binary())], ["host", "source", "record_index", "record"])
    assert sum(b.num_rows for b in mft._decode_batches(iter([batch]))) == 0


@needs_tables
def test_file_records_from_a_table_file(spark, tmp_path):
    from evidentia.plans.source_queries import mft_records

    records = [bytes(r["record"]) for r in mft_records(spark, SMALL).orderBy("record_index").limit(40).collect()]
    (tmp_path / "mft.bin").write_bytes(b"".join(records))
    got = {r["record_index"] for r in mft.read_mft(spark, f"{tmp_path}/mft.bin", "h", "C:").collect()}
    assert got == {i for i in range(40) if i % 50 != 7 and i % 40 != 9}


def test_registry_selection(spark):
    values = spark.createDataFrame(
        [
            ("SOFTWARE", "Microsoft\\Windows\\CurrentVersion\\Run"),
            ("SOFTWARE", "Microsoft\\Windows\\CurrentVersion\\Run\\Sub"),
            ("SOFTWARE", "microsoft\\windows\\currentversion\\uninstall\\app"),
            ("SOFTWARE", "Microsoft\\Windows\\CurrentVersion\\UninstallX"),
            ("system", "ControlSet002\\Services"),
            ("OTHER", "ControlSet002\\Services"),
        ],
        "hive string, key_path string",
    )
    assert sorted(r["query_name"] for r in registry.select_values(values).collect()) == ["Run", "Services", "Uninstall"]


def test_event_log_with_many_properties(spark):
    """A SID behind the twentieth item is found and every item is a property, unless they are bounded."""
    head = "<Event><System><Provider Name='P'/><EventID>4624</EventID><TimeCreated SystemTime='2024-01-05T00:00:00Z'/><Channel>Security</Channel></System><EventData>"
    xml = head + "".join(f"<Data>v{i}</Data>" for i in range(29)) + "<Data>S-1-5-21-7</Data></EventData></Event>"
    frame = spark.createDataFrame([("h", "c", 1, xml)], "host string, collection_id string, ingest_seq bigint, xml string")
    for bound, n in ((None, 30), (20, 20)):
        event = eventlog.read_event_log(frame, F.lit(1), max_properties=bound).first()
        assert event["subject_user"]["sid"] == "S-1-5-21-7" and event["fields"]["EventData_29"] == "S-1-5-21-7"
        assert sorted(k for k in event["fields"] if k.startswith("Property_")) == sorted(f"Property_{i}" for i in range(n))
    assert eventlog.read_event_log(frame, F.lit(1)).first()["fields"]["Property_28"] == "v28"


def test_long_registry_values(spark):
    """Raw values are decoded, compared and searched to their end; only the display is cut."""
    path = "C:\\Program Files\\A vendor of long names\\Agent of the vendor\\service"
    service, notify = "ControlSet001\\Services\\svc", "Microsoft\\Windows NT\\CurrentVersion\\Winlogon"
    debug = "Microsoft\\Windows NT\\CurrentVersion\\Image File Execution Options\\x.exe"
    rows = [("SYSTEM", service + n, v, f"{path}{n}{end}") for n, end in (("1", ".exe"), ("2", ".sys")) for v in ("ImagePath", "DisplayName")]
    rows += [("SOFTWARE", notify, "Shell", path + ".exe"), ("SOFTWARE", debug, "Debugger", path + ".exe")]
    raw = [("h", "c", i, h, "C:\\hives", k, n, "REG_SZ", bytearray(t.encode("utf-16-le") + b"\0\0"), None) for i, (h, k, n, t) in enumerate(rows)]
    columns = "host string, collection_id string, ingest_seq bigint, hive string, hive_path string, key_path string, value_name string, value_type string, value_raw binary, value_text string"
    values = spark.createDataFrame(raw, columns).withColumn("last_write", F.lit("2024-01-05").cast("timestamp"))
    events = registry.registry_events(registry.select_values(values))
    found = {e["ingest_seq"]: e["fields"] for e in events.collect()}
    names = ["ServiceImagePath", "ServiceDisplayName"] * 2 + ["Winlogon_Shell", "IFEO_Debugger"]
    for i, (name, row) in enumerate(zip(names, rows)):
        assert found[i][name] == found[i]["ValueData"]
        assert bytes.fromhex(found[i][name]).decode("utf-16-le").rstrip("\0") == row[3]
        assert len(found[i]["ValueDisplay"]) == 203
    items = cross_source.offline_service_items(events).collect()
    assert [(r["key"], r["value"]) for r in items] == [("svc1", path + "1.exe")]
    end = " ".join(f"{b:02X}" for b in ".sys".encode("utf-16-le"))
    searched = registry.registry_search_events(values, "Services", "ControlSet001\\Services", data_pattern=end).collect()
    assert sorted(e["ingest_seq"] for e in searched) == [2, 3]


def test_recent_documents(spark):
    def item(text):
        body = b"2\0" + text.encode() + b"\0"
        return (len(body) + 2).to_bytes(2, "little") + body

    blob = item("C:\\docs") + item("a.txt") + b"\0\0"
    order = b"".join(n.to_bytes(4, "little", signed=True) for n in (1, 0, -1))
    rows = [("MRUListEx", order), ("0", blob), ("1", b"\1\2\3")]
    frame = spark.createDataFrame([("h", "c", i, "NTUSER\\RecentDocs\\.txt", n, "REG_BINARY", bytearray(b), None) for i, (n, b) in enumerate(rows)],
                                  "host string, collection_id string, ingest_seq bigint, key_path string, value_name string, value_type string, value_raw binary, value_text string")
    events = registry.registry_search_events(frame.withColumn("last_write", F.current_timestamp()), "RecentDocs", "NTUSER\\RecentDocs")
    got = {e["fields"]["ValueName"]: e["fields"] for e in events.collect()}
    assert set(got) == {"0", "1"}
    assert (got["0"]["ValueData"], got["0"]["MruOrder"], got["1"]["MruOrder"], got["0"]["RecentDocsExtension"]) == ("C:\\docs\\a.txt", "1", "0", ".txt")
    recent = views.recent_files_view(events).orderBy("ingest_seq").collect()
    assert [(r["source"], r["file_name"], r["mru_order"]) for r in recent] == [("RecentDocs MRU", "a.txt", 1), ("RecentDocs MRU", "01 02 03", 0)]


def test_jump_list_needs_a_target(spark):
    frame = spark.createDataFrame([("h", 1, "  ")], "host string, ingest_seq bigint, target_path string")
    texts_ = ["local_base_path", "common_path_suffix", "network_path", "relative_path", "name_string", "working_directory", "arguments", "list_type", "app_id", "file_path", "stream_name", "pin_status", "path_hint"]
    stamps = ["last_access", "link_access", "access_time", "modification_time", "link_creation", "link_write"]
    full = frame.select("*", *[F.lit("").alias(c) for c in texts_], *[F.lit(None).cast("timestamp").alias(c) for c in stamps], F.lit(1).alias("mru_order"), F.lit(1).alias("access_count"))
    assert artifacts.jump_list_events(full).count() == 0


def test_services_events(spark):
    frame = spark.createDataFrame([("h", 1, "svc", None), ("h", 2, " ", None)], "host string, ingest_seq bigint, name string, display_name string")
    full = frame.select("*", *[F.lit("x").alias(c) for c in ("path_name", "state", "start_mode", "service_type", "start_name")], F.current_timestamp().alias("ts"))
    rows = artifacts.service_events(full).select(field(F.col("fields"), "ServiceName").alias("n"), "summary").collect()
    assert [(r["n"], r["summary"]) for r in rows] == [("svc", "Service: svc () — x/x")]
