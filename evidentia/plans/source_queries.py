"""Sources and sinks: the given tables written by a sink and read back by its source.

Everything is staged below the shared folder of the cluster.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.bags import field
from ..functions.keys import file_key_text
from ..functions.transfers import utf16_strings
from ..operators.integrity import compare_hashes, parse_hash_lines
from ..schema import MFT_SCHEMA
from ..session import staging_path
from ..sinks import bundle as bundle_sink
from ..sinks import exports, repository
from ..sinks import store as store_sink
from ..sources import bundle, eventlog, live, mft, registry, store, texts
from ..streaming import ingest
from .base import activity, big, iso_sql, joined_bytes, le_binary, padded_utf16, query, raw_events, spread, table, ticks, us, with_ev


def _seq():
    return F.col("ingest_seq").alias("seq")


_ROUND_TRIP = with_ev("""SELECT seq, us, host, category, action, process_key, sid, file_path, flow_key, url, summary, k::VARCHAR AS k, n_evidence::BIGINT AS n_evidence FROM evk""")


def _round_trip(events):
    return events.select(
        _seq(),
        us(F.col("ts")).alias("us"),
        "host",
        "category",
        "action",
        F.col("subject_process.key").alias("process_key"),
        F.col("subject_user.sid").alias("sid"),
        F.col("object_file.path").alias("file_path"),
        F.col("object_flow.key").alias("flow_key"),
        F.col("object_url").alias("url"),
        "summary",
        field(F.col("fields"), "k").alias("k"),
        big(F.size("evidence")).alias("n_evidence"),
    )


@query("snk_bundle_timeline", _ROUND_TRIP)
def snk_bundle_timeline(spark, sf):
    path = staging_path(spark, "timeline")
    bundle_sink.write_timeline_lines(activity(spark, sf), path)
    return _round_trip(bundle.read_timeline_lines(spark, path))


def _documents(spark, sf):
    """Timeline documents of the four hosts under ``<root>/host=…/…``, one file per host."""
    root = staging_path(spark, "bundles")
    events = activity(spark, sf)
    bundle_sink.write_documents(events.withColumn("collection_id", F.concat(F.col("collection_id"), F.lit("-x"))), root)
    return root


@query("src_bundle_timeline", _ROUND_TRIP.replace("SELECT seq, us, host", "SELECT row_number() OVER (PARTITION BY host ORDER BY seq) - 1 AS seq, us, 'host=' || host AS host"))
def src_bundle_timeline(spark, sf):
    return _round_trip(bundle.read_timeline(spark, f"{_documents(spark, sf)}/*/*"))


@query("src_large_timeline", _ROUND_TRIP.replace("SELECT seq, us, host", "SELECT row_number() OVER (PARTITION BY host ORDER BY seq) - 1 AS seq, us, 'host=' || host AS host"))
def src_large_timeline(spark, sf):
    """The same documents, read in pieces."""
    return _round_trip(bundle.read_large_timeline(spark, f"{_documents(spark, sf)}/*/*"))


@query("snk_timeline_parts", _ROUND_TRIP)
def snk_timeline_parts(spark, sf):
    folder = staging_path(spark, "parts")
    bundle_sink.write_timeline_parts(activity(spark, sf), folder, 4)
    return _round_trip(bundle.read_timeline_lines(spark, folder))


@query(
    "src_published_case",
    with_ev("SELECT host, 'C' || (seq % 3) AS collection_id, category, count(*)::BIGINT AS n, sum(seq)::BIGINT AS seqs FROM ev WHERE seq % 3 <> 2 GROUP BY ALL"),
)
def src_published_case(spark, sf):
    """Publish, then read back: the refused collection is not there."""
    root = staging_path(spark, "cases")
    ev = activity(spark, sf).withColumn("collection_id", F.concat(F.lit("C"), (F.col("ingest_seq") % 3).cast("string")))
    status = F.when(F.col("collection_id") == "C2", F.lit("Unverified")).otherwise(F.lit("Verified"))
    repository.publish(ev, ev.select("host", "collection_id").distinct().withColumn("status", status), root)
    return repository.read_published(spark, root).groupBy("host", "collection_id", "category").agg(F.count("*").alias("n"), F.sum("ingest_seq").alias("seqs"))


@query("src_case_repository", with_ev("SELECT 'host=' || host AS host, 'collection=C0-x' AS collection_id, category, count(*)::BIGINT AS n FROM ev GROUP BY host, category"))
def src_case_repository(spark, sf):
    events = bundle.read_timeline(spark, f"{_documents(spark, sf)}/*/*/*")
    return events.groupBy("host", "collection_id", "category").agg(F.count("*").alias("n"))


@query(
    "src_event_json",
    with_ev("SELECT seq, us, category, flow_key FROM evk WHERE k % 10 > 2"),
)
def src_event_json(spark, sf):
    k = field(F.col("fields"), "k").cast("int") % 10
    json = bundle_sink.event_json()
    broken = (
        F.when(k == 0, F.regexp_replace(json, '"timestamp":"[^"]*",', ""))
        .when(k == 1, F.regexp_replace(json, '"timestamp":"[^"]*"', '"timestamp":"soon"'))
        .when(k == 2, F.substring(json, 1, 40))
        .otherwise(json)
    )
    rows = activity(spark, sf).select("host", "collection_id", "ingest_seq", broken.alias("json"))
    return bundle.parse_events(rows).select(
        _seq(), us(F.col("ts")).alias("us"), "category", F.col("object_flow.key").alias("flow_key")
    )


_ENTITY_SQL = with_ev("""SELECT 'processes' AS kind, count(*)::BIGINT AS n FROM (SELECT DISTINCT process_key FROM ev) UNION ALL SELECT 'users', count(*) FROM (SELECT DISTINCT sid FROM ev)
  UNION ALL SELECT 'files', count(*) FROM (SELECT DISTINCT file_path FROM ev WHERE file_path IS NOT NULL) UNION ALL SELECT 'network_flows', count(*) FROM (SELECT DISTINCT host, flow_key FROM evk WHERE flow_key IS NOT NULL)""")


@query("snk_entities", _ENTITY_SQL)
def snk_entities(spark, sf):
    path = staging_path(spark, "entities")
    bundle_sink.write_entities(activity(spark, sf), path)
    counted = [
        spark.read.json(f"{path}/{kind}").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        for kind in ("processes", "users", "files", "network_flows")
    ]
    return counted[0].union(counted[1]).union(counted[2]).union(counted[3])


@query(
    "src_entities",
    with_ev("SELECT DISTINCT host, pid, boot_id::VARCHAR AS boot_id, epoch_us(created) AS created_us FROM ev"),
)
def src_entities(spark, sf):
    """Per host an ``entities.json``; the process lists come back exploded."""
    root = staging_path(spark, "entity-files")
    listed = activity(spark, sf).select("host", F.col("subject_process").alias("p")).distinct()
    item = F.struct(
        F.col("p.boot_id").alias("bootId"), F.col("p.pid").alias("processId"), F.col("p.create_time").cast("string").alias("createTime")
    )
    lines = listed.select(F.col("host"), F.lit("C0").alias("collection"), F.to_json(F.struct(F.array(item).alias("processes"))).alias("value"))
    lines.write.partitionBy("host", "collection").text(root)
    found = bundle.read_entity_lines(spark, f"{root}/*/*/*")["processes"]
    return found.select(
        F.replace("host", F.lit("host="), F.lit("")).alias("host"),
        F.col("processId").alias("pid"),
        F.col("bootId").cast("string").alias("boot_id"),
        us(F.col("createTime").cast("timestamp")).alias("created_us"),
    )


@query(
    "snk_manifest",
    "SELECT s_name AS hostname, 'c' || s_suppkey AS collection_id, '1.0' AS snapshot_format, s_suppkey % 2 = 0 AS complete, CASE WHEN s_nationkey >= 0 THEN s_nationkey END::VARCHAR AS nation FROM supplier",
)
def snk_manifest(spark, sf):
    document = bundle_sink.manifest_json(
        F.col("s_name"), F.concat(F.lit("c"), F.col("s_suppkey").cast("string")), "1.0",
        {"complete": F.col("s_suppkey") % 2 == 0, "nation": F.col("s_nationkey")},
    )
    rows = table(spark, sf, "supplier").select(document.alias("d"))
    pick = lambda path: F.get_json_object("d", path)
    return rows.select(
        pick("$.host.hostname").alias("hostname"),
        pick("$.collectionId").alias("collection_id"),
        pick("$.snapshotFormat").alias("snapshot_format"),
        (pick("$.complete") == "true").alias("complete"),
        pick("$.nation").alias("nation"),
    )


@query(
    "src_manifest",
    """SELECT o_orderkey::VARCHAR AS collection_id, o_orderkey % 7 <> 3 AS manifest_present, CASE WHEN o_orderkey % 7 <> 3 THEN o_orderkey % 2 = 0 END AS complete,
       CASE WHEN o_orderkey % 7 <> 3 THEN o_orderkey END AS source_event_count, CASE WHEN o_orderkey % 7 <> 3 AND o_orderkey % 3 <> 0 THEN o_custkey END AS trace_dropped_total,
       CASE WHEN o_orderkey % 7 <> 3 THEN 1 END::BIGINT AS n_errors, CASE WHEN o_orderkey % 7 <> 3 THEN o_orderpriority END AS mode_profile FROM orders""",
)
def src_manifest(spark, sf):
    key = F.col("o_orderkey")
    good = F.concat(
        F.lit('{"complete":'), (key % 2 == 0).cast("string"), F.lit(',"modeProfile":"'), F.col("o_orderpriority"),
        F.lit('","collectionSummary":{"sourceEventCount":'), key.cast("string"), F.lit(',"etwDroppedEventTotal":'),
        F.when(key % 3 == 0, F.lit('"n/a"')).when(key % 3 == 1, F.concat(F.lit('"'), F.col("o_custkey").cast("string"), F.lit('"'))).otherwise(F.col("o_custkey").cast("string")),
        F.lit('},"preflight":{"errors":["e"," "]}}'),
    )
    text = F.when(key % 7 == 3, F.lit('{"complete": tru')).otherwise(good)
    rows = table(spark, sf, "orders").select(F.lit("H0").alias("host"), key.cast("string").alias("collection_id"), text.alias("text"))
    return bundle.parse_manifests(rows).select(
        "collection_id", "manifest_present", "complete", "source_event_count", "trace_dropped_total",
        big(F.size("preflight_errors")).alias("n_errors"), "mode_profile",
    )


def _document_files(spark, sf):
    """Every document as a file of a bundle ``<root>/H0/B<n>/raw/``."""
    root = staging_path(spark, "raw")
    rows = table(spark, sf, "documents").select("text", F.concat(F.lit("B"), (F.col("doc_id") % 8).cast("string")).alias("bundle"))
    lines = rows.select("bundle", F.regexp_replace("text", r"\s+", " ").alias("value"))
    lines.repartition("bundle").write.partitionBy("bundle").text(f"{root}/H0")
    return root


@query("snk_hash_manifest", "SELECT DISTINCT 'bundle=B' || (doc_id % 8) AS collection_id, 'ok' AS status, 1::BIGINT AS n FROM documents")
def snk_hash_manifest(spark, sf):
    """Hash lines of staged files, read back and compared with the files: all must be ok."""
    actual = bundle.read_actual_hashes(spark, _document_files(spark, sf))
    declared = parse_hash_lines(bundle_sink.hash_lines(actual))
    checks = compare_hashes(declared, actual)
    return checks.groupBy("collection_id", "status").agg(F.count("*").alias("n"))


_CSV_SQL = with_ev(f"""SELECT {iso_sql("ts")} AS "Timestamp", category AS "Category", action AS "Action", summary AS "Summary", process_key AS "SubjectProcess", coalesce(file_key, '') AS "ObjectFile", coalesce(url, '') AS "ObjectUrl" FROM evk""")


@query("snk_timeline_csv", _CSV_SQL)
def snk_timeline_csv(spark, sf):
    path = staging_path(spark, "timeline-csv")
    exports.write_timeline_csv(activity(spark, sf), path, "2024-01-01", "2024-02-01")
    rows = spark.read.csv(path, header=True, quote='"', escape='"')
    names = ["Timestamp", "Category", "Action", "Summary", "SubjectProcess", "ObjectFile", "ObjectUrl"]
    return rows.select(*[F.coalesce(F.col(n), F.lit("")).alias(n) for n in names])


@query("snk_timeline_json", with_ev("SELECT seq, category, summary, sid AS user FROM ev"))
def snk_timeline_json(spark, sf):
    path = staging_path(spark, "timeline-json")
    exports.write_timeline_json(activity(spark, sf), path)
    names = [n[0].lower() + n[1:] for n in exports.TIMELINE_COLUMNS]
    rows = spark.read.schema(", ".join(f"{n} string" for n in names)).json(path)
    # Events may share a time or even a whole row: the n-th of equal rows belongs to the n-th of equal events.
    ev = exports.timeline_rows(activity(spark, sf), "ingest_seq").toDF(*names, "seq")
    ev = ev.withColumn("_nth", F.row_number().over(Window.partitionBy(*names).orderBy("seq")))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0))))
    return rows.join(ev, [*names, "_nth"]).select("seq", "category", "summary", F.substring("subjectUser", 3, 100).alias("user"))


def _entries(spark, sf):
    base = F.timestamp_seconds(F.col("c_custkey") + 1_600_000_000)
    values = {
        "host": F.lit("H0"), "source": F.lit("C:"), "record_index": F.col("c_custkey"), "file_name": F.col("c_name"),
        "full_path": F.concat(F.lit('C:\\a, "b"\\'), F.col("c_name")), "parent_record_index": big(F.col("c_nationkey")),
        "created_utc": base, "modified_utc": base, "created_utc_fn": F.lit(None), "modified_utc_fn": F.lit(None),
        "time_stomp_suspect": F.col("c_custkey") % 9 == 0, "is_in_use": F.col("c_custkey") % 2 == 0, "is_directory": F.lit(False),
    }
    return table(spark, sf, "customer").select(*[values[f.name].cast(f.dataType).alias(f.name) for f in MFT_SCHEMA])


_MFT_SQL = """SELECT c_custkey::VARCHAR AS record_index, 'C:\\a, "b"\\' || c_name AS full_path, strftime(make_timestamp((c_custkey + 1600000000) * 1000000), '%Y-%m-%dT%H:%M:%S.%f') || '0Z' AS created,
  (c_custkey % 2 = 0)::VARCHAR AS in_use FROM customer"""


def _mft_back(rows):
    return rows.select(
        F.col("RecordIndex").cast("string").alias("record_index"), F.col("FullPath").alias("full_path"),
        F.col("CreatedUtc").alias("created"), F.col("IsInUse").cast("string").alias("in_use"),
    )


@query("snk_mft_csv", _MFT_SQL)
def snk_mft_csv(spark, sf):
    path = staging_path(spark, "mft-csv")
    exports.write_mft_csv(_entries(spark, sf), path)
    return _mft_back(texts.read_reference_csv(spark, path))


@query("snk_mft_json", _MFT_SQL)
def snk_mft_json(spark, sf):
    path = staging_path(spark, "mft-json")
    exports.write_mft_json(_entries(spark, sf), path)
    return _mft_back(spark.read.schema("RecordIndex bigint, FullPath string, CreatedUtc string, IsInUse boolean").json(path))


@query("src_reference_csv", "SELECT doc_id::VARCHAR AS doc_id, lang, md5(replace(text, chr(13), '')) AS digest FROM documents")
def src_reference_csv(spark, sf):
    path = staging_path(spark, "truth")
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.replace("text", F.lit("\r"), F.lit("")).alias("text"))
    exports.write_csv(rows, path)
    back = texts.read_reference_csv(spark, path)
    return back.select("doc_id", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


_RANGE = ("2024-01-05 00:00:00", "2024-01-12 12:00:00")
_RANGE_SQL = "ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12 12:00:00'"


def _store(spark, sf):
    path = staging_path(spark, "store")
    store_sink.write_store(activity(spark, sf), path)
    return path


@query("snk_event_store", with_ev("SELECT strftime(ts, '%Y-%m-%d') AS event_date, category, count(*)::BIGINT AS n FROM ev GROUP BY 1, 2"))
def snk_event_store(spark, sf):
    rows = spark.read.parquet(_store(spark, sf))
    return rows.groupBy(F.col("event_date").cast("string").alias("event_date"), "category").agg(F.count("*").alias("n"))


@query("src_event_store", with_ev(f"SELECT seq, us, summary FROM ev WHERE {_RANGE_SQL} AND category = 'File' ORDER BY us, seq"))
def src_event_store(spark, sf):
    rows = store.in_time_order(store.read_store(spark, _store(spark, sf), *_RANGE, category="File"))
    return rows.select(_seq(), us(F.col("ts")).alias("us"), "summary")


@query("src_event_store_cat", with_ev("SELECT seq, summary FROM ev WHERE category = 'Network'"))
def src_event_store_cat(spark, sf):
    return store.read_category(spark, _store(spark, sf), "Network").select(_seq(), "summary")


@query("src_event_store_page", with_ev(f"SELECT seq, us FROM ev WHERE {_RANGE_SQL} ORDER BY ts, seq LIMIT 300 OFFSET 1200"))
def src_event_store_page(spark, sf):
    return store.read_page(spark, _store(spark, sf), 1200, 300, *_RANGE).select(_seq(), us(F.col("ts")).alias("us"))


@query("src_event_store_count", with_ev(f"SELECT count(*)::BIGINT AS event_count FROM ev WHERE {_RANGE_SQL} AND category = 'Process'"))
def src_event_store_count(spark, sf):
    return store.count_events(spark, _store(spark, sf), *_RANGE, category="Process")


@query("snk_store_migrate", with_ev("SELECT seq AS id, CASE WHEN k % 4 = 0 THEN '' ELSE category END AS category, '2' AS schema_version FROM ev"))
def snk_store_migrate(spark, sf):
    k = field(F.col("fields"), "k").cast("int") % 4
    data = F.when(k == 0, F.lit("{not json")).otherwise(bundle_sink.event_json())
    old = activity(spark, sf).select(F.col("ingest_seq").alias("id"), F.col("ts").alias("timestamp"), data.alias("data"))
    return store_sink.migrate_store(old).select("id", "category", "schema_version")


@query("snk_session", with_ev("SELECT seq, category FROM ev ORDER BY seq LIMIT 4000"))
def snk_session(spark, sf):
    folder = staging_path(spark, "session")
    bundle_sink.write_session(activity(spark, sf), folder, cap=4000)
    return bundle.read_session(spark, folder)[0].select(_seq(), "category")


@query("src_session", with_ev("SELECT 1::BIGINT AS schema_version, count(*)::BIGINT AS promised, count(*)::BIGINT AS event_count, 'Loaded' AS outcome FROM ev"))
def src_session(spark, sf):
    folder = staging_path(spark, "session")
    bundle_sink.write_session(activity(spark, sf), folder, cap=0)
    outcome = bundle.read_session(spark, folder)[1]
    return outcome.withColumn("schema_version", big(F.col("schema_version")))


@query(
    "snk_case_repository",
    with_ev("""SELECT host, 'C' || (seq % 3) AS collection_id, CASE WHEN seq % 3 = 2 THEN 'Failed' WHEN seq % 3 = 0 THEN 'AlreadyPresent' ELSE 'Publish' END AS decision, count(*)::BIGINT AS n FROM ev GROUP BY ALL"""),
)
def snk_case_repository(spark, sf):
    """Publish one collection, then all three: the first is skipped, the unverified one refused."""
    root = staging_path(spark, "cases")
    ev = activity(spark, sf).withColumn("collection_id", F.concat(F.lit("C"), (F.col("ingest_seq") % 3).cast("string")))
    verified = ev.select("host", "collection_id").distinct().withColumn(
        "status", F.when(F.col("collection_id") == "C2", F.lit("Unverified")).otherwise(F.lit("Verified"))
    )
    repository.publish(ev.where(F.col("collection_id") == "C0"), verified, root)
    plan = repository.publish(ev, verified, root)
    return plan.select("host", "collection_id", "decision", F.col("rows").alias("n"))


@query(
    "snk_case_status",
    "SELECT 'B' || (doc_id % 8) AS collection_id, count(*)::BIGINT AS expected_files, count(*) FILTER (doc_id % 5 <> 0 AND doc_id % 7 <> 0)::BIGINT AS staged_files, count(*) FILTER (doc_id % 5 = 0 OR doc_id % 7 = 0)::BIGINT AS missing_files FROM documents GROUP BY 1",
)
def snk_case_status(spark, sf):
    expected = table(spark, sf, "documents").select(
        F.lit("H0").alias("host"), F.concat(F.lit("B"), (F.col("doc_id") % 8).cast("string")).alias("collection_id"),
        F.concat(F.lit("raw/D"), F.col("doc_id").cast("string")).alias("relative_path"), F.sha2("text", 256).alias("sha256"), "doc_id",
    )
    staged = expected.where(F.col("doc_id") % 5 != 0).withColumns(
        {"relative_path": F.lower("relative_path"), "sha256": F.when(F.col("doc_id") % 7 == 0, F.lit("0")).otherwise(F.upper("sha256"))}
    )
    return repository.case_status(expected, staged).drop("host", "complete")


def _xml(parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _log_records(spark, sf):
    """Every event as an exported log record; one in ten is broken."""
    i, user = F.col("event_id"), F.col("user_id")
    number = F.when(F.col("event_type") == "signup", F.lit(4688)).when(F.col("event_type") == "error", F.lit(4689)).otherwise(F.lit(4624))
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("7Z"))
    xml = _xml([
        "<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System><Provider Name='Prov'/><EventID>", number, "</EventID><Level>4</Level><TimeCreated SystemTime='", stamp,
        "'/><EventRecordID>", i, "</EventRecordID><Execution ProcessID='", user + 1, "' ThreadID='1'/><Channel>Security</Channel><Computer>PC</Computer></System><EventData><Data Name='SubjectUserSid'>S-1-5-21-", user,
        "</Data><Data Name='Image'>a&amp;b.exe</Data><Data>loose</Data><Data Name='Empty'></Data></EventData></Event>",
    ])
    return spread(raw_events(spark, sf).select("event_id", "user_id", "event_type", "ts")).select(
        F.concat(F.lit("H"), (user % 4).cast("string")).alias("host"), F.lit("C0").alias("collection_id"), i.alias("ingest_seq"),
        F.when(i % 10 == 9, F.substring(xml, 1, 150)).otherwise(xml).alias("xml"),
    )


@query(
    "src_rendered_eventlog",
    """SELECT event_id AS seq, epoch_us(ts) AS us, epoch_us(ts) * 10 + 7 AS ticks, CASE event_type WHEN 'signup' THEN 'Process' WHEN 'error' THEN 'Process' ELSE 'Logon' END AS category,
         CASE event_type WHEN 'error' THEN 'Stop' ELSE 'Start' END AS action, user_id + 1 AS pid, 'S-1-5-21-' || user_id AS sid, 'a&b.exe' AS image, 'loose' AS loose,
         'Security Event ' || CASE event_type WHEN 'signup' THEN 4688 WHEN 'error' THEN 4689 ELSE 4624 END || ': 4 from Prov' AS summary, 'High' AS confidence
       FROM events WHERE event_id % 10 <> 9""",
)
def src_rendered_eventlog(spark, sf):
    events = eventlog.read_event_log(_log_records(spark, sf), F.lit(7))
    bag = F.col("fields")
    return events.select(
        _seq(), us(F.col("ts")).alias("us"), F.col("ts_ticks").alias("ticks"), "category", "action",
        F.col("subject_process.pid").alias("pid"), F.col("subject_user.sid").alias("sid"), field(bag, "Image").alias("image"),
        field(bag, "EventData_2").alias("loose"), "summary", "confidence",
    )


def _several_collections(records):
    """Two collections of every host whose numbers both start at the beginning; a third of the records name no process."""
    i = F.col("ingest_seq")
    silent = F.regexp_replace("xml", "<Execution [^>]*/>", "")
    return records.select(
        "*", F.concat(F.lit("C"), (i % 2).cast("string")).alias("of"), F.call_function("div", i, F.lit(2)).alias("number"), F.when(i % 3 == 0, silent).otherwise(F.col("xml")).alias("text")
    ).drop("collection_id", "ingest_seq", "xml").withColumnsRenamed({"of": "collection_id", "number": "ingest_seq", "text": "xml"})


# Lives without a stated create time: a first record, one after a Stop and one after a long silence start a life.
_LIVES = """p AS (SELECT *, lag(us) OVER w AS before, lag(stop) OVER w AS ended FROM r WHERE i % 3 <> 0 WINDOW w AS (PARTITION BY host, collection_id, pid ORDER BY seq)),
  l AS (SELECT *, last_value(CASE WHEN before IS NULL OR ended OR us - before > {minutes} * 60000000::BIGINT THEN us END IGNORE NULLS) OVER (PARTITION BY host, collection_id, pid ORDER BY seq) AS created FROM p)
  SELECT r.host, r.collection_id, r.seq, l.pid, l.created AS created_us FROM r LEFT JOIN l ON r.i = l.i"""


@query(
    "src_eventlog_lives",
    """WITH r AS (SELECT event_id AS i, 'H' || (user_id % 4) AS host, 'C' || (event_id % 2) AS collection_id, event_id // 2 AS seq, user_id + 1 AS pid, epoch_us(ts) AS us, event_type = 'error' AS stop FROM events WHERE event_id % 10 <> 9), """
    + _LIVES.format(minutes=720),
)
def src_eventlog_lives(spark, sf):
    """Process lives of event-log records, of each collection apart."""
    events = eventlog.read_event_log(_several_collections(_log_records(spark, sf)), F.lit(7))
    life = F.col("subject_process")
    return events.select("host", "collection_id", _seq(), life.pid.alias("pid"), us(life.create_time).alias("created_us"))


@query(
    "src_trace_lives",
    """WITH r AS (SELECT event_id AS i, 'H0' AS host, 'C' || (event_id % 2) AS collection_id, event_id // 2 AS seq, user_id + 1 AS pid, epoch_us(ts) AS us,
       event_id % 4 = 0 AND CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) % 3 = 2 AS stop FROM events), """
    + _LIVES.format(minutes=30),
)
def src_trace_lives(spark, sf):
    """Process lives of kernel-trace rows, of each collection apart."""
    events = eventlog.read_kernel_trace(_several_collections(_trace_records(spark, sf)), F.lit(7))
    life = F.col("subject_process")
    return events.select("host", "collection_id", _seq(), life.pid.alias("pid"), us(life.create_time).alias("created_us"))


def _trace_records(spark, sf):
    i, case = F.col("event_id"), F.col("event_id") % 4
    channel = F.when(case == 0, F.lit("Microsoft-Windows-Kernel-Process/Analytic")).when(case == 1, F.lit("Microsoft-Windows-Kernel-File/Analytic")).when(
        case == 2, F.lit("Microsoft-Windows-Kernel-Registry/Analytic")).otherwise(F.lit("Microsoft-Windows-Kernel-Network/Analytic"))
    opcode = F.when(case == 0, F.lit("Info")).when(case == 1, F.lit("CreateNewFile")).when(case == 2, F.lit("OpenKey")).otherwise(F.lit("TcpSend"))
    data = F.when(case == 1, _xml(["<Data Name='FileName'>C:\\f", i, "</Data>"])).when(case == 2, _xml(["<Data Name='KeyName'>K", i, "</Data>"])).when(
        case == 3, _xml(["<Data Name='saddr'>10.0.0.1</Data><Data Name='daddr'>fe80::1</Data><Data Name='sport'>", F.col("k"), "</Data><Data Name='dport'>0x50</Data><Data Name='Size'>5</Data>"])
    ).otherwise(F.lit("<Data Name='ImageName'>x.exe</Data>"))
    xml = _xml(["<Event><System><Execution ProcessID='", F.col("user_id") + 1, "'/></System><EventData>", data, "</EventData></Event>"])
    return spread(raw_events(spark, sf).select("event_id", "user_id", "ts", "k")).select(
        F.lit("H0").alias("host"), F.lit("C0").alias("collection_id"), i.alias("ingest_seq"), "ts", channel.alias("log_name"), i.alias("record_id"),
        F.when(case == 0, F.col("k") % 3).otherwise(F.lit(99)).alias("event_id"), opcode.alias("opcode"), F.lit("Info").alias("level"), F.lit("t").alias("task"), F.lit("p").alias("provider"), xml.alias("xml"),
    )


@query(
    "src_kernel_trace",
    """WITH e AS (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k, event_id % 4 AS c FROM events)
       SELECT event_id AS seq, CASE c WHEN 0 THEN 'Process' WHEN 1 THEN 'File' WHEN 2 THEN 'Registry' ELSE 'Network' END AS category,
         CASE c WHEN 0 THEN CASE k % 3 WHEN 1 THEN 'Start' WHEN 2 THEN 'Stop' ELSE 'Query' END WHEN 1 THEN 'Write' WHEN 2 THEN 'Open' ELSE 'Query' END AS action,
         CASE WHEN c = 1 THEN 'F:C:\\f' || event_id END AS file_key, CASE WHEN c = 2 THEN 'K' || event_id END AS registry_path, CASE WHEN c = 3 THEN '10.0.0.1:' || k END AS local_ep,
         CASE WHEN c = 3 THEN '[fe80::1]:80' END AS remote_ep, user_id + 1 AS pid, CASE WHEN c = 0 THEN 'x.exe' END AS process_name FROM e""",
)
def src_kernel_trace(spark, sf):
    events = eventlog.read_kernel_trace(_trace_records(spark, sf), F.lit(7))
    return events.select(
        _seq(), "category", "action", file_key_text(F.col("object_file")).alias("file_key"), F.col("object_registry.path").alias("registry_path"),
        F.col("object_flow.local_ep").alias("local_ep"), F.col("object_flow.remote_ep").alias("remote_ep"), F.col("subject_process.pid").alias("pid"),
        field(F.col("fields"), "ProcessName").alias("process_name"),
    )


def _hive_dump(spark, sf):
    """Registry values along ``orders``: listed and unlisted keys of three hives."""
    key, case = F.col("o_orderkey"), F.col("o_orderkey") % 6
    path = (
        F.when(case == 0, F.lit("ControlSet001\\Services\\svc1\\Sub"))
        .when(case == 1, F.lit("microsoft\\windows\\currentversion\\RUN"))
        .when(case == 2, F.lit("Microsoft\\Windows\\CurrentVersion\\Run\\Sub"))
        .when(case == 3, F.lit("Software\\Microsoft\\Windows\\CurrentVersion\\Explorer\\UserAssist\\{G}\\Count"))
        .when(case == 4, F.lit("ControlSet001\\Control\\Session Manager\\AppCompatCache"))
        .otherwise(F.lit("ControlSet003\\Services\\x"))
    )
    hive = F.when(case.isin(1, 2), F.lit("software")).when(case == 3, F.lit("NTUSER.DAT")).otherwise(F.lit("SYSTEM"))
    day = F.col("o_orderdate").cast("timestamp")
    shim = joined_bytes(le_binary(F.lit(0), 128), *[
        part for n in (1, 2) for part in (padded_utf16(F.concat(F.lit(f"C:\\a{n}\\"), key.cast("string")), 520), le_binary(F.lit(0), 32))
    ])
    assist = joined_bytes(le_binary(F.lit(1), 4), le_binary(key, 4), le_binary(ticks(day), 8))
    return table(spark, sf, "orders").select(
        F.lit("H0").alias("host"), F.lit("C0").alias("collection_id"), key.alias("ingest_seq"), hive.alias("hive"), F.lit("C:\\hives").alias("hive_path"), path.alias("key_path"),
        F.when(case == 0, F.lit("Start")).when(case == 3, F.lit("pzq.rkr")).when(case == 4, F.lit("AppCompatCache")).otherwise(F.lit("v")).alias("value_name"),
        F.lit("REG").alias("value_type"), F.when(case == 3, assist).when(case == 4, shim).alias("value_raw"), F.when(case == 0, F.lit("2")).otherwise(F.lit("text")).alias("value_text"), day.alias("last_write"),
    )


@query(
    "src_registry_values",
    r"""SELECT o_orderkey AS seq, CASE o_orderkey % 6 WHEN 0 THEN 'Services' WHEN 1 THEN 'Run' WHEN 3 THEN 'UserAssist' ELSE 'AppCompatCache' END AS query_name,
          CASE o_orderkey % 6 WHEN 0 THEN 'Services [svc1] Start: 2' WHEN 1 THEN 'Run: microsoft\windows\currentversion\RUN\v'
            WHEN 3 THEN 'UserAssist: cmd.exe (runs=' || o_orderkey || ', last=' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || 'Z)'
            ELSE 'AppCompatCache: ControlSet001\Control\Session Manager\AppCompatCache\AppCompatCache' END AS summary FROM orders WHERE o_orderkey % 6 IN (0, 1, 3, 4)
        UNION ALL SELECT o_orderkey, 'AppCompatCache', 'ShimCache (Win7_552): C:\a1\' || o_orderkey FROM orders WHERE o_orderkey % 6 = 4
        UNION ALL SELECT o_orderkey, 'AppCompatCache', 'ShimCache (Win7_552): C:\a2\' || o_orderkey FROM orders WHERE o_orderkey % 6 = 4""",
)
def src_registry_values(spark, sf):
    events = registry.registry_events(registry.select_values(_hive_dump(spark, sf)))
    return events.select(_seq(), field(F.col("fields"), "QueryName").alias("query_name"), "summary")


@query(
    "src_wmi_runs",
    r"""SELECT doc_id, (i - 1)::BIGINT AS pos, md5(r[i]) AS run FROM (SELECT doc_id, regexp_extract_all(text, '[\x20-\x7E]{3,}') AS r FROM documents), LATERAL (SELECT unnest(range(1, len(r) + 1)) AS i)""",
)
def src_wmi_runs(spark, sf):
    files = table(spark, sf, "documents").select(F.lit("H0").alias("host"), F.col("doc_id").alias("file"), F.encode("text", "UTF-8").alias("content"))
    return texts.printable_runs(files).select(F.col("file").alias("doc_id"), big(F.col("pos")).alias("pos"), F.md5("run").alias("run"))


@query("src_bits", "SELECT page_id, 2::BIGINT AS n, md5(url) AS first_string FROM pages")
def src_bits(spark, sf):
    raw = joined_bytes(
        F.unhex(F.lit("0100")), F.encode("url", "UTF-16LE"), F.unhex(F.lit("0000")), F.encode(F.lit("abc"), "UTF-16LE"), F.unhex(F.lit("1F00")), F.encode(F.lit("tail"), "UTF-16LE")
    )
    rows = table(spark, sf, "pages").select("page_id", utf16_strings(raw).alias("s"))
    return rows.select("page_id", big(F.size("s")).alias("n"), F.md5(F.get("s", F.lit(0))).alias("first_string"))


def mft_records(spark, sf):
    """A 1024-byte file record per customer, with update sequence, standard times and one name."""
    key = F.col("c_custkey")
    base = F.lit(133_500_000_000_000_000) + key * 10_000_000
    name = F.encode("c_name", "UTF-16LE")
    zero = lambda n: le_binary(F.lit(0), n)
    content_si = joined_bytes(le_binary(base, 8), le_binary(base, 8), zero(32))
    content_fn = joined_bytes(
        le_binary(key % 100, 8), le_binary(base + (key % 5) * 10_000_000, 8), le_binary(base, 8), zero(32),
        le_binary(F.when(key % 3 == 0, F.lit(0x10)).otherwise(F.lit(0x20)), 4), zero(4), le_binary(F.length("c_name"), 1), le_binary(F.lit(1), 1), name,
    )

    def attribute(kind, content):
        size = F.octet_length(content)
        return joined_bytes(
            le_binary(F.lit(kind), 4), le_binary(size + 24, 4), zero(8), le_binary(size, 4), le_binary(F.lit(24), 2), zero(2), content
        )

    body = joined_bytes(attribute(0x10, content_si), attribute(0x30, content_fn), F.unhex(F.lit("FFFFFFFF")), zero(4))
    header = joined_bytes(
        F.encode(F.when(key % 50 == 7, F.lit("BAAD")).otherwise(F.lit("FILE")), "US-ASCII"), le_binary(F.lit(0x30), 2), le_binary(F.lit(3), 2), zero(12),
        le_binary(F.lit(0x38), 2), le_binary(key % 2, 2), le_binary(F.octet_length(body) + 0x38, 4), le_binary(F.lit(1024), 4),
        le_binary(F.when(key % 40 == 9, F.lit(77)).otherwise(F.lit(0)), 8), zero(8), F.unhex(F.lit("AAAA")), zero(4), zero(2),
    )
    padded = F.rpad(F.hex(joined_bytes(header, body)), 2048, "0")
    marked = F.concat(F.substring(padded, 1, 1020), F.lit("AAAA"), F.substring(padded, 1025, 1020), F.lit("AAAA"))
    return table(spark, sf, "customer").select(
        F.lit("H0").alias("host"), F.lit("C:").alias("source"), key.alias("record_index"), F.unhex(marked).alias("record")
    )


@query(
    "src_mft_records",
    """SELECT c_custkey AS record_index, c_name AS file_name, c_custkey % 100 AS parent, (133500000000000000 + c_custkey * 10000000 - 116444736000000000) // 10 AS created_us,
         c_custkey % 5 > 2 AS suspect, c_custkey % 2 = 1 AS in_use, c_custkey % 3 = 0 AS is_directory FROM customer WHERE c_custkey % 50 <> 7 AND c_custkey % 40 <> 9""",
)
def src_mft_records(spark, sf):
    return mft.decode_records(mft_records(spark, sf)).select(
        "record_index", "file_name", F.col("parent_record_index").alias("parent"), us(F.col("created_utc")).alias("created_us"),
        F.col("time_stomp_suspect").alias("suspect"), F.col("is_in_use").alias("in_use"), "is_directory",
    )


def event_files(spark, sf, normalize=True):
    """The activity timeline as a folder that a stream can read."""
    path = staging_path(spark, "feed")
    activity(spark, sf, normalize).write.parquet(path)
    return path


@query("src_live_stream", with_ev("SELECT category, count(*)::BIGINT AS n FROM ev GROUP BY category"))
def src_live_stream(spark, sf):
    out = staging_path(spark, "live")
    stream = live.read_event_stream(spark, event_files(spark, sf))
    stream.writeStream.format("parquet").option("checkpointLocation", out + "-log").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).groupBy("category").agg(F.count("*").alias("n"))


_LIVE_SQL = with_ev("SELECT seq, action, CASE WHEN raw_action <> action THEN raw_action END AS original FROM ev")


def _live_table(spark, sf):
    out = staging_path(spark, "live-table")
    stream = live.read_event_stream(spark, event_files(spark, sf, normalize=False))
    ingest.normalize_append(stream, out, out + "-log", once=True).awaitTermination()
    return spark.read.parquet(out).select(_seq(), "action", field(F.col("fields"), "OriginalAction").alias("original"))


@query("snk_live_table", _LIVE_SQL)
def snk_live_table(spark, sf):
    return _live_table(spark, sf)


@query("st_normalize_append", _LIVE_SQL)
def st_normalize_append(spark, sf):
    return _live_table(spark, sf)
