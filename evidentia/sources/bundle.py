"""Snapshot bundles: timelines, manifests, entity lists, hash files, case repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys, times
from ..functions.artifacts import resolve_reference
from ..operators.integrity import parse_hash_lines
from ..schema import EVENT_SCHEMA, EVIDENCE
from ..session import cut_lineage

EVENT_JSON = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "timestamp",
            "category",
            "action",
            "subjectProcess",
            "subjectUser",
            "objectFile",
            "objectRegistry",
            "objectNetworkFlow",
            "objectUrl",
            "summary",
            "confidence",
        )
    ]
    + [
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "evidence",
            T.ArrayType(
                T.StructType(
                    [T.StructField(n, T.StringType()) for n in ("source", "reference", "hash", "collectedAt")]
                )
            ),
        ),
    ]
)
TIMELINE_JSON = T.StructType([T.StructField("events", T.ArrayType(EVENT_JSON))])

_text, _flag = T.StringType(), T.BooleanType()
_PREFLIGHT = T.StructType(
    [
        T.StructField("isAdministrator", _flag),
        T.StructField("registryMode", _text),
        T.StructField("modeProfile", _text),
        T.StructField("errors", T.ArrayType(_text)),
        T.StructField("warnings", T.ArrayType(_text)),
    ]
)
_SUMMARY = T.StructType(
    [
        T.StructField(n, _text)
        for n in (
            "sourceEventCount",
            "exportedEventCount",
            "eventCap",
            "etwDroppedEventTotal",
            "uiBackpressureDroppedTotal",
            "failedEvidenceReferenceCount",
            "skippedEvidenceReferenceCount",
            "copiedArtifactFileCount",
            "evidenceReferenceCount",
            "artifactCopyWarning",
        )
    ]
    + [
        T.StructField(n, _flag)
        for n in ("wasEventCountCapped", "wasArtifactCopyIncomplete", "usedVssSnapshotForArtifactCopy")
    ]
)
MANIFEST_JSON = T.StructType(
    [
        T.StructField("complete", _flag),
        T.StructField("toolVersion", _text),
        T.StructField("collectionId", _text),
        T.StructField("collectionTime", _text),
        T.StructField("registryMode", _text),
        T.StructField("registryLiveEnabled", _flag),
        T.StructField("modeProfile", _text),
        T.StructField("host", T.StructType([T.StructField("hostname", _text), T.StructField("machineSid", _text)])),
        T.StructField("collectionSummary", _SUMMARY),
        T.StructField("preflight", _PREFLIGHT),
    ]
)


#: Bytes up to which one task parses a document as a whole.
LARGE_DOCUMENT = 64 << 20


def path_part(path: Column, from_end: int) -> Column:
    """Path segment counted from the file name (0), URL-decoded."""
    parts = F.split(path, "/")
    return F.try_url_decode(F.element_at(parts, -1 - from_end))


def events_from_struct(ev: Column, base_directory: Column | None = None) -> dict[str, Column]:
    """Event columns of one parsed JSON event."""
    base = F.lit(None).cast("string") if base_directory is None else base_directory
    evidence = F.transform(
        ev["evidence"],
        lambda e: F.struct(
            F.coalesce(e["source"], F.lit("")).alias("source"),
            resolve_reference(F.coalesce(e["reference"], F.lit("")), base).alias("reference"),
            e["hash"].alias("hash"),
            times.parse_iso(e["collectedAt"]).alias("collected_at"),
        ),
    )
    return {
        "ts": times.parse_iso(ev["timestamp"]),
        "ts_ticks": times.iso_ticks(ev["timestamp"]),
        "category": ev["category"],
        "action": ev["action"],
        "subject_process": keys.parse_process_key(ev["subjectProcess"]),
        "subject_user": keys.parse_user_key(ev["subjectUser"]),
        "object_file": keys.parse_file_key(ev["objectFile"]),
        "object_registry": keys.parse_registry_key(ev["objectRegistry"]),
        "object_flow": keys.parse_flow_key(ev["objectNetworkFlow"]),
        "object_url": ev["objectUrl"],
        "summary": ev["summary"],
        "fields": F.coalesce(ev["fields"], F.create_map().cast("map<string,string>")),
        "evidence": F.coalesce(evidence, F.array().cast(EVIDENCE)).cast(EVIDENCE),
        "confidence": F.coalesce(ev["confidence"], F.lit("Medium")),
    }


def _select_events(rows: DataFrame, ev: Column, host: Column, collection: Column, seq: Column, base: Column | None) -> DataFrame:
    columns = events_from_struct(ev, base)
    columns.update(host=host, collection_id=collection, ingest_seq=seq)
    parsed = rows.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA])
    return parsed.where(F.col("ts").isNotNull() & F.col("category").isNotNull() & F.col("action").isNotNull())


def read_timeline(
    spark: SparkSession,
    path: str | list[str],
    host: str | None = None,
    collection_id: str | None = None,
    base_directory: str | None = None,
) -> DataFrame:
    """Events of timeline documents; position in the document is the arrival number.

    Events without time, category or action are dropped. Host and collection
    come from the two folders above the file unless given. Documents of more than
    ``LARGE_DOCUMENT`` bytes are read in pieces by :func:`read_large_timeline`;
    the parser would hold a whole document in one task.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", (F.col("length") > LARGE_DOCUMENT).alias("large"))
    if not listed.where("large").isEmpty():
        names = listed.collect()  # one name a document
        small, large = ([row["path"] for row in names if row["large"] == kind] for kind in (False, True))
        rows = read_large_timeline(spark, large, host, collection_id, base_directory)
        return rows.unionByName(_read_small(spark, small, host, collection_id, base_directory)) if small else rows
    return _read_small(spark, path, host, collection_id, base_directory)


def _read_small(spark: SparkSession, path: str | list[str], host: str | None, collection_id: str | None, base_directory: str | None) -> DataFrame:
    documents = (
        spark.read.schema(TIMELINE_JSON).option("multiLine", True).json(path).select("events", "_metadata.file_path")
    )
    rows = documents.select("file_path", F.posexplode("events").alias("pos", "ev"))
    folder = F.regexp_replace(F.col("file_path"), r"/[^/]*$", "")
    base = F.lit(base_directory) if base_directory else F.regexp_replace(folder, "^file:/*", "/")
    return _select_events(
        rows,
        F.col("ev"),
        F.lit(host) if host else _bundle_part("file_path", 1),
        F.lit(collection_id) if collection_id else _bundle_part("file_path", 0),
        F.col("pos"),
        base,
    )


def read_large_timeline(
    spark: SparkSession,
    path: str | list[str],
    host: str | None = None,
    collection_id: str | None = None,
    base_directory: str | None = None,
) -> DataFrame:
    """As :func:`read_timeline`, for documents of any size: no task or row holds one.

    The text is read in pieces that end with a closing brace, from all splits of
    a file at once. What a piece changes (whether it ends inside a string, how
    many objects are open) is added up within each split and carried over the
    splits, which tells the pieces of one event; they are put together and parsed.
    Any object one level below the document counts as an event when numbering.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block")
    )
    pieces = cut_lineage(pieces.withColumn("place", F.monotonically_increasing_id()))
    # Without escapes, every other stretch between quotes is a string.
    stretches = F.split(F.regexp_replace("value", r"\\.", ""), '"', -1)
    opened = lambda odd: F.aggregate(
        F.transform("stretches", lambda x, i: F.when(i % 2 == odd, F.length(x) - F.length(F.replace(x, F.lit("{"), F.lit("")))).otherwise(0)), F.lit(0), lambda a, x: a + x
    )
    counted = pieces.withColumn("stretches", stretches).select(
        "file_path", "block", "place", (F.size("stretches") - 1).alias("quotes"), opened(0).alias("outside"), opened(1).alias("inside")
    )
    counted = _carried(counted, "quotes", "quoted")
    starts_inside, ends_inside = F.pmod("quoted", F.lit(2)) == 1, F.pmod(F.col("quoted") + F.col("quotes"), F.lit(2)) == 1
    depths = counted.select("file_path", "block", "place", F.when(starts_inside, F.col("inside")).otherwise(F.col("outside")).alias("opens"), F.when(ends_inside, 0).otherwise(1).alias("closes"))
    depths = _carried(depths.withColumn("change", F.col("opens") - F.col("closes")), "change", "depth")
    # Depth 1 is the document, so a piece that closes down to it ends an event.
    ends = depths.withColumn("ended", ((F.col("depth") + F.col("change") == 1) & (F.col("closes") == 1)).cast("int"))
    numbered = _carried(ends, "ended", "number").select("file_path", "block", "place", "number")
    whole = (
        pieces.join(numbered, ["file_path", "block", "place"]).groupBy("file_path", "number")
        .agg(F.array_sort(F.collect_list(F.struct("block", "place", "value"))).alias("pieces"))
    )
    text = F.concat(F.array_join(F.transform("pieces", lambda x: x["value"]), "}"), F.lit("}"))
    # Before the first event stands the beginning of the document, before the others a comma.
    text = F.when(F.col("number") == 0, F.regexp_replace(text, r"^[^\[]*\[", "")).otherwise(F.regexp_replace(text, r"^[\s,]+", ""))
    folder = F.regexp_replace(F.col("file_path"), r"/[^/]*$", "")
    return _select_events(
        whole.select("*", F.explode(F.array(F.from_json(text, EVENT_JSON))).alias("ev")),
        F.col("ev"),
        F.lit(host) if host else _bundle_part("file_path", 1),
        F.lit(collection_id) if collection_id else _bundle_part("file_path", 0),
        F.col("number"),
        F.lit(base_directory) if base_directory else F.regexp_replace(folder, "^file:/*", "/"),
    )


def _carried(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over all earlier pieces of the file, by splits."""
    inside = Window.partitionBy("file_path", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("file_path", "block").agg(F.sum(value).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    summed = rows.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0))).join(splits, ["file_path", "block"])
    return summed.withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def _bundle_part(path: str, above: int) -> Column:
    """Folder name of a collection (0) or of its host (1); a ``snapshot_*`` folder below a collection is part of it."""
    column = F.col(path)
    nested = F.lower(path_part(column, 1)).startswith("snapshot_")
    return F.when(nested, path_part(column, 2 + above)).otherwise(path_part(column, 1 + above))


def timeline_paths(spark: SparkSession, root: str) -> list[str]:
    """One timeline for each collection folder below ``<root>/<host>``: its own, else that of its first ``snapshot_*`` folder."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "timeline.json").load(root)
        .select("path", _bundle_part("path", 1).alias("host"), _bundle_part("path", 0).alias("collection"), F.upper(path_part(F.col("path"), 1)).alias("folder"))
    )
    nested = F.col("folder").startswith("SNAPSHOT_")
    first = listed.groupBy("host", "collection").agg(F.min_by("path", F.struct(nested, "folder")).alias("path"))
    return sorted(row["path"] for row in first.collect())  # one name a collection


def read_timeline_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Events of line-delimited timelines (our own scalable bundle form)."""
    schema = T.StructType(
        [
            T.StructField("host", _text),
            T.StructField("collection_id", _text),
            T.StructField("ingest_seq", T.LongType()),
            *EVENT_JSON.fields,
        ]
    )
    rows = spark.read.schema(schema).json(path)
    ev = F.struct(*[F.col(f.name) for f in EVENT_JSON])
    return _select_events(
        rows, ev, F.col("host"), F.col("collection_id"), F.col("ingest_seq"), None
    )


def parse_events(rows: DataFrame, json: str = "json", base_directory: Column | None = None) -> DataFrame:
    """Tolerant parse of one event document per row (``host, collection_id, ingest_seq, json``)."""
    # Exploded out of an array of one, so that the checks of time, category and action parse nothing again.
    parsed = rows.select("*", F.explode(F.array(F.from_json(F.col(json), EVENT_JSON))).alias("_ev"))
    return _select_events(
        parsed, F.col("_ev"), F.col("host"), F.col("collection_id"), F.col("ingest_seq"), base_directory
    )


def read_case_repository(spark: SparkSession, root: str, large: bool = False) -> DataFrame:
    """Every bundle below ``<root>/<host>/<collection>``; ``large`` reads documents of any size.

    What :func:`evidentia.sinks.repository.publish` writes is read by
    :func:`evidentia.sinks.repository.read_published`.
    """
    paths = timeline_paths(spark, root)
    return read_large_timeline(spark, paths) if large else read_timeline(spark, paths)


def parse_manifests(rows: DataFrame, text: str = "text") -> DataFrame:
    """Manifest documents (``host, collection_id, text``) as flat, typed rows.

    Counts may be numbers or numeric text. A document that is no JSON object
    keeps its row with ``manifest_present`` false.
    """
    document = F.col(text)
    readable = F.try_parse_json(document).isNotNull() & F.ltrim(document).startswith("{")
    parsed = rows.withColumns({"_m": F.from_json(document, MANIFEST_JSON), "_ok": F.coalesce(readable, F.lit(False))})
    m, s, p = F.col("_m"), F.col("_m.collectionSummary"), F.col("_m.preflight")

    def count(name: str) -> Column:
        return F.when(s[name].rlike(r"^\s*[+-]?\d{1,18}\s*$"), s[name].try_cast("bigint"))

    present = F.get_json_object(document, "$.preflight").startswith("{")
    blankless = lambda a: F.filter(a, lambda x: F.length(F.trim(x)) > 0)
    return parsed.select(
        *[c for c in rows.columns if c != text],
        F.col("_ok").alias("manifest_present"),
        m["complete"].alias("complete"),
        m["toolVersion"].alias("tool_version"),
        m["collectionTime"].alias("collection_time"),
        m["host"]["hostname"].alias("hostname"),
        s["wasEventCountCapped"].alias("was_event_count_capped"),
        count("sourceEventCount").alias("source_event_count"),
        count("exportedEventCount").alias("exported_event_count"),
        count("eventCap").alias("event_cap"),
        count("etwDroppedEventTotal").alias("trace_dropped_total"),
        count("uiBackpressureDroppedTotal").alias("render_dropped_total"),
        count("failedEvidenceReferenceCount").alias("failed_evidence_count"),
        count("skippedEvidenceReferenceCount").alias("skipped_evidence_count"),
        s["wasArtifactCopyIncomplete"].alias("was_artifact_copy_incomplete"),
        s["artifactCopyWarning"].alias("artifact_copy_warning"),
        count("copiedArtifactFileCount").alias("copied_artifact_count"),
        count("evidenceReferenceCount").alias("evidence_count"),
        s["usedVssSnapshotForArtifactCopy"].alias("used_shadow_copy"),
        F.coalesce(present, F.lit(False)).alias("preflight_present"),
        blankless(p["errors"]).alias("preflight_errors"),
        blankless(p["warnings"]).alias("preflight_warnings"),
        p["isAdministrator"].alias("is_administrator"),
        F.coalesce(m["registryMode"], p["registryMode"]).alias("registry_mode"),
        m["registryLiveEnabled"].alias("registry_live_enabled"),
        F.coalesce(m["modeProfile"], p["modeProfile"]).alias("mode_profile"),
    )


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """One typed row per ``<root>/<host>/<collection>`` folder.

    A bundle is any folder that holds a timeline or a manifest; one without a
    readable manifest keeps its row.
    """
    base = root.rstrip("/")
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "{manifest,timeline}.json")
        .load(base)
        .select(path_part(F.col("path"), 2).alias("host"), path_part(F.col("path"), 1).alias("collection_id"))
        .distinct()
    )
    texts = spark.read.option("wholetext", True).text(f"{base}/*/*/manifest.json").select(
        path_part(F.col("_metadata.file_path"), 2).alias("host"),
        path_part(F.col("_metadata.file_path"), 1).alias("collection_id"),
        F.col("value").alias("text"),
    )
    return parse_manifests(found.join(texts, ["host", "collection_id"], "left"))


ENTITY_LISTS = {
    "processes": "bootId decimal(20;0), processId bigint, createTime string",
    "users": "sid string",
    "files": "volumeSerial string, fileId decimal(20;0), path string, hash string",
    "networkFlows": "protocol string, localEndpoint string, remoteEndpoint string, processId bigint, timeBucket string",
}


def read_entities(spark: SparkSession, path: str | list[str]) -> dict[str, DataFrame]:
    """Entity lists of bundles, one frame per array of ``entities.json``."""
    return _entity_lists(spark.read.schema(_entity_schema()).option("multiLine", True).json(path))


def read_entity_lines(spark: SparkSession, path: str | list[str]) -> dict[str, DataFrame]:
    """The same lists from line-delimited parts."""
    return _entity_lists(spark.read.schema(_entity_schema()).json(path))


def _entity_schema() -> str:
    return ", ".join(f"{name} array<struct<{_struct(fields)}>>" for name, fields in ENTITY_LISTS.items())


def _entity_lists(documents: DataFrame) -> dict[str, DataFrame]:
    tagged = documents.select(
        path_part(F.col("_metadata.file_path"), 2).alias("host"),
        path_part(F.col("_metadata.file_path"), 1).alias("collection_id"),
        *ENTITY_LISTS,
    )
    return {
        name: tagged.select("host", "collection_id", F.explode(name).alias("e")).select(
            "host", "collection_id", "e.*"
        )
        for name in ENTITY_LISTS
    }


def _struct(fields: str) -> str:
    pairs = [f.strip().split(" ", 1) for f in fields.split(",")]
    return ", ".join(f"{n}: {t.replace(';', ',')}" for n, t in pairs)


def read_declared_hashes(spark: SparkSession, root: str) -> DataFrame:
    """Entries of every ``<root>/<host>/<collection>/hashes.txt``."""
    lines = spark.read.text(f"{root.rstrip('/')}/*/*/hashes.txt").select(
        path_part(F.col("_metadata.file_path"), 2).alias("host"),
        path_part(F.col("_metadata.file_path"), 1).alias("collection_id"),
        "value",
    )
    return parse_hash_lines(lines)


def read_actual_hashes(spark: SparkSession, root: str) -> DataFrame:
    """SHA-256 and bundle-relative path of every file below ``<root>/<host>/<collection>/``."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    plain = F.regexp_replace(F.try_url_decode("path"), r"^[a-z0-9]+:/*", "/")
    below = F.substring(plain, len(_plain(base)) + 2, 2**31 - 1)
    parts = F.split(below, "/", 3)
    return files.select(
        F.get(parts, F.lit(0)).alias("host"),
        F.get(parts, F.lit(1)).alias("collection_id"),
        F.get(parts, F.lit(2)).alias("relative_path"),
        F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("size"),
    ).where(F.col("relative_path").isNotNull())


def _plain(path: str) -> str:
    return "/" + path.split(":", 1)[-1].lstrip("/") if ":" in path else path


def read_session(spark: SparkSession, folder: str, supported_version: int = 1) -> tuple[DataFrame, DataFrame]:
    """Events of a saved session and a one-row outcome.

    The outcome is ``Loaded``, ``UnsupportedSchemaVersion`` (nothing is read) or
    ``MissingOrEmptyTimeline`` (the meta row promises events that are absent).
    """
    base = folder.rstrip("/")
    meta = spark.read.schema("sessionSchemaVersion int, eventCount bigint, savedAt string").json(f"{base}/meta")
    events = read_timeline_lines(spark, f"{base}/timeline")
    gate = meta.agg(
        F.coalesce(F.max("sessionSchemaVersion"), F.lit(0)).alias("schema_version"),
        F.coalesce(F.max("eventCount"), F.lit(0)).alias("promised"),
    )
    loaded = events.agg(F.count("*").alias("event_count"))
    supported = gate.where(F.col("schema_version") <= supported_version).select(F.lit(1).alias("_ok"))
    outcome = gate.withColumn("_one", F.lit(1)).join(loaded.withColumn("_one", F.lit(1)), "_one").select(
        "schema_version",
        "promised",
        "event_count",
        F.when(F.col("schema_version") > supported_version, F.lit("UnsupportedSchemaVersion"))
        .when((F.col("promised") > 0) & (F.col("event_count") == 0), F.lit("MissingOrEmptyTimeline"))
        .otherwise(F.lit("Loaded"))
        .alias("outcome"),
    )
    kept = events.withColumn("_ok", F.lit(1)).join(supported, "_ok", "left_semi").drop("_ok")
    return kept, outcome
