"""Write bundles: timeline, entities, manifest and hash list.

The scalable form is a folder of line-delimited parts. A single document is
written only on request, for exports known to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys, times
from ..functions.artifacts import rewrite_reference
from ..functions.text import not_blank
from ..operators.processes import entities
from ..operators.ranking import keep_first
from ..session import setting

EXPORT_CAP = 500_000
OPEN_FILES = 64  # line files a task writes side by side; beyond that Spark sorts the rest by folder
SESSION_VERSION = 1
SNAPSHOT_FORMAT = "1.0"


def event_struct(rewritten: Column | None = None) -> Column:
    """One event as the JSON struct of a timeline; null members vanish when written.

    ``rewritten`` is an optional map from evidence reference to bundled path.
    """
    def evidence(e: Column) -> Column:
        reference = e["reference"]
        if rewritten is not None:
            reference = rewrite_reference(reference, F.try_element_at(rewritten, e["reference"]))
        return F.struct(
            e["source"].alias("source"),
            reference.alias("reference"),
            not_blank(e["hash"]).alias("hash"),
            times.format_iso(e["collected_at"]).alias("collectedAt"),
        )

    ticks = F.pmod(F.col("ts_ticks"), F.lit(10)).cast("string")
    micros = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    stamp = F.concat(micros, F.coalesce(ticks, F.lit("0")), F.lit("Z"))
    return F.struct(
        stamp.alias("timestamp"),
        F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce("action", F.lit("")).alias("action"),
        F.col("subject_process.key").alias("subjectProcess"),
        keys.user_key_text(F.col("subject_user")).alias("subjectUser"),
        keys.file_key_text(F.col("object_file")).alias("objectFile"),
        keys.registry_key_text(F.col("object_registry")).alias("objectRegistry"),
        F.col("object_flow.key").alias("objectNetworkFlow"),
        not_blank(F.col("object_url")).alias("objectUrl"),
        not_blank(F.col("summary")).alias("summary"),
        F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields"),
        F.transform("evidence", evidence).alias("evidence"),
        F.coalesce("confidence", F.lit("Medium")).alias("confidence"),
    )


def event_json(rewritten: Column | None = None) -> Column:
    return F.to_json(event_struct(rewritten), {"ignoreNullFields": "true"})


def write_timeline_lines(events: DataFrame, path: str, cap: int = 0) -> None:
    """Line-delimited timeline parts with host, collection and arrival number."""
    rows = keep_first(events, cap).withColumn("_e", event_struct())
    rows.select("host", "collection_id", "ingest_seq", "_e.*").write.mode("overwrite").json(path)


def write_timeline_parts(events: DataFrame, path: str, parts: int = 64) -> None:
    """Line-delimited timelines in a folder for each host and collection, each in ``parts`` files at most, dealt by arrival number."""
    rows = events.select("host", "collection_id", "ingest_seq", event_struct().alias("_e")).select("host", "collection_id", "ingest_seq", "_e.*")
    dealt = rows.repartition("host", "collection_id", F.pmod(F.xxhash64("ingest_seq"), F.lit(parts)))
    # A task has few folders: it keeps their files open side by side, and does not sort its wide rows by folder.
    with setting(events.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES)):
        dealt.write.mode("overwrite").partitionBy("host", "collection_id").json(path)


def bundle_documents(events: DataFrame, cap: int = 0) -> DataFrame:
    """One timeline document per collection, for small exports.

    The arrival cap of each collection bounds what is gathered into one document
    (0: everything; ``EXPORT_CAP`` is the usual value).
    """
    rows = keep_first(events, cap, keys=("host", "collection_id")).select("host", "collection_id", "ingest_seq", event_json().alias("json"))
    listed = F.array_sort(F.collect_list(F.struct("ingest_seq", "json")))
    body = F.array_join(F.transform(listed, lambda e: e["json"]), ",\n")
    return rows.groupBy("host", "collection_id").agg(
        F.concat(F.lit('{"events":[\n'), body, F.lit("\n]}")).alias("document")
    )


def write_documents(events: DataFrame, path: str, cap: int = 0) -> None:
    """One timeline document per collection, a file of ``<path>/host=…/collection=…``, of any size.

    A file has one writer: it takes the collection's events in order, sorted on
    disk if need be, and writes them line by line; no row or task holds a document.
    """
    # Folder names are never null, else the writer would sort the lines anew by names that it makes itself.
    folder = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    rows = keep_first(events, cap, keys=("host", "collection_id")).select(
        folder("host").alias("host"), folder("collection_id").alias("collection"), "ingest_seq", event_json().alias("json")
    )
    order = Window.partitionBy("host", "collection").orderBy("ingest_seq", "json")
    head = F.when(F.row_number().over(order) == 1, F.lit('{"events":[\n')).otherwise(F.lit(","))
    tail = F.when(F.lead(F.lit(1)).over(order).isNull(), F.lit("\n]}")).otherwise(F.lit(""))
    lines = rows.withColumn("value", F.concat(head, F.col("json"), tail))
    lines = lines.sortWithinPartitions("host", "collection", "ingest_seq", "json").select("host", "collection", "value")
    lines.write.mode("overwrite").partitionBy("host", "collection").text(path)


def write_entities(events: DataFrame, path: str) -> None:
    """Distinct processes, users, files and flows, one folder each."""
    renames = {
        "processes": {"boot_id": "bootId", "pid": "processId", "create_time": "createTime"},
        "users": {"sid": "sid"},
        "files": {"volume_serial": "volumeSerial", "file_id": "fileId", "path": "path", "hash": "hash"},
        "network_flows": {
            "protocol": "protocol",
            "local_ep": "localEndpoint",
            "remote_ep": "remoteEndpoint",
            "pid": "processId",
            "time_bucket": "timeBucket",
        },
    }
    for name, rows in entities(events).items():
        columns = [
            (times.format_iso(F.col(c)) if c in ("create_time", "time_bucket") else F.col(c)).alias(target)
            for c, target in renames[name].items()
        ]
        rows.select("host", *columns).write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")


def manifest_json(
    hostname: Column, collection_id: Column, tool_version: str, extras: dict[str, Column] | None = None
) -> Column:
    """Manifest text; extras replace standard members of the same name."""
    members: dict[str, Column] = {
        "toolVersion": F.lit(tool_version),
        "collectionId": collection_id,
        "collectionTime": times.format_iso(F.current_timestamp()),
        "host": F.struct(hostname.alias("hostname")),
        "snapshotFormat": F.lit(SNAPSHOT_FORMAT),
        "complete": F.lit(True),
    }
    members.update(extras or {})
    return F.to_json(F.struct(*[v.alias(k) for k, v in members.items()]))


def hash_lines(files: DataFrame) -> DataFrame:
    """``hash  relative path`` lines of ``host, collection_id, relative_path, sha256`` rows."""
    return files.where(F.lower("relative_path") != "hashes.txt").select(
        "host",
        "collection_id",
        F.concat(F.lower("sha256"), F.lit("  "), F.col("relative_path")).alias("value"),
    )


def write_session(events: DataFrame, folder: str, cap: int = 0) -> None:
    """Saved session: the first-arrived events and a meta row that counts them."""
    spark: SparkSession = events.sparkSession
    base = folder.rstrip("/")
    write_timeline_lines(events, f"{base}/timeline", cap)
    written = spark.read.text(f"{base}/timeline").count()
    meta = spark.range(1).select(
        F.lit(SESSION_VERSION).alias("sessionSchemaVersion"),
        F.lit(written).cast("bigint").alias("eventCount"),
        times.format_iso(F.current_timestamp()).alias("savedAt"),
    )
    meta.write.mode("overwrite").json(f"{base}/meta")
