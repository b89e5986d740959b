"""Case repository: publish collections once, and report what is already there.

A collection is the partition ``host=…/collection_id=…`` of a Parquet table. A
publish writes only partitions that are new or no longer match their source,
and replaces exactly those, so retrying is safe after any failure.

Beside the partitions, ``_commits`` holds a record for each publish of a
collection: its rows and digest, and before them an open record without a
digest. The last record counts, so what a publish left half done is neither read
nor taken for present, and a publish reads records, never the repository's rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT_SCHEMA
from ..session import cut_lineage

KEYS = ["host", "collection_id"]


def sanitize_segment(name: Column) -> Column:
    """Folder-safe host or collection name."""
    return F.regexp_replace(F.trim(name), r'[<>:"/\\|?*\x00-\x1F]', "_")


COMMITS = "_commits"
COMMIT = "number bigint, host string, collection_id string, rows bigint, digest decimal(38,0)"


def commits(spark: SparkSession, root: str) -> DataFrame | None:
    """The last record of each collection, or None if the repository does not exist yet; other failures are raised."""
    try:
        records = spark.read.schema(COMMIT).parquet(f"{root.rstrip('/')}/{COMMITS}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    last = F.max_by(F.struct("rows", "digest"), F.struct("number", F.col("digest").isNotNull())).alias("last")
    return records.groupBy(*KEYS).agg(last, F.max("number").alias("number")).select(*KEYS, "number", "last.rows", "last.digest")


def published(spark: SparkSession, root: str) -> DataFrame | None:
    """Rows and content digest per published collection, or None for an empty repository."""
    found = commits(spark, root)
    return None if found is None else found.where("digest is not null").select(*KEYS, "rows", "digest")


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """The events of all published collections."""
    done = published(spark, root)
    rows = spark.read.schema(EVENT_SCHEMA).parquet(root).select(*EVENT_SCHEMA.names)
    return rows.limit(0) if done is None else rows.join(done.select(*KEYS), KEYS, "left_semi").select(*EVENT_SCHEMA.names)


def _record(plan: DataFrame, number: int, digest: Column, root: str) -> None:
    rows = plan.where("decision = 'Publish'").select(F.lit(number).cast("bigint").alias("number"), *KEYS, "rows", digest.cast("decimal(38,0)").alias("digest"))
    rows.write.mode("append").parquet(f"{root.rstrip('/')}/{COMMITS}")


def digests(events: DataFrame) -> DataFrame:
    """Order-free digest per collection: count and sum of row hashes."""
    columns = [F.to_json(F.col(c)) if c in ("fields", "evidence") else F.col(c) for c in EVENT_SCHEMA.names]
    row_hash = F.xxhash64(*columns).cast("decimal(38,0)")
    return events.groupBy(*KEYS).agg(F.count("*").alias("rows"), F.sum(row_hash).alias("digest"))


def publish_plan(source: DataFrame, verified: DataFrame, present: DataFrame | None) -> DataFrame:
    """Per collection of ``source``: Failed (not verified), AlreadyPresent or Publish.

    ``verified`` holds ``host, collection_id, status`` from the integrity check.
    """
    wanted = digests(source).join(verified, KEYS, "left")
    if present is None:
        matched = wanted.withColumn("_match", F.lit(None).cast("boolean"))
    else:
        known = present.select(*KEYS, F.col("rows").alias("_rows"), F.col("digest").alias("_digest"))
        matched = wanted.join(known, KEYS, "left").withColumn(
            "_match", (F.col("rows") == F.col("_rows")) & (F.col("digest") == F.col("_digest"))
        )
    decision = (
        F.when(~F.col("status").eqNullSafe(F.lit("Verified")), F.lit("Failed"))
        .when(F.coalesce(F.col("_match"), F.lit(False)), F.lit("AlreadyPresent"))
        .otherwise(F.lit("Publish"))
    )
    return matched.select(*KEYS, "rows", "digest", decision.alias("decision"))


def publish(source: DataFrame, verified: DataFrame, root: str) -> DataFrame:
    """Publish verified collections and return the plan that was carried out."""
    spark = source.sparkSession
    plan = cut_lineage(publish_plan(source, verified, published(spark, root)))  # one row per collection
    todo = plan.where("decision = 'Publish'").select(*KEYS)
    if not todo.isEmpty():
        before = commits(spark, root)
        number = 1 + ((before.agg(F.max("number")).first()[0] or 0) if before is not None else 0)
        _record(plan, number, F.lit(None), root)
        rows = source.select(*EVENT_SCHEMA.names).join(todo, KEYS, "left_semi")
        (
            rows.repartition(*KEYS, F.pmod(F.xxhash64("ingest_seq"), F.lit(64)))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*KEYS)
            .parquet(root)
        )
        _record(plan, number, F.col("digest"), root)
    return plan.drop("digest")


def case_status(expected: DataFrame, staged: DataFrame) -> DataFrame:
    """Per collection: files expected, already staged with the same hash, and still missing.

    Both sides are ``host, collection_id, relative_path, sha256``.
    """
    fold = lambda df, name: df.select(
        *KEYS, F.lower("relative_path").alias("path"), F.lower("sha256").alias(name)
    ).groupBy(*KEYS, "path").agg(F.max(name).alias(name))
    joined = fold(expected, "want").join(fold(staged, "have"), [*KEYS, "path"], "left")
    staged_ok = F.coalesce(F.col("want") == F.col("have"), F.lit(False))
    return joined.groupBy(*KEYS).agg(
        F.count("*").alias("expected_files"),
        F.count_if(staged_ok).alias("staged_files"),
        F.count_if(~staged_ok).alias("missing_files"),
        F.bool_and(staged_ok).alias("complete"),
    )
