"""Accounting of evidence files that a bundle copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.artifacts import artifact_directory, artifact_source_path, is_allowed_artifact


def evidence_outcomes(events: DataFrame, files: DataFrame, keys: tuple[str, ...] = ("host", "collection_id")) -> DataFrame:
    """One row per evidence reference: rewritten, skipped or failed.

    ``files`` lists the files that exist: ``host, file_path, copy_ok``.
    """
    refs = events.select(*keys, "ingest_seq", F.explode("evidence").alias("ref")).select(
        *keys, "ingest_seq", F.col("ref.source").alias("source"), F.col("ref.reference").alias("reference")
    )
    path = artifact_source_path(F.col("source"), F.col("reference"))
    located = refs.withColumns(
        {
            "identity": F.when(is_allowed_artifact(F.col("source"), path), F.lower(path)),
            "directory": artifact_directory(F.col("source")),
        }
    )
    present = files.groupBy("host", F.lower("file_path").alias("identity")).agg(F.bool_and("copy_ok").alias("copy_ok"))
    joined = located.join(present, ["host", "identity"], "left")
    outcome = (
        F.when(F.col("copy_ok").isNull(), F.lit("skipped"))
        .when(F.col("copy_ok"), F.lit("rewritten"))
        .otherwise(F.lit("failed"))
    )
    return joined.select(*keys, "ingest_seq", "source", "reference", "directory", "identity", outcome.alias("outcome"))


def copy_summary(outcomes: DataFrame, keys: tuple[str, ...] = ("host", "collection_id")) -> DataFrame:
    """Counts per collection; a file referenced many times is copied once."""
    per_file = outcomes.groupBy(*keys, "outcome", "identity").agg(F.count("*").alias("n"))

    def total(name: str):
        return F.coalesce(F.sum(F.when(F.col("outcome") == name, F.col("n"))), F.lit(0)).cast("bigint")

    skipped, failed = total("skipped"), total("failed")
    return per_file.groupBy(*keys).agg(
        total("rewritten").alias("rewritten_count"),
        F.count_if(F.col("outcome") == "rewritten").alias("copied_file_count"),
        skipped.alias("skipped_count"),
        failed.alias("failed_count"),
        ((skipped > 0) | (failed > 0)).alias("was_incomplete"),
    )
