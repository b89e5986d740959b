"""Bundle integrity: declared hashes against the files that are there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first_by

BUNDLE = ["host", "collection_id"]

# Files that every bundle must hold, and the manifest of hashes.
REQUIRED_FILES = ["timeline.json", "manifest.json"]
HASH_FILE = "hashes.txt"

ISSUE_TEXT = {
    "escape": "Hash entry escapes snapshot directory: ",
    "missing": "Hashed file is missing: ",
    "mismatch": "Hash mismatch: ",
    "undeclared": "Undeclared file not covered by hashes.txt: ",
}


def normalized_path(path: Column) -> Column:
    """Forward slashes, ``.`` and empty segments dropped, case folded."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: ~p.isin("", "."))
    return F.lower(F.array_join(parts, "/"))


def escapes(path: Column) -> Column:
    """A path that leaves its bundle: rooted, or climbing above the start at any segment."""
    slashed = F.translate(path, "\\", "/")
    depth = F.aggregate(
        F.split(slashed, "/"),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda acc, part: F.struct(
            (acc["d"] + _step(part)).alias("d"), F.least(acc["low"], acc["d"] + _step(part)).alias("low")
        ),
        lambda acc: acc["low"],
    )
    return slashed.startswith("/") | slashed.rlike("^[A-Za-z]:") | (depth < 0)


def _step(part: Column) -> Column:
    return F.when(part == "..", F.lit(-1)).when(part.isin("", "."), F.lit(0)).otherwise(F.lit(1))


def parse_hash_lines(lines: DataFrame) -> DataFrame:
    """``hash  relative path`` lines of ``value``; comments and malformed lines are skipped."""
    pattern = r"^(.*?)  (.*)$"
    text = F.trim("value")
    parsed = lines.where((text != "") & ~text.startswith("#") & text.rlike(pattern))
    return parsed.select(
        *[c for c in lines.columns if c != "value"],
        F.lower(F.trim(F.regexp_extract(text, pattern, 1))).alias("sha256"),
        F.trim(F.regexp_extract(text, pattern, 2)).alias("relative_path"),
    )


def compare_hashes(declared: DataFrame, actual: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per declared entry or undeclared file: ``status`` is ok or the issue kind.

    Both sides carry ``relative_path, sha256`` and the bundle keys. Actual files
    have unique paths; a path declared twice yields one row per entry.
    """
    keys = BUNDLE if keys is None else keys
    left = declared.select(
        *keys,
        normalized_path(F.col("relative_path")).alias("path"),
        F.col("relative_path").alias("declared_path"),
        F.lower("sha256").alias("declared_hash"),
        escapes(F.col("relative_path")).alias("escaping"),
    )
    right = actual.where(F.lower("relative_path") != HASH_FILE).select(
        *keys,
        normalized_path(F.col("relative_path")).alias("path"),
        F.col("relative_path").alias("actual_path"),
        F.lower("sha256").alias("actual_hash"),
    )
    inside = left.where(~F.col("escaping"))
    joined = inside.join(right, [*keys, "path"], "full_outer")
    status = (
        F.when(F.col("declared_path").isNull(), F.lit("undeclared"))
        .when(F.col("actual_path").isNull(), F.lit("missing"))
        .when(F.col("declared_hash") != F.col("actual_hash"), F.lit("mismatch"))
        .otherwise(F.lit("ok"))
    )
    rows = joined.select(
        *keys, F.coalesce("declared_path", "actual_path").alias("relative_path"), status.alias("status")
    )
    outside = left.where(F.col("escaping")).select(
        *keys, F.col("declared_path").alias("relative_path"), F.lit("escape").alias("status")
    )
    return rows.unionByName(outside)


def issue_text(status: Column, path: Column) -> Column:
    text = F.lit(None).cast("string")
    for kind, prefix in ISSUE_TEXT.items():
        text = F.when(status == kind, F.concat(F.lit(prefix), path)).otherwise(text)
    return text


def integrity_status(checks: DataFrame, files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Failed, Unverified or Verified per bundle.

    ``checks`` comes from :func:`compare_hashes`; ``files`` lists every file of
    every bundle (``relative_path``). Required files come first, then the hash
    file, then the issues.
    """
    keys = BUNDLE if keys is None else keys
    name = F.lower("relative_path")
    present = files.groupBy(*keys).agg(
        *[F.bool_or(name == f).alias(f"has_{i}") for i, f in enumerate(REQUIRED_FILES)],
        F.bool_or(name == HASH_FILE).alias("has_hashes"),
    )
    counted = checks.groupBy(*keys).agg(
        F.count_if(F.col("status") != "undeclared").alias("declared_count"),
        F.count_if(F.col("status") != "ok").alias("issue_count"),
    )
    joined = present.join(counted, keys, "left")
    complete = F.lit(True)
    for i in range(len(REQUIRED_FILES)):
        complete = complete & F.col(f"has_{i}")
    declared = F.coalesce(F.col("declared_count"), F.lit(0))
    issues = F.coalesce(F.col("issue_count"), F.lit(0))
    status = (
        F.when(~complete, F.lit("Failed"))
        .when(~F.col("has_hashes") | (declared == 0), F.lit("Unverified"))
        .when(issues > 0, F.lit("Failed"))
        .otherwise(F.lit("Verified"))
    )
    return joined.select(*keys, status.alias("status"), declared.alias("declared_count"), issues.alias("issue_count"))


def status_of_checks(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Status from the comparison alone, where the required files are known to be there."""
    return checks.groupBy(*keys).agg(
        F.when(F.count_if(F.col("status") != "undeclared") == 0, F.lit("Unverified"))
        .when(F.count_if(F.col("status") != "ok") > 0, F.lit("Failed"))
        .otherwise(F.lit("Verified"))
        .alias("status"),
        F.count("*").alias("file_count"),
        F.count_if(F.col("status") != "ok").alias("issue_count"),
    )


def first_issue(checks: DataFrame, keys: list[str]) -> DataFrame:
    """First issue text per bundle, for a one-line report."""
    bad = checks.where(F.col("status") != "ok")
    text = issue_text(F.col("status"), F.col("relative_path"))
    return bad.groupBy(*keys).agg(first_by(text, F.col("relative_path")).alias("issue"))
