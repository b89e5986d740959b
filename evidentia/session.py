"""Session settings and the two places where a job may cut lineage or stage data."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# The JVM compiles no method beyond 8,000 bytes of code. Rows of wide expressions would run interpreted in
# one fused method; with this limit Spark evaluates them in small methods instead.
COMPILED_METHODS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def build_session(app: str = "evidentia", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; cluster settings are left to the submitter."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **COMPILED_METHODS,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting that holds for one write."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that is unset and all tasks run in one JVM (unit tests) does a
    temporary folder stand in.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one written table."""
    return f"{shared_dir(spark).rstrip('/')}/evidentia/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and stops the plan from growing."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
