"""Registration and the few Spark helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import staging_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL twin, if SQL can express it."""

    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of one Arrow batch between Spark and a Python worker; whole texts would otherwise fill batches of 64 MB.
BATCH_BYTES = 8 << 20


#: Models and caches that a Python worker keeps between tasks, by the module that made them.
HELD: dict[str, dict] = {}


def held(module: str) -> dict:
    """The place of a module's models and caches in this worker."""
    return HELD.setdefault(module, {})


#: The module whose task this worker ran last, and those that all others use, whose tables stay until it changes.
_LAST = {"module": ""}
SHARED = ("evidentia.llm.columns",)


def leave(module: str) -> None:
    """Drop what other modules hold: workers are used again, and a later stage of a pipeline needs the memory."""
    changed, _LAST["module"] = _LAST["module"] != module, module
    others = [kept for name, kept in HELD.items() if kept and name != module and (changed or name not in SHARED)]
    for kept in others:
        kept.clear()
    if others or changed:
        gc.unfreeze()
        gc.collect()
        give_back()


def give_back() -> None:
    """Return free memory to the system: arrays of the task before leave holes that no other object of Python's fills."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def arrow_map(rows: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches of bounded size; they are a setting of the session, which stays."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    module = function.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave(module)
        return function(batches)

    return rows.mapInArrow(run, schema)


def staged(rows: DataFrame, name: str) -> DataFrame:
    """Rows written once to the shared folder and read back: computed once, survives lost executors."""
    path = staging_path(rows.sparkSession, name)
    rows.write.parquet(path)
    back = rows.sparkSession.read.schema(rows.schema).parquet(path)
    back.staged_path = path
    return back


def unstaged(*tables: DataFrame) -> None:
    """Delete what ``staged`` wrote, once no later step reads it."""
    for rows in tables:
        context = rows.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(vars(rows)["staged_path"])
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of phases whose results are written.

    Their plans are garbage by then, but Spark's cleaner only learns of it when the
    driver collects, which a job of many phases cannot wait for. A plan may still be
    on its way to a listener the first time.
    """
    for wait in (0.2, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
