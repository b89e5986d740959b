"""Collects the registered queries."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .base import ORACLES, QUERIES

for _module in sorted(Path(__file__).parent.glob("*_queries.py")):
    import_module(f"{__package__}.{_module.stem}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["srt_timeline"](spark, sf_dir)
