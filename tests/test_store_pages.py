"""Pages of the event store by its order index."""

import pytest
from pyspark.sql import functions as F

from evidentia.plans.base import activity
from evidentia.sinks import store as sink
from evidentia.sources import store

from .conftest import SMALL

RANGES = [(None, None, None), ("2024-01-05 00:00:30", "2024-01-12 12:00:10", None), ("2024-01-05 00:00:00", None, "File"), (None, "2024-01-15 07:07:07", "Network")]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "events")
    rows = activity(spark, SMALL)
    sink.write_store(rows.where("ingest_seq % 3 > 0"), path)
    sink.append_store(rows.where("ingest_seq % 3 = 0"), path)
    return path


@pytest.mark.parametrize("start,end,category", RANGES)
def test_pages_follow_one_another(spark, stored, start, end, category):
    rows = store.in_time_order(store.read_store(spark, stored, start, end, category)).select("ts", "ingest_seq").collect()
    assert len(rows) > 20
    for offset, limit in ((0, 7), (len(rows) // 2, 11), (len(rows) - 3, 10), (len(rows), 5), (3, 0)):
        found = store.read_page(spark, stored, offset, limit, start, end, category).select("ts", "ingest_seq").collect()
        assert found == rows[offset : offset + limit], (offset, limit)


def test_a_page_needs_no_search(spark, stored):
    context = spark.sparkContext
    context.setJobGroup("page", "one page")
    try:
        assert store.read_page(spark, stored, 400, 5).select("ingest_seq").collect()
        jobs = context.statusTracker().getJobIdsForGroup("page")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    # Three reads, of which adaptive execution runs every stage as a job.
    assert len(jobs) <= 18, len(jobs)


def test_a_wrong_index_is_not_used(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = activity(spark, SMALL)
    sink.write_store(rows, path)
    sink._laid_out(rows.limit(50).withColumn("ingest_seq", F.col("ingest_seq") + 1_000_000)).write.mode("append").partitionBy("event_date").parquet(path)
    want = store.in_time_order(store.read_store(spark, path)).select("ingest_seq").collect()[300:320]
    assert sorted(map(tuple, store.read_page(spark, path, 300, 20).select("ingest_seq").collect())) == sorted(map(tuple, want))
