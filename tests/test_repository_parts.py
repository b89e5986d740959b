"""Large timelines in pieces, the snapshot folder rule, and published cases read back."""

import json
import os

import pytest
from pyspark.sql import functions as F

from evidentia.plans.base import activity
from evidentia.sinks import repository
from evidentia.sources import bundle

from .conftest import SMALL


def event(i, **more):
    return {"timestamp": f"2024-01-01T00:00:{i % 60:02d}.0000000Z", "category": "File", "action": "Write", "summary": f"s{i}", "fields": {"n": str(i)}, **more}


AWKWARD = [
    event(0),
    event(1, summary='a "quoted" } brace { and \\ backslash \\" both', fields={"x": "}{", "y": '"}"', "z": "\\"}),
    event(2, evidence=[{"source": "A", "reference": "r1"}, {"source": "B", "reference": "}},{{"}]),
    {"category": "no time", "action": "Write", "nested": {"deep": {"deeper": {}}}},
    event(4, summary="é 日本 \\u007d }"),
    event(5, fields={}),
]


def write(path, document, **style):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as file:
        json.dump(document, file, **style)


def plain(events):
    return sorted(((r.host, r.collection_id, r.ingest_seq, str(r.ts), r.summary, dict(r.fields), len(r.evidence)) for r in events.collect()), key=repr)


@pytest.mark.parametrize("style", [{"separators": (",", ":")}, {"indent": 2}, {"ensure_ascii": False}])
@pytest.mark.parametrize("split", ["64", "300", "128m"])
def test_pieces_are_the_document(spark, tmp_path, style, split):
    write(f"{tmp_path}/h1/c1/timeline.json", {"events": AWKWARD + [event(i) for i in range(6, 40)], "meta": {"a": "}"}}, **style)
    write(f"{tmp_path}/h2/c1/timeline.json", {"events": []}, **style)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = plain(bundle.read_case_repository(spark, str(tmp_path), large=True))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == plain(bundle.read_case_repository(spark, str(tmp_path))) and len(found) == 39


def test_snapshot_folders(spark, tmp_path):
    for name, mark in (("h/c1/timeline.json", 1), ("h/c1/snapshot_a/timeline.json", 2), ("h/c2/snapshot_B/timeline.json", 3), ("h/c2/snapshot_a/timeline.json", 4), ("h/c2/other/x.json", 5)):
        write(f"{tmp_path}/{name}", {"events": [event(mark)]})
    assert sorted((r.host, r.collection_id, r.summary) for r in bundle.read_case_repository(spark, str(tmp_path)).collect()) == [("h", "c1", "s1"), ("h", "c2", "s4")]


def test_published_case_reads_back(spark, tmp_path):
    root = str(tmp_path / "case")
    events = activity(spark, SMALL)
    verified = events.select("host", "collection_id").distinct().withColumn("status", F.lit("Verified"))
    repository.publish(events, verified, root)
    back = repository.read_published(spark, root)
    assert back.schema.names == events.schema.names
    same = repository.digests(back).exceptAll(repository.digests(events)).count() + repository.digests(events).exceptAll(repository.digests(back)).count()
    assert same == 0
    assert all("_commits" in f for f in repository.published(spark, root).inputFiles())
    # A publish that broke off leaves an open record: not read, and published again.
    open_ = verified.where("host = 'H1'").select("host", "collection_id", F.lit("Publish").alias("decision"), F.lit(1).cast("long").alias("rows"), F.lit(0).alias("digest"))
    repository._record(open_, 7, F.lit(None), root)
    assert {r.host for r in repository.read_published(spark, root).select("host").distinct().collect()} == {"H0", "H2", "H3"}
    plan = {r.host: r.decision for r in repository.publish(events, verified, root).collect()}
    assert plan == {"H0": "AlreadyPresent", "H1": "Publish", "H2": "AlreadyPresent", "H3": "AlreadyPresent"}
    assert repository.read_published(spark, root).count() == events.count()


def test_unreadable_records_are_no_empty_repository(spark, tmp_path):
    os.makedirs(tmp_path / "case" / "_commits")
    (tmp_path / "case" / "_commits" / "part-0.parquet").write_text("no parquet")
    events = activity(spark, SMALL)
    verified = events.select("host", "collection_id").distinct().withColumn("status", F.lit("Verified"))
    with pytest.raises(Exception):
        repository.publish(events, verified, str(tmp_path / "case"))
    assert not [d for d in os.listdir(tmp_path / "case") if d.startswith("host=")]
