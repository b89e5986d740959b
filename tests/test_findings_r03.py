"""Regressions of the round's findings: larger keys, equal times, plans, documents of any size."""

import pytest

from evidentia.functions import paths
from evidentia.operators import windows
from evidentia.plans import catalog
from pyspark.sql import functions as F
from tools.compare import rows_of

from .conftest import SMALL

import duckdb
import os

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="table set not present")


def grown(folder, **tables):
    """A table set with changed tables: name = a select over ``{t}``, the small table."""
    con = duckdb.connect()
    for name, sql in tables.items():
        con.execute(f"COPY ({sql.format(t=f'{SMALL}/{name}.parquet')}) TO '{folder}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def same_as_sql(spark, con, folder, name):
    got = catalog.queries()[name](spark, str(folder))
    cursor = con.execute(catalog.oracle_sql()[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(got.columns, got.collect()) == want


def test_f6_family_of_large_supplier_keys(spark, tmp_path):
    con = grown(tmp_path, lineitem="SELECT * REPLACE (l_suppkey + 70000 AS l_suppkey) FROM '{t}'")
    same_as_sql(spark, con, tmp_path, "flt_conn_family")


def test_f8_events_that_share_a_time(spark, tmp_path):
    again = "SELECT * FROM '{t}' UNION ALL SELECT * REPLACE (event_id + 1000000 AS event_id) FROM '{t}' UNION ALL SELECT * REPLACE (event_id + 2000000 AS event_id, user_id + 7 AS user_id) FROM '{t}'"
    same_as_sql(spark, grown(tmp_path, events=again), tmp_path, "snk_timeline_json")


def test_f4_f5_look_ahead_broadcasts_nothing(spark):
    rows = spark.range(500).select(F.lit("f").alias("file"), F.col("id").alias("pos"), F.col("id").cast("string").alias("run"))
    found = windows.lookahead(rows, ["file"], "pos", F.col("pos").isin(0, 62, 63, 64, 127, 495, 499), "run", 5, "ahead")
    got = {r["pos"]: r["ahead"] for r in found.collect()}
    assert got == {p: [str(q) for q in range(p + 1, min(p + 6, 500))] for p in (0, 62, 63, 64, 127, 495, 499)}
    for name in ("fn_wmi_event", "src_wmi_subscriptions"):
        plan = catalog.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan


def test_f1_f2_f3_documents_are_written_and_read_without_holding_one(spark, tmp_path, monkeypatch):
    from evidentia.plans.base import activity
    from evidentia.sinks import bundle as sink
    from evidentia.sources import bundle

    events = activity(spark, SMALL).where("ingest_seq < 60")
    root = str(tmp_path / "documents")
    sink.write_documents(events, root)
    whole = spark.read.text(f"{root}/*/*", wholetext=True)
    written = sorted(r["value"].replace("\n", "") for r in whole.collect())
    assert written == sorted(r["document"].replace("\n", "") for r in sink.bundle_documents(events).collect())
    small = sorted(map(str, bundle.read_timeline(spark, f"{root}/*/*").collect()))
    monkeypatch.setattr(bundle, "LARGE_DOCUMENT", 1)
    plan = bundle.read_timeline(spark, f"{root}/*/*")
    assert sorted(map(str, plan.collect())) == small and len(small) == events.count()
    assert "FileScan json" not in plan._jdf.queryExecution().executedPlan().toString()


def test_f9_to_f17_parses_run_once(spark):
    for name, parse in (("fn_task_event", "from_xml"), ("src_event_json", "from_json")):
        plan = catalog.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(parse) == 1, name
