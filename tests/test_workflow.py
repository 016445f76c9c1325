"""Hand-computed cases of workflow, sources and streaming."""

import json

from skein.operators import workflow
from skein.sources import tables
from skein.streaming import telemetry


def test_transitions(spark):
    rows = [("DRAFT", "SUBMITTED"), ("SUBMITTED", "APPROVED"), ("APPROVED", "REVIEW_REQUIRED"), ("REVOKED", "PUBLISHED"), ("PROCESSING_FAILED", "PROCESSING")]
    bad = workflow.illegal_transitions(spark.createDataFrame(rows, "from_status string, to_status string")).collect()
    assert sorted(tuple(r) for r in bad) == [("REVOKED", "PUBLISHED"), ("SUBMITTED", "APPROVED")]


def versions(spark):
    return spark.createDataFrame([(1, 1, "approved", "a"), (2, 1, "approved", "x"), (2, 2, "draft", "b"), (3, 1, "draft", "c")], "document_id long, version_number long, status string, payload string")


def test_edit_after_approval_clones(spark):
    edits = spark.createDataFrame([(1, 1, "A"), (2, 2, "B"), (3, 9, "C")], "document_id long, expected_version long, payload string")
    out, rejected = workflow.edit(versions(spark), edits)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, "approved", "a"), (1, 2, "draft", "A"), (2, 1, "approved", "x"), (2, 2, "draft", "B"), (3, 1, "draft", "c")]
    assert [r.document_id for r in rejected.collect()] == [3]


def test_approve_needs_the_latest_draft(spark):
    asked = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "document_id long, expected_version long")
    out, rejected = workflow.approve(versions(spark), asked)
    assert {(r.document_id, r.version_number) for r in out.where("status = 'approved'").collect()} == {(1, 1), (2, 1), (2, 2)}
    assert sorted(r.document_id for r in rejected.collect()) == [1, 3]


def test_public_view(spark):
    enc = spark.createDataFrame([("PUBLISHED", "t1", 1), ("REVOKED", "t2", 1), ("APPROVED", "t3", 1), ("PUBLISHED", None, 1), ("PUBLISHED", "t4", 9)], "status string, public_token string, approved_version_id long")
    v = spark.createDataFrame([(1, "text")], "version_id long, payload string")
    assert [tuple(r) for r in workflow.public_view(enc, v).collect()] == [("t1", "text")]


def test_segments_from_sidecars(spark, tmp_path):
    seg = {"id": "seg_001", "speaker": "A", "expected_role": "doctor", "start": 0.0, "end": 1.5, "text": "x"}
    (tmp_path / "a.json").write_text(json.dumps({"segments": [seg], "note": "n"}))
    (tmp_path / "b.json").write_text(json.dumps([seg, seg]))
    rows = tables.read_segments(spark, str(tmp_path)).collect()
    assert len(rows) == 3 and {r.role for r in rows} == {"unknown"} and rows[0].end == 1.5


def test_text_segments(spark):
    df = spark.createDataFrame([(1, " a \r\n\n  \n b")], "k long, text string")
    assert [(r.segment_id, r.text) for r in tables.text_segments(df, "k").collect()] == [("seg-1", "a"), ("seg-2", "b")]


def test_streaming_transitions_and_latency(spark, tmp_path):
    rows = [("e1", 1, "DRAFT"), ("e1", 2, "APPROVED"), ("e2", 1, "DRAFT"), ("e2", 2, "SUBMITTED")]
    spark.createDataFrame(rows, "encounter_id string, ord long, status string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("encounter_id string, ord long, status string").parquet(str(tmp_path / "in"))
    q = telemetry.illegal_transitions(stream).writeStream.format("memory").queryName("bad_steps").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("bad_steps").collect()] == [("e1", 2, "DRAFT", "APPROVED")]
    stages = spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS created_at, 'asr' AS stage, 5.0D AS duration_ms UNION ALL SELECT timestamp'2024-01-01 00:02:00', 'asr', 7.0D")
    r = telemetry.windowed_latency(stages).first()
    assert (r.n, r.total_ms, r.min_ms, r.max_ms) == (2, 12.0, 5.0, 7.0)


def test_all_audit_events_are_ranked(spark):
    from pyspark.sql import functions as F

    from skein.operators import workflow
    from skein.plans.registry import QUERIES
    from skein.functions.shared import table

    sf = "/root/testdata/sf0.001"
    assert QUERIES["audit_events"](spark, sf).count() == table(spark, sf, "events").count()
    e = spark.createDataFrame([(30, 1, 5), (30, 2, 7), (None, 3, 1), (4, 4, 9)], "user long, id long, ts long")
    order = [F.col("ts").desc(), F.col("id").desc()]
    assert {(r.user, r.id): r.rank for r in workflow.audit_events(e, "user", order).collect()} == {(30, 1): 2, (30, 2): 1, (None, 3): 1, (4, 4): 1}
    assert [(r.id, r.rank) for r in workflow.audit_events(e, "user", order, only=30).orderBy("rank").collect()] == [(2, 1), (1, 2)]
