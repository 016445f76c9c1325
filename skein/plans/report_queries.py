"""Queries of reports and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.shared import table
from skein.operators import telemetry, workflow
from skein.sources.tables import SEG_SQL, hypothesis_segments, timed_segments


def asr_diagnostics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.floor("value").cast("long").alias("input_seconds"), F.when(F.col("event_id") % 3 == 0, "ko_only").otherwise("auto").alias("mode"))
    return telemetry.diagnostics(e, "user_id")


ASR_DIAGNOSTICS = """SELECT user_id, sum(s)::BIGINT AS input_seconds, count(*)::BIGINT AS n_calls, count(*) FILTER (ko)::BIGINT AS n_ko_only, coalesce(sum(s) FILTER (ko), 0)::BIGINT AS ko_only_seconds
FROM (SELECT user_id, floor(value)::BIGINT AS s, event_id % 3 = 0 AS ko FROM events) GROUP BY user_id"""


def compare_runs(spark, sf_dir):
    """Turns whose speaker differs between two timelines."""
    truth = timed_segments(spark, sf_dir)
    return workflow.difference(truth.select("conv_id", "turn", "speaker_index"), hypothesis_segments(truth).select("conv_id", "turn", "speaker_index"))


COMPARE_RUNS = f"""WITH {SEG_SQL}, a AS (SELECT conv_id, turn, speaker_index FROM seg), b AS (SELECT conv_id, turn, speaker_index FROM hyp)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"""


def manifest_cases(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("doctor"))
    enrolled = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("doctor"))
    return workflow.manifest_cases(c, enrolled).select("c_custkey", "state")


MANIFEST_CASES = "SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0) THEN 'RUN' ELSE 'SKIPPED' END AS state FROM customer"


def shifted_turns(spark, sf_dir):
    segs = timed_segments(spark, sf_dir).select("conv_id", "turn", "start_ms", "end_ms")
    return workflow.shift_turns(segs, 5_000, F.lit(60_000))


SHIFTED_TURNS = f"WITH {SEG_SQL} SELECT conv_id, turn, start_ms + 5000 AS start_ms, least(end_ms + 5000, 60000) AS end_ms FROM seg WHERE start_ms + 5000 < 60000"


def recording_extent(spark, sf_dir):
    return timed_segments(spark, sf_dir).groupBy("conv_id").agg((F.max("end_ms") - F.min("start_ms")).alias("extent_ms"))


RECORDING_EXTENT = f"WITH {SEG_SQL} SELECT conv_id, max(end_ms) - min(start_ms) AS extent_ms FROM seg GROUP BY conv_id"


def finding_texts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", workflow.finding_text(F.when(F.col("turn") % 2 == 0, F.col("text")).when(F.col("turn") % 3 == 0, ""), F.lit("trigger")).alias("finding_text"))


FINDING_TEXTS = "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND text <> '' THEN text ELSE 'trigger' END AS finding_text FROM conversations"


def audit_log(spark, sf_dir):
    """The newest event of each user; audit_events has all of them."""
    e = table(spark, sf_dir, "events")
    return workflow.latest(e, "user_id", [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


AUDIT_LOG = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"


def audit_events(spark, sf_dir):
    """All audit events with their rank within the user, newest first."""
    e = table(spark, sf_dir, "events")
    return workflow.audit_events(e, "user_id", [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type", "rank")


AUDIT_EVENTS = "SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events"

QUERIES = {name: (globals()[name], globals()[name.upper()]) for name in ("asr_diagnostics", "compare_runs", "manifest_cases", "shifted_turns", "recording_extent", "finding_texts", "audit_log", "audit_events")}
