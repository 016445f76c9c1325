"""Queries of stores: listings, appended rows, guards, counts of errors and report lines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein.functions.shared import shared_folder, table
from skein.operators import store
from skein.plans.text_queries import EXPLANATION_GROUNDING, explanation_grounding
from skein.plans.workflow_queries import STAGE_LATENCY, stage_latency
from skein.sources.tables import SEG_SQL, hypothesis_segments, timed_segments


def encounters_newest_first(spark, sf_dir):
    return store.newest_first(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus")


ENCOUNTERS_NEWEST_FIRST = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey"


def child_listing(spark, sf_dir):
    """Events of every user, oldest first."""
    return store.children(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


CHILD_LISTING = "SELECT user_id, event_id, event_type FROM events ORDER BY user_id, ts, event_id"


def stage_runs(spark, sf_dir):
    """The whole telemetry log, newest first; the filter by encounter is a parameter of the operator."""
    return store.stage_runs(table(spark, sf_dir, "events"), "ts", "event_id", "user_id").select("event_id", "user_id", "event_type", "value")


STAGE_RUNS = "SELECT event_id, user_id, event_type, value FROM events ORDER BY ts DESC, event_id"


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("encounter_id"), (F.col("o_orderstatus") == "F").alias("consent_confirmed"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))


def new_encounters(spark, sf_dir):
    rows, audit = store.new_encounters(_asked(spark, sf_dir))
    return rows.select("encounter_id", "status", "consent_confirmed", "created_at", "updated_at").join(audit.select("encounter_id", "event_type", "detail"), "encounter_id")


NEW_ENCOUNTERS = """SELECT o_orderkey AS encounter_id, 'DRAFT' AS status, o_orderstatus = 'F' AS consent_confirmed, strftime(o_orderdate, '%Y-%m-%d') AS created_at, strftime(o_orderdate, '%Y-%m-%d') AS updated_at,
  'ENCOUNTER_CREATED' AS event_type, '{}' AS detail FROM orders"""


def first_versions(spark, sf_dir):
    """Encounters after their inputs, with the length of the transcript of a first version and the number of rejected inputs."""
    enc = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("encounter_id"), F.when(F.col("c_mktsegment") == "BUILDING", "APPROVED").otherwise("DRAFT").alias("status"), F.lit(None).cast("string").alias("draft_version_id"), F.lit(None).cast("string").alias("updated_at")
    )
    o = table(spark, sf_dir, "orders")
    inputs = o.select(F.col("o_custkey").alias("encounter_id"), F.concat(F.lit("v"), "o_orderkey").alias("version_id"), F.col("o_orderpriority").alias("transcript_text"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))
    versions, after, audit, rejected = store.first_versions(enc, inputs)
    made = versions.join(audit.select("encounter_id", "detail"), "encounter_id").select("encounter_id", "version_number", "transcript_text", "structure_json", F.col("version_id"), "detail")
    no = rejected.groupBy("encounter_id").agg(F.count("*").alias("n_rejected"))
    return after.join(made, "encounter_id", "left").join(no, "encounter_id", "left").select("encounter_id", "status", "draft_version_id", "updated_at", "version_number", "transcript_text", "structure_json", "detail", F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"))


FIRST_VERSIONS = """WITH i AS (SELECT o_custkey AS e, 'v' || o_orderkey AS v, o_orderpriority AS t, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders
), e AS (SELECT c_custkey AS encounter_id, c_mktsegment <> 'BUILDING' AS ready FROM customer), f AS (SELECT i.*, row_number() OVER (PARTITION BY e ORDER BY d, v) AS k, count(*) OVER (PARTITION BY e) AS n FROM i)
SELECT encounter_id, CASE WHEN NOT ready THEN 'APPROVED' WHEN v IS NULL THEN 'DRAFT' ELSE 'SUBMITTED' END AS status, CASE WHEN ready THEN v END AS draft_version_id, CASE WHEN ready THEN d END AS updated_at,
  CASE WHEN ready AND v IS NOT NULL THEN 1 END::INT AS version_number, CASE WHEN ready THEN t END AS transcript_text,
  CASE WHEN ready AND v IS NOT NULL THEN '{"problems":[],"tests":[],"medications":[],"plan":[],"warnings":[],"follow_up":[],"questions_or_conflicts":[]}' END AS structure_json,
  CASE WHEN ready AND v IS NOT NULL THEN '{"version_id":"' || v || '","transcript_len":' || length(t) || '}' END AS detail, CASE WHEN ready THEN coalesce(n - 1, 0) ELSE coalesce(n, 0) END::BIGINT AS n_rejected
FROM e LEFT JOIN f ON f.e = e.encounter_id AND k = 1"""


def appended_events(spark, sf_dir):
    """The log after one append for each of two halves and one without rows."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    store.append(e.where("event_type = 'error'"), path)
    store.append(e.where("event_type <> 'error' OR event_type IS NULL"), path)
    store.append(e.where("false"), path)
    return spark.read.schema(e.schema).parquet(path)


APPENDED_EVENTS = "SELECT event_id, user_id, event_type, value FROM events"


def new_runs(spark, sf_dir):
    segs = timed_segments(spark, sf_dir).select(F.col("conv_id").alias("run_id"), "turn", "role", "start_ms", "end_ms")
    asked = segs.groupBy("run_id").agg(F.max("end_ms").alias("created_at"))
    return store.new_runs(asked, segs, "turn").select("run_id", "status", "roles_json", "segments_json")


NEW_RUNS = f"""WITH {SEG_SQL} SELECT conv_id AS run_id, 'needs_role_confirmation' AS status, '{{}}' AS roles_json,
  '[' || string_agg('{{"turn":' || turn || ',"role":"' || role || '","start_ms":' || start_ms || ',"end_ms":' || end_ms || '}}', ',' ORDER BY turn) || ']' AS segments_json FROM seg GROUP BY conv_id"""


def complete_runs(spark, sf_dir):
    """Runs after the purchases completed them, and the completions of unknown runs."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("run_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("completed_at"))
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.lit("running").alias("status"), F.lit(None).cast("string").alias("updated_at"))
    after, unknown = store.complete_runs(runs, e)
    return after.unionByName(unknown.select("run_id", F.lit("unknown").alias("status"), F.col("completed_at").alias("updated_at")))


COMPLETE_RUNS = """WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events WHERE event_type = 'purchase'), l AS (SELECT user_id, max(t) AS t FROM e GROUP BY user_id)
SELECT c_custkey AS run_id, CASE WHEN t IS NULL THEN 'running' ELSE 'completed' END AS status, t AS updated_at FROM customer LEFT JOIN l ON user_id = c_custkey
UNION ALL SELECT user_id, 'unknown', t FROM e WHERE user_id NOT IN (SELECT c_custkey FROM customer)"""


def owned_assets(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    assets = o.select(F.col("o_orderkey").alias("asset_id"), F.col("o_custkey").alias("encounter_id"), F.when(F.col("o_orderstatus") == "F", "original").otherwise("derived").alias("kind"))
    asked = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("asset_id"), (F.col("o_custkey") + F.when(F.col("l_linenumber") == 2, 1).otherwise(0)).alias("encounter_id"))
    return store.with_grants(asked, assets)


OWNED_ASSETS = "SELECT l_orderkey AS asset_id, o_custkey + CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END AS encounter_id, coalesce(l_linenumber <> 2, true) AND coalesce(o_orderstatus = 'F', false) AS granted FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def misattributed_spans(spark, sf_dir):
    segs = timed_segments(spark, sf_dir)
    spans = hypothesis_segments(segs).select("conv_id", "turn", F.col("speaker_index").alias("speaker"), F.when(F.col("turn") % 7 == 0, F.lit("unknown")).otherwise(F.lit("user")).alias("role"))
    return store.misattributed(spans, segs.select("conv_id", "turn", F.col("speaker_index").alias("speaker"), "role"), "conv_id", "turn")


MISATTRIBUTED_SPANS = f"""WITH {SEG_SQL} SELECT conv_id, count(*) AS n_spans, count(*) FILTER (h.speaker_index <> s.speaker_index OR s.role IS DISTINCT FROM CASE WHEN turn % 7 = 0 THEN 'unknown' ELSE 'user' END) AS n_wrong
FROM hyp h JOIN seg s USING (conv_id, turn) GROUP BY conv_id"""


def enrichment_errors(spark, sf_dir):
    """Per user: symptoms that were promoted from questions, and violations that tell of missing sources."""
    e = table(spark, sf_dir, "events")
    symptoms = e.select("user_id", F.when(F.col("event_type") == "view", "doctor_question").otherwise("patient").alias("reported_by"), F.when(F.col("event_id") % 3 == 0, "question").otherwise("affirmed").alias("polarity"))
    kind = F.when(F.col("event_type") == "error", "score_candidates: dropped").when(F.col("event_type") == "click", "diagnosis has no doctor-sourced span").otherwise(F.col("event_type"))
    violations = e.select("user_id", kind.alias("violation"))
    return store.promoted_questions(symptoms, "user_id").join(store.keyword_violations(violations, "user_id", "violation"), "user_id")


ENRICHMENT_ERRORS = """SELECT user_id, count(*) AS n_symptoms, count(*) FILTER (event_type = 'view' AND event_id % 3 <> 0) AS n_promoted, count(event_type) AS n_violations, count(*) FILTER (event_type IN ('error', 'click')) AS n_ungrounded
FROM events GROUP BY user_id"""


def grounded_count(spark, sf_dir):
    return store.grounded(explanation_grounding(spark, sf_dir))


GROUNDED_COUNT = f"SELECT count(*) AS n_total, count(*) FILTER (valid) AS n_grounded, count(*) FILTER (NOT coalesce(valid, false)) AS n_failures FROM ({EXPLANATION_GROUNDING})"


def latency_report(spark, sf_dir):
    return store.report_lines(stage_latency(spark, sf_dir), [("stage", 20), ("cold_ms", 12), ("median_ms", 16), ("min_ms", 14), ("max_ms", 14)]).select("line")


_CELL = "CASE WHEN {0} IS NULL THEN lpad('-', {1}, ' ') ELSE printf('%{1}.1f', round({0}::DECIMAL(18, 6), 1)::DOUBLE) END"
LATENCY_REPORT = "SELECT rpad(stage, 20, ' ') || " + " || ".join(_CELL.format(*c) for c in (("cold_ms", 12), ("median_ms", 16), ("min_ms", 14), ("max_ms", 14))) + f" AS line FROM ({STAGE_LATENCY})"

_NAMES = (
    "encounters_newest_first", "child_listing", "stage_runs", "new_encounters", "first_versions", "appended_events", "new_runs", "complete_runs", "owned_assets", "misattributed_spans", "enrichment_errors", "grounded_count",
    "latency_report",
)
QUERIES = {name: (globals()[name], globals()[name.upper()]) for name in _NAMES}
