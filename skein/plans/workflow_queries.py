"""Queries of workflow, data quality and telemetry, over the order and event tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions.shared import table
from skein.operators import telemetry, workflow

#: What statuses the event types stand in for.
_STATUS = {"click": "DRAFT", "view": "SUBMITTED", "purchase": "PROCESSING", "signup": "REVIEW_REQUIRED", "error": "APPROVED"}


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _ms(ts="ts"):
    return F.expr(f"cast(unix_micros(cast({ts} as timestamp)) div 1000 as bigint)")


def stage_latency(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("event_type").alias("stage"), F.col("value").alias("duration_ms"), F.col("event_id").alias("ord"), (F.to_date("ts") == F.lit("2024-01-01").cast("date")).alias("cold"))
    out = telemetry.stage_latency(e.where("NOT cold"), e.where("cold AND stage <> 'view'"))
    return out.select("stage", *[F.round(c, 6).alias(c) for c in ("median_ms", "min_ms", "max_ms", "cold_ms")], F.coalesce("n_warm", F.lit(0)).alias("n_warm"))


STAGE_LATENCY = """WITH e AS (SELECT event_type AS stage, value AS v, event_id, ts::DATE = DATE '2024-01-01' AS cold FROM events
), w AS (SELECT stage, median(v) AS m, min(v) AS a, max(v) AS b, count(*)::BIGINT AS n FROM e WHERE NOT cold GROUP BY stage), c AS (SELECT stage, arg_max(v, event_id) AS cold_ms FROM e WHERE cold AND stage <> 'view' GROUP BY stage)
SELECT coalesce(w.stage, c.stage) AS stage, round(m, 6) AS median_ms, round(a, 6) AS min_ms, round(b, 6) AS max_ms, round(cold_ms, 6) AS cold_ms, coalesce(n, 0) AS n_warm FROM w FULL JOIN c ON w.stage = c.stage"""


def rtf_by_stage(spark, sf_dir):
    e = _events(spark, sf_dir)
    out = e.groupBy("event_type").agg(F.sum(F.round(F.col("value") * 1000).cast("long")).alias("us"), F.sum(F.when(F.col("event_type") != "click", F.col("user_id") % 60)).alias("audio_seconds"))
    rtf = telemetry.real_time_factor(F.col("us") / 1000, F.col("audio_seconds"))
    return out.select("event_type", F.when(F.isnan(rtf), None).otherwise(F.round(rtf, 9)).alias("rtf"))


RTF_BY_STAGE = """SELECT event_type, round(us / 1000 / 1000 / a, 9) AS rtf FROM (
  SELECT event_type, sum(round(value * 1000)::BIGINT)::DOUBLE AS us, sum(CASE WHEN event_type <> 'click' THEN user_id % 60 END)::DOUBLE AS a FROM events GROUP BY event_type)"""


def parallel_speedup(spark, sf_dir):
    e = _events(spark, sf_dir).select((F.expr("event_id div 3")).alias("run"), _ms().alias("start_ms"), (_ms() + 1 + F.col("user_id") * 10_000).alias("end_ms"))
    out = telemetry.parallel_speedup(e, "run")
    return out.select("run", "wall_ms", "sequential_ms", "overlap_ms", F.round("speedup", 9).alias("speedup"), "worth_it")


PARALLEL_SPEEDUP = """WITH t AS (SELECT event_id // 3 AS run, epoch_us(ts) // 1000 AS a, epoch_us(ts) // 1000 + 1 + user_id * 10000 AS b FROM events
), g AS (SELECT run, max(b) - min(a) AS wall_ms, sum(b - a)::BIGINT AS sequential_ms, greatest(0, min(b) - max(a)) AS overlap_ms FROM t GROUP BY run)
SELECT *, round(sequential_ms::DOUBLE / wall_ms, 9) AS speedup, sequential_ms::DOUBLE / wall_ms >= 1.3 AS worth_it FROM g"""


def utilization_delta(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("busy"), "ts")
    return telemetry.counter_deltas(e, "user_id", ["ts", "event_id"], "busy").select("user_id", "event_id", "delta")


UTILIZATION_DELTA = "SELECT user_id, event_id, busy - lag(busy) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM (SELECT *, round(value * 100)::BIGINT AS busy FROM events)"


def utilization_summary(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_type", F.floor("value").cast("long").alias("v"))
    out = telemetry.utilization(e, "event_type", "v")
    return out.select("event_type", "avg_value", F.col("max_value").cast("double").alias("max_value"), "n_samples")


UTILIZATION_SUMMARY = "SELECT event_type, round(avg(v), 1) AS avg_value, max(v)::DOUBLE AS max_value, count(v)::BIGINT AS n_samples FROM (SELECT event_type, floor(value)::BIGINT AS v FROM events) GROUP BY event_type"


def latest_active(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    return workflow.latest(o, "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


LATEST_ACTIVE = "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'F') WHERE k = 1"


def _encounters(spark, sf_dir):
    """Customers as encounters, orders as versions and runs."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    firsts = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("draft_version_id"), F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("approved_version_id"))
    status = F.element_at(F.array(*map(F.lit, ("PUBLISHED", "REVOKED", "APPROVED"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    enc = c.join(firsts, c["c_custkey"] == firsts["o_custkey"], "left").select(F.col("c_custkey").alias("encounter_id"), status.alias("status"), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("t"), "c_custkey")).alias("public_token"), "draft_version_id", "approved_version_id")
    versions = o.select(F.col("o_orderkey").alias("version_id"), F.col("o_orderpriority").alias("payload"))
    runs = o.select(F.col("o_custkey").alias("encounter_id"), F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("RUNNING").alias("status"), F.col("o_orderdate").alias("created_at"))
    return enc, versions, runs


_ENC = """f AS (SELECT o_custkey, max(o_orderkey) AS d, min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS a FROM orders GROUP BY o_custkey
), e AS (SELECT c_custkey AS encounter_id, ['PUBLISHED', 'REVOKED', 'APPROVED'][c_custkey % 3 + 1] AS status, CASE WHEN c_custkey % 5 <> 0 THEN 't' || c_custkey END AS public_token, d AS draft_version_id, a AS approved_version_id FROM customer LEFT JOIN f ON c_custkey = o_custkey)"""


def detail_view(spark, sf_dir):
    return workflow.detail_view(*_encounters(spark, sf_dir)).select("encounter_id", "status", "draft_payload", "approved_payload", "active_run_id")


DETAIL_VIEW = f"""WITH {_ENC}, r AS (SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'F') WHERE k = 1)
SELECT encounter_id, status, d.o_orderpriority AS draft_payload, a.o_orderpriority AS approved_payload, r.o_orderkey AS active_run_id FROM e LEFT JOIN orders d ON d.o_orderkey = draft_version_id LEFT JOIN orders a ON a.o_orderkey = approved_version_id LEFT JOIN r ON r.o_custkey = encounter_id"""


def public_view(spark, sf_dir):
    enc, versions, _ = _encounters(spark, sf_dir)
    return workflow.public_view(enc, versions)


PUBLIC_VIEW = f"WITH {_ENC} SELECT public_token, o_orderpriority AS payload FROM e JOIN orders ON o_orderkey = approved_version_id WHERE status = 'PUBLISHED' AND public_token IS NOT NULL"


def _statuses(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for p in _STATUS.items() for x in p])
    return _events(spark, sf_dir).select("user_id", "event_id", "ts", F.coalesce(names[F.col("event_type")], F.lit("PUBLISHED")).alias("status"))


_ST = "st AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'click' THEN 'DRAFT' WHEN 'view' THEN 'SUBMITTED' WHEN 'purchase' THEN 'PROCESSING' WHEN 'signup' THEN 'REVIEW_REQUIRED' WHEN 'error' THEN 'APPROVED' ELSE 'PUBLISHED' END AS status FROM events)"


def _guarded(spark, sf_dir):
    return workflow.guard_events(_statuses(spark, sf_dir), "user_id", ["ts", "event_id"], "status")


#: Each user's events in turn: an event is accepted if the state that the accepted ones before have led to allows it.
_GUARD = f"""WITH RECURSIVE {_ST}, e AS (SELECT user_id, event_id, status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM st
), f AS (
  SELECT user_id, k, event_id, NULL::VARCHAR AS from_status, status AS to_status, status = 'DRAFT' AS accepted, CASE WHEN status = 'DRAFT' THEN status END AS state FROM e WHERE k = 1
  UNION ALL SELECT user_id, k, event_id, state, to_status, ok, CASE WHEN ok THEN to_status ELSE state END FROM (
    SELECT e.user_id, e.k, e.event_id, f.state, e.status AS to_status, (coalesce(f.state, ''), e.status) IN (('', 'DRAFT'), ('DRAFT', 'SUBMITTED'), ('SUBMITTED', 'PROCESSING'), ('PROCESSING', 'REVIEW_REQUIRED'), ('PROCESSING', 'PROCESSING_FAILED'),
      ('REVIEW_REQUIRED', 'APPROVED'), ('APPROVED', 'PUBLISHED'), ('APPROVED', 'REVIEW_REQUIRED'), ('PUBLISHED', 'REVOKED'), ('PROCESSING_FAILED', 'PROCESSING')) AS ok
    FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1))"""


def illegal_transitions(spark, sf_dir):
    """Events that are refused, with the state they met."""
    return workflow.refused(_guarded(spark, sf_dir), "status").select("user_id", "event_id", "from_status", "to_status")


ILLEGAL_TRANSITIONS = f"{_GUARD} SELECT user_id, event_id, from_status, to_status FROM f WHERE NOT accepted"


def state_fold(spark, sf_dir):
    """Each user's state after the accepted events."""
    return workflow.fold_status(_guarded(spark, sf_dir), "user_id", ["ts", "event_id"]).select("user_id", "status", "n_events", "n_refused")


STATE_FOLD = f"{_GUARD} SELECT user_id, arg_max(state, k) AS status, count(*)::BIGINT AS n_events, count(*) FILTER (NOT accepted)::BIGINT AS n_refused FROM f GROUP BY user_id"


def _versions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    v = o.select(F.col("o_custkey").alias("document_id"), n.alias("version_number"), F.when(F.col("o_orderkey") % 2 == 0, "draft").otherwise("approved").alias("status"), F.col("o_orderpriority").alias("payload"))
    newest = v.groupBy("document_id").agg(F.max("version_number").alias("m"))
    edits = newest.where("document_id % 2 = 0").select("document_id", F.when(F.col("document_id") % 6 == 0, F.col("m") - 1).otherwise(F.col("m")).alias("expected_version"), F.lit("edited").alias("payload"))
    return v, edits


_VER = """v AS (SELECT o_custkey AS document_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS version_number, CASE WHEN o_orderkey % 2 = 0 THEN 'draft' ELSE 'approved' END AS status, o_orderpriority AS payload FROM orders
), m AS (SELECT *, version_number = max(version_number) OVER (PARTITION BY document_id) AS newest FROM v)"""


def version_clone(spark, sf_dir):
    return workflow.edit(*_versions(spark, sf_dir))[0]


VERSION_CLONE = f"""WITH {_VER}, e AS (SELECT *, newest AND document_id % 2 = 0 AND document_id % 6 <> 0 AS hit FROM m)
SELECT document_id, version_number, status, CASE WHEN hit AND status = 'draft' THEN 'edited' ELSE payload END AS payload FROM e UNION ALL SELECT document_id, version_number + 1, 'draft', 'edited' FROM e WHERE hit AND status = 'approved'"""


def rejected_edits(spark, sf_dir):
    return workflow.edit(*_versions(spark, sf_dir))[1].select("document_id", "expected_version")


REJECTED_EDITS = f"WITH {_VER} SELECT document_id, version_number - 1 AS expected_version FROM m WHERE newest AND document_id % 6 = 0"


def approve_versions(spark, sf_dir):
    v, edits = _versions(spark, sf_dir)
    return workflow.approve(v, edits.select("document_id", "expected_version"))[0]


APPROVE_VERSIONS = f"WITH {_VER} SELECT document_id, version_number, CASE WHEN newest AND status = 'draft' AND document_id % 2 = 0 AND document_id % 6 <> 0 THEN 'approved' ELSE status END AS status, payload FROM m"


def fk_orphans(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_size > 5")
    return workflow.orphans(table(spark, sf_dir, "lineitem"), parts, "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


FK_ORPHANS = "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM part WHERE p_size > 5 AND p_partkey = l_partkey)"


def unique_violations(spark, sf_dir):
    return workflow.repeated_keys(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


UNIQUE_VIOLATIONS = "SELECT l_partkey, l_suppkey, count(*)::BIGINT AS n FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1"


def json_props(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select("event_id", F.from_json("props", "map<string,bigint>").alias("_m")).select("event_id", F.explode("_m").alias("key", "value"))


JSON_PROPS = "SELECT event_id, unnest(json_keys(props)) AS key, (json_extract(props, '$.' || unnest(json_keys(props))))::BIGINT AS value FROM events"


def asset_lineage(spark, sf_dir):
    """Processed assets with their originals: parts refer to the part of half their number."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset_id"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_partkey div 2 END").alias("source_asset_id"), "p_name")
    source = p.select(F.col("asset_id").alias("source_asset_id"), F.col("p_name").alias("source_name"))
    return p.join(source, "source_asset_id").select("asset_id", "source_asset_id", "p_name", "source_name")


ASSET_LINEAGE = "SELECT a.p_partkey AS asset_id, b.p_partkey AS source_asset_id, a.p_name, b.p_name AS source_name FROM part a JOIN part b ON a.p_partkey % 2 = 0 AND b.p_partkey = a.p_partkey // 2"


def content_hash(spark, sf_dir):
    """Groups of documents of equal content by its digest."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return d.groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc_id")).where("n > 1")


CONTENT_HASH = "SELECT sha256(text) AS sha256, count(*)::BIGINT AS n, min(doc_id) AS first_doc_id FROM documents GROUP BY 1 HAVING count(*) > 1"


def audio_checks(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "mov,mp4").otherwise("aiff, x").alias("format"), F.when(F.col("p_partkey") % 4 == 0, "aac").alias("codec"), (F.col("p_size") * 700_000).cast("long").alias("size_bytes"), (F.col("p_partkey") % 2500).alias("duration_seconds"))
    return workflow.audio_problem(p).select("p_partkey", "problem")


AUDIO_CHECKS = """SELECT p_partkey, CASE WHEN p_size * 700000 > 26214400 THEN 'too_large' WHEN NOT (p_partkey % 3 = 0 OR p_partkey % 4 = 0) THEN 'format' WHEN p_partkey % 2500 > 1800 THEN 'too_long' END AS problem FROM part"""


def probe_duration(spark, sf_dir):
    k = F.col("p_partkey")
    d = workflow.probe_duration(F.when(k % 2 == 0, k * 1.5), F.when(k % 3 == 0, k * 0.5).otherwise(0.0), k * 100, F.lit(1), k % 5)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(d, 6).alias("seconds"))


PROBE_DURATION = """SELECT p_partkey, round(coalesce(CASE WHEN p_partkey % 2 = 0 AND p_partkey > 0 THEN p_partkey * 1.5::DOUBLE END, CASE WHEN p_partkey % 3 = 0 AND p_partkey > 0 THEN p_partkey * 0.5::DOUBLE END,
  CASE WHEN p_partkey % 5 <> 0 AND p_partkey > 0 THEN p_partkey * 100.0::DOUBLE / (p_partkey % 5) END), 6) AS seconds FROM part"""

QUERIES = {
    name: (globals()[name], globals()[name.upper()])
    for name in (
        "stage_latency", "rtf_by_stage", "parallel_speedup", "utilization_delta", "utilization_summary", "latest_active", "detail_view", "public_view", "illegal_transitions", "state_fold", "version_clone",
        "rejected_edits", "approve_versions", "fk_orphans", "unique_violations", "json_props", "asset_lineage", "content_hash", "audio_checks", "probe_duration",
    )
}
