"""Queries of documents, their edits and tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.functions import constants as K
from skein.functions.shared import table
from skein.operators import documents, segments, workflow
from skein.sources.tables import SEG_SQL, timed_segments


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("_t")).select("conv_id", F.array_join(F.transform("_t", lambda x: x["text"]), "\n").alias("text"))


_LINES = """t AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id
), l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS n, trim(line) AS line FROM (SELECT conv_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t) WHERE trim(line) <> '')"""


def structure_documents(spark, sf_dir):
    df = _texts(spark, sf_dir).select("conv_id", documents.structure_of(F.col("text")).alias("s"))
    return df.select("conv_id", F.posexplode("s.problems").alias("_i", "p")).select("conv_id", (F.col("_i") + 1).cast("long").alias("n"), "p.text", "p.certainty", F.array_join("p.source_segment_ids", ",").alias("sources"))


STRUCTURE_DOCUMENTS = f"WITH {_LINES} SELECT conv_id, n, line AS text, 'stated' AS certainty, 'seg-' || n AS sources FROM l"


def explanation_documents(spark, sf_dir):
    df = _texts(spark, sf_dir).select("conv_id", documents.explanation_of(documents.structure_of(F.col("text"))).alias("explanation"))
    source = F.array_join(F.element_at("explanation.source_map", 1)["source_segment_ids"], ",")
    shown = documents.rendered_fields(df, "conv_id").select("conv_id", "field", F.size("items").cast("long").alias("n_items"))
    return shown.join(df.select("conv_id", source.alias("sources")), "conv_id")


EXPLANATION_DOCUMENTS = f"WITH {_LINES} SELECT conv_id, 'current_situation' AS field, count(*)::BIGINT AS n_items, string_agg('seg-' || n, ',' ORDER BY n) AS sources FROM l GROUP BY conv_id"


def edited_problems(spark, sf_dir):
    edited = F.concat(F.col("text"), F.lit("\n\n one more \n"))
    old = documents.structure_of(F.col("text"))
    old = old.withField("problems", F.transform(old["problems"], lambda p: p.withField("certainty", F.lit("uncertain"))))
    df = _texts(spark, sf_dir).select("conv_id", documents.edit_problems(old, edited).alias("s"))
    return df.select("conv_id", F.posexplode("s.problems").alias("_i", "p")).select("conv_id", (F.col("_i") + 1).cast("long").alias("n"), "p.text", "p.certainty", F.size("p.source_segment_ids").cast("long").alias("n_sources"))


EDITED_PROBLEMS = f"""WITH {_LINES} SELECT conv_id, n, line AS text, 'uncertain' AS certainty, 1::BIGINT AS n_sources FROM l
UNION ALL SELECT conv_id, max(n) + 1, 'one more', 'stated', 0 FROM l GROUP BY conv_id"""


def draft_fill(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, "filled").alias("o_orderpriority"))
    return documents.fill(o, new, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


DRAFT_FILL = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 6 = 0 THEN 'filled' ELSE o_orderpriority END AS o_orderpriority FROM orders"


def schema_migration(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    return documents.migrate(r, StructType.fromDDL("r_regionkey long, r_name string, r_note string"))


SCHEMA_MIGRATION = "SELECT r_regionkey::BIGINT AS r_regionkey, r_name, NULL::VARCHAR AS r_note FROM region"


def point_lookup(spark, sf_dir):
    """Rows of wanted keys, with those that are not found marked."""
    wanted = table(spark, sf_dir, "part").select((F.col("p_partkey") * 7).alias("c_custkey"))
    found, missing = workflow.lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), wanted, "c_custkey")
    return found.unionByName(missing.select("c_custkey", F.lit(None).cast("string").alias("c_name")))


POINT_LOOKUP = "SELECT p_partkey * 7 AS c_custkey, c_name FROM part LEFT JOIN customer ON c_custkey = p_partkey * 7"


def error_rows(spark, sf_dir):
    codes = F.element_at(F.array(*[F.lit(c) for c, _, _ in K.ERRORS], F.lit("OTHER")), (F.col("p_partkey") % 16 + 1).cast("int"))
    out = documents.with_errors(table(spark, sf_dir, "part").select("p_partkey", codes.alias("error_code")))
    return out.groupBy("error_code", "http_status", "retryable").agg(F.count("*").alias("n"))


ERROR_ROWS = (
    "WITH e(error_code, http_status, retryable, i) AS (VALUES " + ", ".join(f"('{c}', {h}, {str(r).upper()}, {i})" for i, (c, h, r) in enumerate(K.ERRORS)) + ", ('OTHER', NULL, NULL, 15))"
    " SELECT error_code, http_status::INT AS http_status, retryable, count(*)::BIGINT AS n FROM part JOIN e ON p_partkey % 16 = i GROUP BY ALL"
)


def enrollment_windows(spark, sf_dir):
    clips = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 1037).cast("long").alias("duration_ms"))
    return documents.enrollment_windows(clips, "p_partkey")


ENROLLMENT_WINDOWS = """SELECT p_partkey, s AS start_ms, least(s + 10000, d) AS end_ms FROM (SELECT p_partkey, d, unnest(range(0, greatest(0, d - 1) + 1, 10000)) AS s FROM (SELECT p_partkey, p_size::BIGINT * 1037 AS d FROM part)) WHERE least(s + 10000, d) - s >= 2000"""


def cluster_seconds(spark, sf_dir):
    return documents.cluster_seconds(segments.merge_turns(timed_segments(spark, sf_dir))).withColumn("seconds", F.round("seconds", 6))


CLUSTER_SECONDS = f"""WITH {SEG_SQL}, i AS (
  SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY start_ms, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (
    SELECT *, CASE WHEN lag(speaker_index) OVER w = speaker_index AND start_ms - lag(end_ms) OVER w < 800 THEN 0 ELSE 1 END AS new FROM seg WINDOW w AS (PARTITION BY conv_id ORDER BY start_ms, turn))
), m AS (SELECT conv_id, any_value(speaker_index) AS speaker_index, arg_max(end_ms, turn) - min(start_ms) AS ms FROM i GROUP BY conv_id, island)
SELECT conv_id, speaker_index, round(sum(ms)::DOUBLE / 1000, 6) AS seconds, count(*) FILTER (ms >= 1000)::BIGINT AS n_chunks FROM m GROUP BY conv_id, speaker_index"""


def asset_audit(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("encounter_id"), F.when(F.col("s_suppkey") % 2 == 0, "original").otherwise("processed").alias("kind"), F.col("s_suppkey").alias("asset_id"), F.lit(0).alias("created_at"))
    return documents.audit_of_asset(a).select("encounter_id", "event_type", F.col("metadata")["asset_id"].alias("asset_id"))


ASSET_AUDIT = "SELECT s_nationkey AS encounter_id, CASE WHEN s_suppkey % 2 = 0 THEN 'AUDIO_UPLOADED' ELSE 'AUDIO_PREPROCESSED' END AS event_type, s_suppkey::VARCHAR AS asset_id FROM supplier"

QUERIES = {
    name: (globals()[name], globals()[name.upper()])
    for name in ("structure_documents", "explanation_documents", "edited_problems", "draft_fill", "schema_migration", "point_lookup", "error_rows", "enrollment_windows", "cluster_seconds", "asset_audit")
}
