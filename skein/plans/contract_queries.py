"""Queries of declared expectations, typed decoding, sidecars, retried appends, merged schemas, role maps and edited drafts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein.functions import constants as K
from skein.functions import text as T
from skein.functions.shared import shared_folder, table
from skein.operators import documents, edit, expectations, rules, store, validate
from skein.plans.text_queries import _MADE, RULE_FINDINGS, RULES_ASCII, _made_findings, _segments
from skein.sources import decode, tables

_KEYS = ("conv_id", "segment_id")
#: What is expected of every segment: check_id, kind, alternative, category, field, op, values, quantifier.
_RULES = (
    ("treated", "genuine", 0, "medication", "action", "equals", ("stop", "start"), "any"),
    ("treated", "genuine", 1, "exam", "value_candidates", "filled", (), "any"),
    ("question", "forbidden_question_confirmed", 0, "symptom", "polarity", "equals", ("question",), "all"),
    ("question", "forbidden_question_confirmed", 0, "diagnosis", None, "cited", (), "none"),
    ("scored", "forbidden_score", 0, None, "score_computable", "true", (), "none"),
    ("named", "genuine", 0, None, "name_candidates", "contains", ("ing", "ion"), "any"),
)


def expectation_checks(spark, sf_dir):
    """Every check of every segment."""
    segs = _segments(spark, sf_dir)
    found = rules.extract(segs, RULES_ASCII, number=F.col("turn") % 3 == 0).drop("turn", "role", "text")
    return expectations.evaluate(expectations.declared(segs, _KEYS, _RULES), found, _KEYS)


EXPECTATION_CHECKS = f"""WITH q AS (SELECT *, substr(finding_id, strpos(finding_id, '-') + 1) AS segment_id FROM ({RULE_FINDINGS})), s AS (SELECT conv_id, 's' || turn AS segment_id FROM conversations
), g AS (
  SELECT s.conv_id, s.segment_id, coalesce(bool_or((category = 'medication' AND action IN ('stop', 'start')) OR (category = 'exam' AND n_values > 0)), false) AS treated,
    NOT coalesce(bool_or((category = 'symptom' AND polarity IS DISTINCT FROM 'question') OR category = 'diagnosis'), false) AS question,
    NOT coalesce(bool_or(category = 'exam' AND kind = 'observation' AND names = '' AND confidence = 'medium'), false) AS scored, coalesce(bool_or(regexp_matches(names, 'ing|ion')), false) AS named
  FROM s LEFT JOIN q ON q.conv_id = s.conv_id AND q.segment_id = s.segment_id GROUP BY s.conv_id, s.segment_id)
SELECT conv_id, segment_id, 'treated' AS check_id, 'genuine' AS kind, treated AS passed FROM g UNION ALL SELECT conv_id, segment_id, 'question', 'forbidden_question_confirmed', question FROM g
UNION ALL SELECT conv_id, segment_id, 'scored', 'forbidden_score', scored FROM g UNION ALL SELECT conv_id, segment_id, 'named', 'genuine', named FROM g"""


def expectation_counts(spark, sf_dir):
    """Checks and passes by kind."""
    return expectations.counts(expectation_checks(spark, sf_dir))


EXPECTATION_COUNTS = f"SELECT kind, count(*)::BIGINT AS n_checks, count(*) FILTER (passed)::BIGINT AS n_passed FROM ({EXPECTATION_CHECKS}) GROUP BY kind"

_FIELDS = (
    decode.Field("id", "bigint", required=True), decode.Field("status", "string", values=("click", "view", "purchase", "signup"), required=True), decode.Field("consent", "boolean", flag=True),
    decode.Field("value", "double"), decode.Field("tags", "array<string>"),
)


def _json_rows(spark, sf_dir):
    """Events as JSON rows, some of them cut, of another shape, without an id, or with a value of another type."""
    e = table(spark, sf_dir, "events").withColumn("k", F.col("event_id") % 10)
    made = F.to_json(F.struct(
        F.when(F.col("k") != 3, F.col("event_id")).alias("id"), F.col("event_type").alias("status"), F.when(F.col("k") == 4, 2).otherwise(F.col("event_id") % 2).alias("consent"),
        F.when(F.col("k") == 5, F.lit("much")).otherwise(F.lit(None)).alias("value"), F.array(F.col("event_type"), F.lit("x")).alias("tags"),
    ))
    number = F.concat(F.expr("left(json, length(json) - 1)"), F.lit(',"value":'), F.col("user_id"), F.lit(".5}"))
    e = e.withColumn("json", made).withColumn("json", F.when(F.col("k") == 6, number).otherwise(F.col("json")))
    wrong_tags = F.regexp_replace("json", r'"tags":\[.*\]', '"tags":{"a":1}')
    return e.select("event_id", F.when(F.col("k") == 1, F.left("json", F.lit(9))).when(F.col("k") == 2, F.lit("[1, 2]")).when(F.col("k") == 7, wrong_tags).otherwise(F.col("json")).alias("json"))


def decoded_rows(spark, sf_dir):
    good, _ = decode.decode(_json_rows(spark, sf_dir), "json", _FIELDS)
    return good.select("event_id", "id", "status", "consent", "value", F.array_join("tags", ",").alias("tags"))


DECODED_ROWS = """SELECT event_id, event_id AS id, event_type AS status, event_id % 2 = 1 AS consent, CASE WHEN event_id % 10 = 6 THEN user_id + 0.5 END::DOUBLE AS value, event_type || ',x' AS tags
FROM events WHERE event_id % 10 NOT IN (1, 2, 3, 4, 5, 7) AND event_type IN ('click', 'view', 'purchase', 'signup')"""


def decode_rejects(spark, sf_dir):
    _, bad = decode.decode(_json_rows(spark, sf_dir), "json", _FIELDS)
    return bad.select("event_id", F.array_join("reasons", "; ").alias("reasons"))


DECODE_REJECTS = """SELECT event_id, CASE k WHEN 1 THEN 'not JSON' WHEN 2 THEN 'not an object' ELSE concat_ws('; ', CASE WHEN k = 3 THEN 'id: missing' END, CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 'status: unknown value ' || event_type END,
  CASE WHEN k = 4 THEN 'consent: not a flag' END, CASE WHEN k = 5 THEN 'value: not a double' END, CASE WHEN k = 7 THEN 'tags: not a array<string>' END) END AS reasons
FROM (SELECT *, event_id % 10 AS k FROM events) WHERE k IN (1, 2, 3, 4, 5, 7) OR event_type NOT IN ('click', 'view', 'purchase', 'signup')"""


def sidecar_segments(spark, sf_dir):
    """Segments of each conversation's sidecar; every other one is a bare list."""
    c = table(spark, sf_dir, "conversations")
    seg = F.struct(F.concat(F.lit("s"), "turn").alias("id"), F.col("role").alias("speaker"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 0.5).alias("end"), "text")
    raw = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", seg.alias("s")))).alias("_s")).select("conv_id", F.transform("_s", lambda x: x["s"]).alias("segments"))
    raw = raw.select("conv_id", F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct("segments"))).otherwise(F.to_json("segments")).alias("value"))
    return tables.parse_segments(raw, "value").select("conv_id", F.col("ord").cast("long").alias("ord"), "id", "speaker", "role", "start", "end", "text")


SIDECAR_SEGMENTS = """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT - 1 AS ord, 's' || turn AS id, role AS speaker, 'unknown' AS role, turn::DOUBLE AS start, turn + 0.5::DOUBLE AS "end", text FROM conversations"""


def typed_documents(spark, sf_dir):
    """Structures of all documents, written as JSON and read as typed ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.to_json(documents.structure_of(F.col("text"))).alias("structure"))
    typed = tables.parse_documents(docs, "structure", tables.STRUCTURE)
    return typed.select("doc_id", F.posexplode("structure.problems").alias("i", "p")).select("doc_id", F.col("i").cast("long").alias("ord"), "p.text", "p.certainty", F.array_join("p.source_segment_ids", ",").alias("sources"))


TYPED_DOCUMENTS = r"""SELECT doc_id, k - 1 AS ord, line AS text, 'stated' AS certainty, 'seg-' || k AS sources FROM (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS k FROM (SELECT doc_id, trim(l) AS line, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE line <> '')"""


def appended_batches(spark, sf_dir):
    """The log after two batches, of which the second was written twice, as a retried driver would."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    path = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}"
    for batch, rows in (("a", "event_id % 2 = 0"), ("b", "event_id % 2 = 1 AND event_id % 3 = 0"), ("b", "event_id % 2 = 1"), ("c", "false")):
        store.append_batch(e.where(rows), path, batch)
    return spark.read.parquet(path).select("event_id", "user_id", "event_type", F.col("batch").cast("string").alias("batch"))


APPENDED_BATCHES = "SELECT event_id, user_id, event_type, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS batch FROM events"


def merged_versions(spark, sf_dir):
    """Orders of two versions in one folder; the later files have another order of columns and one more."""
    o = table(spark, sf_dir, "orders")
    path = f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus").write.parquet(path)
    o.where("o_orderkey % 2 = 1").select("o_orderpriority", "o_orderstatus", "o_orderkey").write.mode("append").parquet(path)
    return tables.read_versions(spark, path).select("o_orderkey", "o_orderstatus", "o_orderpriority")


MERGED_VERSIONS = "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS o_orderpriority FROM orders"


def confirmed_roles(spark, sf_dir):
    """Runs after role maps were asked for; each conversation is a run. Maps of every third run name a speaker that it lacks, those of every fourth are empty."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("role").alias("speaker"))
    ids = c.select("run_id").distinct()
    runs = ids.select("run_id", F.col("run_id").alias("encounter_id"), F.lit(None).cast("map<string,string>").alias("roles"), F.lit("t0").alias("updated_at"))
    named = F.when(F.col("run_id") % 4 == 0, F.create_map().cast("map<string,string>")).when(F.col("run_id") % 3 == 0, F.create_map(F.lit("nobody"), F.lit("doctor"))).otherwise(F.create_map(F.lit("user"), F.lit("patient")))
    asked = ids.select("run_id", named.alias("roles"), F.lit("t1").alias("created_at")).unionByName(ids.where("run_id % 5 = 0").select((-F.col("run_id") - 1).alias("run_id"), F.create_map(F.lit("user"), F.lit("x")).alias("roles"), F.lit("t1").alias("created_at")))
    after, audit, refused = store.set_roles(runs, c, asked)
    a = after.select("run_id", F.lit("run").alias("what"), F.to_json("roles").alias("detail"), "updated_at")
    b = audit.select(F.col("encounter_id").alias("run_id"), F.lit("audit").alias("what"), "detail", F.col("created_at").alias("updated_at"))
    return a.unionByName(b).unionByName(refused.select("run_id", F.lit("refused").alias("what"), F.to_json("roles").alias("detail"), F.col("created_at").alias("updated_at")))


CONFIRMED_ROLES = """WITH i AS (SELECT conv_id, bool_or(role = 'user') AS has_user FROM conversations GROUP BY conv_id
), r AS (SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN '{}' WHEN conv_id % 3 = 0 THEN '{"nobody":"doctor"}' ELSE '{"user":"patient"}' END AS m, conv_id % 4 <> 0 AND conv_id % 3 <> 0 AND has_user AS ok FROM i)
SELECT conv_id AS run_id, 'run' AS what, CASE WHEN ok THEN m END AS detail, CASE WHEN ok THEN 't1' ELSE 't0' END AS updated_at FROM r UNION ALL SELECT conv_id, 'audit', '{"run_id":' || conv_id || '}', 't1' FROM r WHERE ok
UNION ALL SELECT conv_id, 'refused', m, 't1' FROM r WHERE NOT ok UNION ALL SELECT -conv_id - 1, 'refused', '{"user":"x"}', 't1' FROM r WHERE conv_id % 5 = 0"""


def demoted_questions(spark, sf_dir):
    """The questions that diagnoses without a doctor's span have become."""
    found, spans, segs = _made_findings(spark, sf_dir)
    return validate.demoted_questions(found, validate.validate_findings(found, spans, segs)[0])


DEMOTED_QUESTIONS = f"""WITH {_MADE} SELECT conv_id, 'demoted-' || fid AS finding_id, text AS trigger_text, '{K.DEMOTED_QUESTION}' || text AS suggested_question, '{K.DEMOTED_RATIONALE}' AS rationale, true AS needs_review
FROM x WHERE n_grounded > 0 AND category = 'diagnosis' AND NOT by_doctor"""


def plain_character_rates(spark, sf_dir):
    """The second definition of the character error rate, over whole turns."""
    a = F.regexp_replace("text", "[^ -~]", "?")
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 9 != 4, a).otherwise("").alias("ref"), F.replace(a, F.lit("th"), F.lit("t")).alias("hyp"))
    return df.select("conv_id", "turn", F.round(edit.plain_character_rate(F.col("ref"), F.col("hyp")), 9).alias("rate"))


PLAIN_CHARACTER_RATES = """WITH a AS (SELECT conv_id, turn, regexp_replace(text, '[^ -~]', '?', 'g') AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 9 = 4 OR t = '' THEN CASE WHEN t = '' THEN 0.0 ELSE 1.0 END ELSE round(levenshtein(t, replace(t, 'th', 't'))::DOUBLE / length(t), 9) END::DOUBLE AS rate FROM a"""


def edited_explanations(spark, sf_dir):
    """Drafts of all documents with a new notice and new warnings, a line each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", documents.explanation_of(documents.structure_of(F.col("text"))).alias("e"))
    edited = docs.select("doc_id", documents.edit_explanation(F.col("e"), F.lit("seen"), {"warning_signs": F.concat(F.lit("  call \n\n"), F.col("text"))}).alias("e"))
    return edited.select("doc_id", "e.draft_notice", F.size("e.current_situation").cast("long").alias("n_situation"), F.array_join("e.warning_signs", "|").alias("warnings"))


EDITED_EXPLANATIONS = r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, 'seen' AS draft_notice, len(w)::BIGINT AS n_situation, array_to_string(list_concat(['call'], w), '|') AS warnings FROM l"""

_DIGIT = [("", 1), ("십", 10), ("백", 100), ("천", 1000), ("만", 10000)]
_NAMES = ["", "일", "이", "삼", "사", "오", "육", "칠", "팔", "구"]


def number_word_normalize(spark, sf_dir):
    """Numerals of all part numbers before unit words, and before a word that is no unit, within the parts' names."""
    n = F.col("p_partkey") % 100_000

    def word(unit: str, size: int):
        d = (F.floor(n / size) % 10).cast("int")
        return F.when(d == 0, "").when((d == 1) & F.lit(unit != ""), unit).otherwise(F.concat(F.element_at(F.array(*map(F.lit, _NAMES)), d + 1), F.lit(unit)))

    p = table(spark, sf_dir, "part")
    unit = F.element_at(F.array(F.lit("mg"), F.lit("밀리그램"), F.lit("분")), (F.col("p_partkey") % 3 + 1).cast("int"))
    text = F.concat_ws(" ", "p_name", F.concat(*[word(u, s) for u, s in reversed(_DIGIT)]), unit, "p_name")
    return p.select("p_partkey", text.alias("text")).select("p_partkey", "text", T.normalize_numerals(F.col("text")).alias("normalized"))


_SAID = " || ".join(f"(CASE WHEN n // {s} % 10 = 0 THEN '' WHEN n // {s} % 10 = 1 AND '{u}' <> '' THEN '{u}' ELSE {_NAMES!r}[(n // {s} % 10 + 1)::INT] || '{u}' END)" for u, s in reversed(_DIGIT))
NUMBER_WORD_NORMALIZE = f"""WITH p AS (SELECT p_partkey, p_name, p_partkey % 100000 AS n, ['mg', '밀리그램', '분'][(p_partkey % 3 + 1)::INT] AS unit FROM part), w AS (SELECT *, {_SAID} AS said FROM p)
SELECT p_partkey, p_name || ' ' || said || ' ' || unit || ' ' || p_name AS text, p_name || ' ' || CASE WHEN unit = '분' OR n = 0 THEN said ELSE n::VARCHAR END || ' ' || unit || ' ' || p_name AS normalized FROM w"""

QUERIES = {
    name: (globals()[name], globals()[name.upper()])
    for name in (
        "expectation_checks", "expectation_counts", "decoded_rows", "decode_rejects", "sidecar_segments", "typed_documents", "appended_batches", "merged_versions", "confirmed_roles", "demoted_questions",
        "plain_character_rates", "edited_explanations", "number_word_normalize",
    )
}
