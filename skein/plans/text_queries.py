"""Queries on texts: rules, validators, numerals, fuzzy matches, anchors and expectations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.shared import table
from skein.operators import fuzzy, rules, validate

#: ASCII patterns in place of the Korean ones, for conversations that have no Korean.
RULES_ASCII = {
    "dose_unit": "mg", "medication": "ther", "medication_action": "stop|ing", "question": r"\?\s*$", "exam_order": "show", "explicit_score": "score", "diagnosis": "onon", "vital": "(the|ing|ion|and)",
    "stop": "ou", "negated_stop": "thth", "start": "er", "symptom": "ea|or", "nocturnal": "nt", "directive": "re", "negation": "ti",
}
_ROLES = {"assistant": "doctor", "user": "patient", "system": "guardian"}


def _segments(spark, sf_dir):
    role = F.create_map(*[F.lit(x) for p in _ROLES.items() for x in p])[F.col("role")]
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.concat(F.lit("s"), F.col("turn")).alias("segment_id"), role.alias("role"), F.lower("text").alias("text"))


def rule_findings(spark, sf_dir):
    found = rules.extract(_segments(spark, sf_dir), RULES_ASCII, number=F.col("turn") % 3 == 0)
    return found.select("conv_id", "finding_id", F.col("ord").cast("long").alias("ord"), "category", "kind", "reported_by", "action", "polarity", F.array_join(F.sort_array("name_candidates"), ",").alias("names"), F.size("value_candidates").cast("long").alias("n_values"), "confidence")


_FINDINGS = """seg AS (
  SELECT conv_id, turn, 's' || turn AS segment_id, CASE role WHEN 'assistant' THEN 'doctor' WHEN 'user' THEN 'patient' ELSE 'guardian' END AS role, lower(text) AS text FROM conversations
), r AS (
  SELECT *, text LIKE '%mg%' OR (text LIKE '%ther%' AND regexp_matches(text, 'stop|ing')) AS med, text LIKE '%thth%' AS neg, list_distinct(regexp_extract_all(text, 'the|ing|ion|and')) AS unordered,
    regexp_extract_all(text, 'the|ing|ion|and') AS vit FROM seg
), c AS (
  SELECT *, CASE WHEN med THEN 'medication' WHEN role = 'doctor' AND text LIKE '%score%' THEN 'score' WHEN role = 'doctor' AND len(vit) > 0 THEN 'vital' WHEN role = 'doctor' AND text LIKE '%onon%' THEN 'diagnosis'
    WHEN role = 'doctor' AND text LIKE '%show%' THEN 'order' WHEN role = 'doctor' AND regexp_matches(text, '\\?\\s*$') THEN 'question' WHEN role <> 'doctor' THEN 'said' WHEN role = 'doctor' AND text LIKE '%re%' THEN 'plan' END AS rule FROM r
), f AS (
  SELECT *, 0 AS ord, CASE rule WHEN 'score' THEN 'exam' WHEN 'vital' THEN 'exam' WHEN 'order' THEN 'exam' WHEN 'question' THEN 'symptom' ELSE rule END AS category FROM c WHERE rule IS NOT NULL AND rule <> 'said'
  UNION ALL SELECT *, 0, 'follow_up' FROM c WHERE rule = 'said' AND text LIKE '%nt%'
  UNION ALL SELECT *, CASE WHEN text LIKE '%nt%' THEN 1 ELSE 0 END, 'symptom' FROM c WHERE rule = 'said' AND (text LIKE '%nt%' OR regexp_matches(text, 'ea|or'))
)""".replace("\\\\", "\\")
RULE_FINDINGS = f"""WITH {_FINDINGS}
SELECT conv_id, CASE category WHEN 'medication' THEN 'med' WHEN 'diagnosis' THEN 'dx' WHEN 'symptom' THEN 'sym' WHEN 'follow_up' THEN 'fu' ELSE category END || '-' || segment_id AS finding_id, ord::BIGINT AS ord, category,
  CASE rule WHEN 'score' THEN 'observation' WHEN 'vital' THEN CASE WHEN turn % 3 = 0 THEN 'observation' ELSE 'order' END WHEN 'diagnosis' THEN 'confirmed' WHEN 'order' THEN 'order' WHEN 'plan' THEN 'directive' END AS kind,
  CASE WHEN rule = 'question' THEN 'doctor_question' WHEN category = 'symptom' THEN role END AS reported_by,
  CASE WHEN rule = 'medication' THEN CASE WHEN neg THEN 'continue' WHEN text LIKE '%ou%' THEN 'stop' WHEN text LIKE '%er%' THEN 'start' ELSE 'unknown' END END AS action,
  CASE WHEN rule = 'medication' THEN CASE WHEN neg THEN 'negated' ELSE 'affirmed' END WHEN rule = 'question' THEN 'question' WHEN category = 'symptom' THEN CASE WHEN text LIKE '%ti%' THEN 'negated' ELSE 'affirmed' END
    WHEN rule IN ('diagnosis', 'plan') THEN 'affirmed' END AS polarity,
  CASE WHEN rule = 'vital' THEN array_to_string(list_sort(unordered, 'ASC'), ',') ELSE '' END AS names,
  CASE WHEN rule = 'vital' AND turn % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS n_values,
  CASE WHEN rule = 'score' THEN 'medium' WHEN rule = 'vital' THEN CASE WHEN len(unordered) > 1 THEN 'low' ELSE 'medium' END END AS confidence
FROM f"""


_KO = [
    ("k1", "doctor", "아스피린 오 밀리그램 드시면 됩니다"), ("k2", "doctor", "약을 끊지 마세요"), ("k3", "doctor", "혈압이 백사십오에 구십입니다"), ("k4", "doctor", "혈압을 재 볼까요?"),
    ("k5", "doctor", "체중 칠십 혈당 구십"), ("k6", "doctor", "진단은 파킨슨병입니다"), ("k7", "doctor", "팔을 들어보세요"), ("k8", "doctor", "어디가 아프신가요?"), ("k9", "guardian", "밤에 소리를 지르고 발로 차요"),
    ("k10", "patient", "증상이 안 좋아졌어요"), ("k11", "doctor", "다음 주에 오세요"), ("k12", "doctor", "NIHSS 는 총 3 점"), ("k13", "doctor", "삼십 킬로그램"), ("k14", "patient", "괜찮아요"), ("k15", "unknown", "증상"),
]


def rule_findings_ko(spark, sf_dir):
    """The Korean patterns: every turn says one of the sentences, by its number."""
    said = F.element_at(F.array(*[F.struct(*map(F.lit, x)) for x in _KO]), ((F.col("conv_id") + F.col("turn")) % len(_KO) + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("_s")).select("conv_id", "turn", F.col("_s.col1").alias("segment_id"), F.col("_s.col2").alias("role"), F.col("_s.col3").alias("text"))
    return rules.extract(rows).select("conv_id", "turn", "segment_id", "category", "kind", "reported_by", "action", "polarity", F.array_join("name_candidates", ",").alias("names"), "confidence")


RULE_FINDINGS_KO = """SELECT conv_id, turn, t.* FROM conversations JOIN (VALUES
  ('k1', 'medication', NULL, NULL, 'unknown', 'affirmed', '', NULL), ('k2', 'medication', NULL, NULL, 'continue', 'negated', '', NULL), ('k3', 'exam', 'observation', NULL, NULL, NULL, '혈압', 'medium'),
  ('k4', 'exam', 'order', NULL, NULL, NULL, '혈압', 'medium'), ('k5', 'exam', 'observation', NULL, NULL, NULL, '체중,혈당', 'low'), ('k6', 'diagnosis', 'confirmed', NULL, NULL, 'affirmed', '', NULL),
  ('k7', 'exam', 'order', NULL, NULL, NULL, '', NULL), ('k8', 'symptom', NULL, 'doctor_question', NULL, 'question', '', NULL), ('k9', 'follow_up', NULL, NULL, NULL, NULL, '', NULL),
  ('k9', 'symptom', NULL, 'guardian', NULL, 'affirmed', '', NULL), ('k10', 'symptom', NULL, 'patient', NULL, 'negated', '', NULL), ('k11', 'plan', 'directive', NULL, NULL, 'affirmed', '', NULL),
  ('k12', 'exam', 'observation', NULL, NULL, NULL, '', 'medium')
) AS t(segment_id, category, kind, reported_by, action, polarity, names, confidence) ON segment_id = 'k' || ((conv_id + turn) % 15 + 1)"""


def _made_findings(spark, sf_dir):
    """Findings, spans and segments made from conversations: quotes are right, cut from another turn, or empty."""
    segs = _segments(spark, sf_dir)
    cat = F.element_at(F.array(*map(F.lit, validate.ORDER)), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    some = lambda k: F.when(F.col("turn") % k == 0, F.array(F.lit("5"))).otherwise(F.array().cast("array<string>"))
    f = segs.select(
        "conv_id", cat.alias("category"), F.concat(F.lit("f"), F.col("turn")).alias("finding_id"), F.col("text").alias("raw_text"), F.col("turn").alias("ord"),
        F.when(F.col("turn") % 2 == 0, "stop").otherwise("start").alias("action"), F.lit(True).alias("score_computable"), some(4).alias("dose_candidates"), some(2).alias("score_candidates"), some(3).alias("value_candidates"), F.lit(False).alias("needs_review"),
    )
    quote = F.when(F.col("turn") % 5 == 4, F.lit("")).when(F.col("conv_id") % 4 == 3, F.concat(F.lit("#"), F.left("text", F.lit(9)))).otherwise(F.concat(F.substring("text", 3, 20)))
    spans = segs.select("conv_id", cat.alias("category"), F.concat(F.lit("f"), F.col("turn")).alias("finding_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("span_ord"), "turn", "role", quote.alias("_q"), "segment_id")
    second = F.col("span_ord") == 1
    spans = spans.select("conv_id", "category", "finding_id", "span_ord", F.when(second, F.concat(F.lit("s"), F.col("turn") + 1)).otherwise(F.col("segment_id")).alias("segment_id"), F.when(second, F.lit("e")).otherwise(F.col("_q")).alias("quote"), F.when(second, F.lit("patient")).otherwise(F.col("role")).alias("role"))
    return f, spans, segs


_MADE = """seg AS (
  SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'doctor' WHEN 'user' THEN 'patient' ELSE 'guardian' END AS role, lower(text) AS text FROM conversations
), f AS (
  SELECT *, ['medication', 'exam', 'diagnosis', 'symptom', 'plan', 'follow_up'][(conv_id + turn) % 6 + 1] AS category, 'f' || turn AS fid, (conv_id + turn) % 6 AS place,
    CASE WHEN turn % 5 = 4 THEN '' WHEN conv_id % 4 = 3 THEN '#' || text[:9] ELSE substr(text, 3, 20) END AS quote FROM seg
), e AS (
  SELECT f.*, f.quote <> '' AND contains(f.text, f.quote) AS g0, coalesce(contains(n.text, 'e'), FALSE) AS g1 FROM f LEFT JOIN seg n ON n.conv_id = f.conv_id AND n.turn = f.turn + 1
), x AS (
  SELECT *, g0::INT + g1::INT AS n_grounded, g0 AND regexp_matches(quote, '[0-9]') AS num, g0 AND role = 'doctor' AS by_doctor FROM e
)"""


def ground_spans(spark, sf_dir):
    _, spans, segs = _made_findings(spark, sf_dir)
    return validate.ground_spans(spans, segs).select("conv_id", "finding_id", F.col("span_ord").cast("long").alias("span_ord"), "grounded")


GROUND_SPANS = f"WITH {_MADE} SELECT conv_id, fid AS finding_id, 0::BIGINT AS span_ord, g0 AS grounded FROM x UNION ALL SELECT conv_id, fid, 1::BIGINT, g1 FROM x"


def validator_findings(spark, sf_dir):
    valid, _ = validate.validate_findings(*_made_findings(spark, sf_dir))
    n = lambda c: F.size(c).cast("long")
    return valid.select("conv_id", "category", "finding_id", "action", "score_computable", n("score_candidates").alias("n_scores"), n("value_candidates").alias("n_values"), "needs_review", F.col("ord").cast("long").alias("ord"))


VALIDATOR_FINDINGS = f"""WITH {_MADE}, y AS (SELECT *, category = 'diagnosis' AND NOT by_doctor AS demoted, category = 'exam' AND NOT num AND turn % 2 = 0 AS no_score, category = 'exam' AND NOT num AND turn % 3 = 0 AS no_value FROM x WHERE n_grounded > 0)
SELECT conv_id, CASE WHEN demoted THEN 'follow_up' ELSE category END AS category, CASE WHEN demoted THEN 'demoted-' ELSE '' END || fid AS finding_id, CASE WHEN turn % 2 = 0 THEN 'stop' ELSE 'start' END AS action,
  NOT no_score AS score_computable, CASE WHEN turn % 2 = 0 AND NOT no_score THEN 1 ELSE 0 END::BIGINT AS n_scores, CASE WHEN turn % 3 = 0 AND NOT no_value THEN 1 ELSE 0 END::BIGINT AS n_values,
  demoted OR (category = 'medication' AND turn % 4 = 0) OR (category = 'exam' AND (turn % 2 = 0 OR turn % 3 = 0)) AS needs_review, turn + CASE WHEN demoted THEN 1000000 ELSE 0 END AS ord FROM y"""


def validator_violations(spark, sf_dir):
    _, violations = validate.validate_findings(*_made_findings(spark, sf_dir))
    return violations.select("conv_id", F.col("violation_ord").cast("long").alias("violation_ord"), "violation")


VALIDATOR_VIOLATIONS = f"""WITH {_MADE}, v AS (
  SELECT *, 1 AS k, 'ungrounded source_span dropped (quote not in segment text)' AS t FROM x WHERE n_grounded < 2
  UNION ALL SELECT *, 2, 'dropped entirely (no grounded source_span)' FROM x WHERE n_grounded = 0
  UNION ALL SELECT *, 3, 'score_candidates without a verbatim number in source -- cleared' FROM x WHERE n_grounded > 0 AND category = 'exam' AND NOT num AND turn % 2 = 0
  UNION ALL SELECT *, 4, 'value_candidates without a verbatim number in source -- cleared' FROM x WHERE n_grounded > 0 AND category = 'exam' AND NOT num AND turn % 3 = 0
  UNION ALL SELECT *, 5, 'no doctor-sourced span -- moved to follow_up_questions, not a diagnosis' FROM x WHERE n_grounded > 0 AND category = 'diagnosis' AND NOT by_doctor
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place, turn, k)::BIGINT AS violation_ord, CASE WHEN category = 'follow_up' THEN 'follow_up_question' ELSE category END || ' ' || fid || ': ' || t AS violation FROM v"""


def explanation_grounding(spark, sf_dir):
    """Drafts that hold every line of their document, and for every third document a warning that it does not say."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    item = F.substring_index("text", "\n", -1)
    made = docs.select("doc_id", T.lines(F.col("text")).alias("current_situation"), F.when(F.col("doc_id") % 3 == 0, F.array(F.concat(F.lit("not said: "), item), F.lit("  "))).alias("warning_signs"), F.array(F.lit("")).alias("follow_up"))
    report = validate.explanation_issues(made, docs, fields=("current_situation", "warning_signs", "follow_up"))
    return report.select("doc_id", "valid", F.array_join("issues", "|").alias("issues"))


EXPLANATION_GROUNDING = r"""WITH e AS (SELECT doc_id, text, regexp_replace(regexp_replace('not said: ' || string_split(text, chr(10))[-1], '^\s+', ''), '\s+$', '') AS item FROM documents)
SELECT doc_id, doc_id % 3 <> 0 OR contains(text, item) AS valid, CASE WHEN doc_id % 3 <> 0 OR contains(text, item) THEN '' ELSE 'warning_signs: ''' || item[:60] || ''' is not grounded in the source transcript' END AS issues FROM e"""


def number_evidence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.has_number(F.col("text")).alias("has_number"))


NUMBER_EVIDENCE = r"SELECT doc_id, regexp_matches(text, '[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨영일이삼사오육륙칠팔구십백천만]') AS has_number FROM documents"


def _dictionary(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), 0)).alias("name")).distinct()
    return b.withColumn("ord", F.col("name"))


def _ascii(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.regexp_replace(F.lower("text"), "[^a-z ]", "").alias("text"))


def fuzzy_candidates(spark, sf_dir):
    found = fuzzy.fuzzy_candidates(_ascii(spark, sf_dir), _dictionary(spark, sf_dir), min_similarity=0.8)
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "span", "name", "similarity")


_FUZZY = """n AS (SELECT name, row_number() OVER (ORDER BY name) AS ord FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS name FROM benchmark)
), t AS (SELECT conv_id * 1000 + turn AS doc_id, string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' ') AS w FROM conversations
), r AS (
  SELECT doc_id, i - 1 AS start, i AS stop, w[i] AS span FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM t) WHERE w[i] <> ''
  UNION ALL SELECT doc_id, i - 1, i + 1, w[i] || w[i + 1] FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t) WHERE w[i] <> '' AND w[i + 1] <> ''
), x AS (SELECT DISTINCT doc_id, unnest(range(start, stop)) AS k FROM r WHERE span IN (SELECT name FROM n)
), s AS (SELECT span, name, ord, greatest(0, 1 - levenshtein(name, span)::DOUBLE / length(name)) AS sim FROM (SELECT DISTINCT span FROM r), n WHERE abs(length(span) - length(name)) <= length(name) * 0.2 + 0.001
), b AS (SELECT span, name, sim FROM (SELECT *, row_number() OVER (PARTITION BY span ORDER BY sim DESC, ord) AS k FROM s WHERE sim >= 0.8) WHERE k = 1
), c AS (SELECT r.doc_id, start, stop, r.span, name, round_even(sim, 3) AS similarity FROM r JOIN b ON r.span = b.span
  WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = r.doc_id AND x.k >= r.start AND x.k < r.stop))"""
FUZZY_CANDIDATES = f"WITH {_FUZZY} SELECT * FROM c"


def fuzzy_dictionary(spark, sf_dir):
    """The candidates that are chosen where some overlap."""
    found = fuzzy_candidates(spark, sf_dir)
    return fuzzy.select_candidates(found)


FUZZY_DICTIONARY = f"""WITH RECURSIVE {_FUZZY}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, stop - start, start) AS k FROM c
), g AS (
  SELECT doc_id, k, range(start, stop) AS taken, true AS fits FROM o WHERE k = 1
  UNION ALL SELECT doc_id, k, CASE WHEN ok THEN list_concat(taken, mine) ELSE taken END, ok FROM (
    SELECT o.doc_id, o.k, taken, range(start, stop) AS mine, NOT list_has_any(taken, range(start, stop)) AS ok FROM g JOIN o ON o.doc_id = g.doc_id AND o.k = g.k + 1))
SELECT o.doc_id, start, stop, span, name, similarity FROM o JOIN g ON g.doc_id = o.doc_id AND g.k = o.k WHERE fits"""


def anchor_checks(spark, sf_dir):
    """Whether each word of a benchmark item stands in the document of its number, spaces aside; SKIPPED where there is no such document."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.split("text", " "))).alias("anchor"))
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") * 3).alias("item_id"), F.replace("text", F.lit(" "), F.lit("")).alias("_t"))
    result = F.when(F.col("_t").isNull(), "SKIPPED").when(F.contains(F.col("_t"), F.col("anchor")), "PASS").otherwise("FAIL")
    return b.join(docs, "item_id", "left").select("item_id", "anchor", result.alias("result"))


ANCHOR_CHECKS = """SELECT item_id, anchor, CASE WHEN d.text IS NULL THEN 'SKIPPED' WHEN contains(replace(d.text, ' ', ''), anchor) THEN 'PASS' ELSE 'FAIL' END AS result
FROM (SELECT item_id, unnest(list_distinct(string_split(text, ' '))) AS anchor FROM benchmark) b LEFT JOIN documents d ON d.doc_id * 3 = b.item_id"""


def expectation_eval(spark, sf_dir):
    """Declared expectations (segment, category, wanted or not) against the findings that the rules make, counted by kind."""
    segs = _segments(spark, sf_dir)
    found = rules.extract(segs, RULES_ASCII, number=F.col("turn") % 3 == 0).select("conv_id", "segment_id", F.col("category").alias("_c"))
    wanted = segs.select("conv_id", "segment_id", F.explode(F.array(F.lit("medication"), F.lit("symptom"), F.lit("exam"))).alias("category"), (F.col("turn") % 2 == 0).alias("wanted"))
    hit = wanted.join(found, ["conv_id", "segment_id"], "left").groupBy("conv_id", "segment_id", "category", "wanted").agg(F.coalesce(F.bool_or(F.col("_c") == F.col("category")), F.lit(False)).alias("hit"))
    return hit.groupBy("category", "wanted").agg(F.count("*").alias("n_checks"), F.count_if(F.col("hit") == F.col("wanted")).alias("n_passed"))


EXPECTATION_EVAL = f"""WITH {_FINDINGS}, w AS (SELECT conv_id, segment_id, unnest(['medication', 'symptom', 'exam']) AS category, turn % 2 = 0 AS wanted FROM seg
), h AS (SELECT w.*, EXISTS (SELECT 1 FROM f WHERE f.conv_id = w.conv_id AND f.segment_id = w.segment_id AND f.category = w.category) AS hit FROM w)
SELECT category, wanted, count(*)::BIGINT AS n_checks, count(*) FILTER (hit = wanted)::BIGINT AS n_passed FROM h GROUP BY category, wanted"""

QUERIES = {
    "rule_findings": (rule_findings, RULE_FINDINGS),
    "rule_findings_ko": (rule_findings_ko, RULE_FINDINGS_KO),
    "ground_spans": (ground_spans, GROUND_SPANS),
    "validator_findings": (validator_findings, VALIDATOR_FINDINGS),
    "validator_violations": (validator_violations, VALIDATOR_VIOLATIONS),
    "explanation_grounding": (explanation_grounding, EXPLANATION_GROUNDING),
    "number_evidence": (number_evidence, NUMBER_EVIDENCE),
    "fuzzy_candidates": (fuzzy_candidates, FUZZY_CANDIDATES),
    "fuzzy_dictionary": (fuzzy_dictionary, FUZZY_DICTIONARY),
    "anchor_checks": (anchor_checks, ANCHOR_CHECKS),
    "expectation_eval": (expectation_eval, EXPECTATION_EVAL),
}
