"""Grounding and safety checks of findings and explanations.

Findings are one long table (key, category, finding_id, raw_text, kind, action, polarity,
score_computable, dose_candidates, score_candidates, value_candidates, needs_review, ord);
their evidence is another (key, category, finding_id, span_ord, segment_id, quote, role).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import constants as K
from skein.functions.text import has_number, strip

#: Categories in the order in which their violations are listed.
ORDER = ("medication", "exam", "diagnosis", "symptom", "plan", "follow_up")


def ground_spans(spans: DataFrame, segments: DataFrame, key: str = "conv_id") -> DataFrame:
    """Spans with ``grounded``: the segment exists and its text holds the quote, which is not empty."""
    texts = segments.select(key, "segment_id", F.col("text").alias("_text"))
    quoted = (F.col("quote") != "") & F.contains(F.col("_text"), F.col("quote"))
    return spans.join(texts, [key, "segment_id"], "left").withColumn("grounded", F.coalesce(quoted, F.lit(False))).drop("_text")


def validate_findings(findings: DataFrame, spans: DataFrame, segments: DataFrame, key: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """(valid findings, violations).

    A finding without a grounded span goes. A medication that a negated sentence would stop becomes unknown; score and
    value candidates without a number in any grounded quote are cleared; what numbers remain need review; a diagnosis
    without a doctor's span becomes a follow-up question behind the others.
    """
    at = [key, "category", "finding_id"]
    good = F.col("grounded")
    evidence = ground_spans(spans, segments, key).groupBy(*at).agg(
        F.count("*").alias("n_spans"), F.count_if(good).alias("n_grounded"),
        F.coalesce(F.bool_or(good & has_number(F.col("quote"))), F.lit(False)).alias("has_number"),
        F.coalesce(F.bool_or(good & F.col("quote").rlike(K.RULES_KO["negated_stop"])), F.lit(False)).alias("negates_stop"),
        F.coalesce(F.bool_or(good & (F.col("role") == "doctor")), F.lit(False)).alias("by_doctor"),
    )
    df = findings.join(evidence, at, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_spans", "n_grounded")})
    df = df.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_number", "negates_stop", "by_doctor")})
    held = F.col("n_grounded") > 0
    is_a = lambda c: F.col("category") == c
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    downgraded = held & is_a("medication") & F.coalesce(F.col("action") == "stop", F.lit(False)) & F.col("negates_stop")
    no_score = held & is_a("exam") & some("score_candidates") & ~F.col("has_number")
    no_value = held & is_a("exam") & some("value_candidates") & ~F.col("has_number")
    demoted = held & is_a("diagnosis") & ~F.col("by_doctor")
    name = F.concat(F.when(is_a("follow_up"), F.lit("follow_up_question")).otherwise(F.col("category")), F.lit(" "), F.col("finding_id"), F.lit(": "))
    said = [
        (F.col("n_grounded") < F.col("n_spans"), K.SPAN_DROPPED),
        (~held, K.FINDING_DROPPED),
        (downgraded, K.STOP_DOWNGRADED),
        (no_score, K.SCORE_CLEARED),
        (no_value, K.VALUE_CLEARED),
        (demoted, K.DIAGNOSIS_MOVED),
    ]
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("category"))
    texts = F.array_compact(F.array(*[F.when(c, F.concat(name, F.lit(t))) for c, t in said]))
    listed = df.select(key, place.alias("_place"), "ord", F.posexplode(texts).alias("_n", "violation"))
    violation_ord = F.row_number().over(Window.partitionBy(key).orderBy("_place", "ord", "_n"))
    violations = listed.select(key, violation_ord.alias("violation_ord"), "violation")
    none = F.array().cast("array<string>")
    numbers_left = (some("score_candidates") & ~no_score) | (some("value_candidates") & ~no_value)
    review = F.col("needs_review") | downgraded | no_score | no_value | (is_a("medication") & some("dose_candidates")) | (is_a("exam") & numbers_left) | demoted
    valid = df.where(held).withColumns({
        "action": F.when(downgraded, "unknown").otherwise(F.col("action")),
        "score_computable": F.when(no_score, False).otherwise(F.col("score_computable")),
        "score_candidates": F.when(no_score, none).otherwise(F.col("score_candidates")),
        "value_candidates": F.when(no_value, none).otherwise(F.col("value_candidates")),
        "needs_review": F.coalesce(review, F.col("needs_review")),
        "ord": F.when(demoted, F.col("ord") + 1_000_000).otherwise(F.col("ord")),
        "finding_id": F.when(demoted, F.concat(F.lit("demoted-"), F.col("finding_id"))).otherwise(F.col("finding_id")),
        "category": F.when(demoted, "follow_up").otherwise(F.col("category")),
    })
    return valid.select(*findings.columns), violations


def demoted_questions(findings: DataFrame, valid: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, finding_id, trigger_text, suggested_question, rationale, needs_review): the follow-up questions that diagnoses without a doctor's span have become.

    ``valid`` are the findings that validate_findings leaves. A diagnosis's own text triggers the question and ends it; a null text counts as empty.
    """
    moved = valid.where("category = 'follow_up' AND startswith(finding_id, 'demoted-')").select(key, "finding_id", "needs_review")
    texts = findings.where("category = 'diagnosis'").select(key, F.concat(F.lit("demoted-"), "finding_id").alias("finding_id"), F.coalesce("raw_text", F.lit("")).alias("trigger_text"))
    out = moved.join(texts, [key, "finding_id"])
    return out.select(key, "finding_id", "trigger_text", F.concat(F.lit(K.DEMOTED_QUESTION), "trigger_text").alias("suggested_question"), F.lit(K.DEMOTED_RATIONALE).alias("rationale"), "needs_review")


def explanation_issues(explanations: DataFrame, transcripts: DataFrame, key: str = "doc_id", fields: tuple[str, ...] = K.EXPLANATION_FIELDS) -> DataFrame:
    """Report per key: ``valid`` and ``issues``, ordered by field and item, for items that the transcript does not hold. Blank items pass."""
    def items(n: int, field: str):
        values = F.coalesce(field, F.array().cast("array<string>"))
        return F.transform(values, lambda x, i: F.struct(F.lit(n).alias("f"), i.alias("i"), F.lit(field).alias("field"), strip(x).alias("item")))

    rows = F.flatten(F.array(*[items(n, field) for n, field in enumerate(fields)]))
    df = explanations.select(key, F.filter(rows, lambda r: r["item"] != "").alias("_rows")).join(transcripts.select(key, F.col("text").alias("_t")), key)
    loose = F.filter("_rows", lambda r: ~F.contains(F.col("_t"), r["item"]))
    text = F.transform(loose, lambda r: F.concat(r["field"], F.lit(": '"), F.left(r["item"], F.lit(60)), F.lit("' is not grounded in the source transcript")))
    return df.select(key, (F.size(text) == 0).alias("valid"), text.alias("issues"))
