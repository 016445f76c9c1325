"""Rule-based findings: an ordered first-match classifier over segments, as one expression."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import constants as K
from skein.functions.text import has_number

FINDING = "category string, kind string, reported_by string, action string, polarity string, score_computable boolean, name_candidates array<string>, score_candidates array<string>, value_candidates array<string>, confidence string, needs_review boolean"


class FindingExtractor(Protocol):
    """Anything that turns segments into findings; ``extract`` is the rule-based one, a model's would use mapInPandas."""

    def __call__(self, segments: DataFrame) -> DataFrame: ...


def _finding(category: str, **fields) -> Column:
    out = []
    for f in FINDING.split(", "):
        name, kind = f.split(" ")
        v = category if name == "category" else fields.get(name, True if name == "needs_review" else F.array() if "array" in kind else None)
        out.append((v if isinstance(v, Column) else F.lit(v)).cast(kind).alias(name))
    return F.struct(*out)


def findings_of(text: Column, role: Column, rules: dict[str, str] = K.RULES_KO, number: Column | None = None) -> Column:
    """The findings of a segment, an array of none, one or two. The first rule that fits decides; ``number`` is evidence of a number."""
    hit = lambda name: text.rlike(rules[name])
    number = has_number(text) if number is None else number
    doctor, patient = role == "doctor", role.isin("patient", "guardian")
    action = F.when(hit("negated_stop"), "continue").when(hit("stop"), "stop").when(hit("start"), "start").otherwise("unknown")
    polarity = F.when(hit("negated_stop"), "negated").otherwise("affirmed")
    medication = _finding("medication", action=action, polarity=polarity)
    vitals = F.array_distinct(F.regexp_extract_all(text, F.lit(rules["vital"]), 1))
    score = _finding("exam", kind="observation", score_computable=True, score_candidates=F.array(text), confidence="medium")
    vital = _finding(
        "exam", kind=F.when(number, "observation").otherwise("order"), score_computable=False, name_candidates=vitals,
        value_candidates=F.when(number, F.array(text)).otherwise(F.array().cast("array<string>")), confidence=F.when(F.size(vitals) > 1, "low").otherwise("medium"),
    )
    symptom = _finding("symptom", reported_by=role, polarity=F.when(hit("negation"), "negated").otherwise("affirmed"))
    none = F.array().cast(f"array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>")
    said = F.concat(F.when(hit("nocturnal"), F.array(_finding("follow_up"))).otherwise(none), F.when(hit("nocturnal") | hit("symptom"), F.array(symptom)).otherwise(none))
    return (
        F.when(hit("dose_unit") | (hit("medication") & hit("medication_action")), F.array(medication))
        .when(doctor & hit("explicit_score"), F.array(score))
        .when(doctor & hit("vital"), F.array(vital))
        .when(doctor & hit("diagnosis"), F.array(_finding("diagnosis", kind="confirmed", polarity="affirmed")))
        .when(doctor & hit("exam_order"), F.array(_finding("exam", kind="order", score_computable=False)))
        .when(doctor & hit("question"), F.array(_finding("symptom", reported_by="doctor_question", polarity="question")))
        .when(patient, said)
        .when(doctor & hit("directive"), F.array(_finding("plan", kind="directive", polarity="affirmed")))
        .otherwise(none)
    )


_PREFIX = {"medication": "med", "exam": "exam", "diagnosis": "dx", "symptom": "sym", "follow_up": "fu", "plan": "plan"}


def extract(segments: DataFrame, rules: dict[str, str] = K.RULES_KO, *, number: Column | None = None, roles: Column | None = None) -> DataFrame:
    """Segments (segment_id, role, text and others) to findings: a row each, with finding_id and ord. A confirmed role map takes the place of the segment's own role."""
    role = F.col("role") if roles is None else F.coalesce(roles[F.col("speaker")], F.col("role"))
    df = segments.withColumn("role", role)
    df = df.select(*df.columns, F.posexplode(findings_of(F.col("text"), F.col("role"), rules, number)).alias("ord", "_f"))
    prefix = F.create_map(*[F.lit(x) for pair in _PREFIX.items() for x in pair])
    return df.select(*[c for c in df.columns if c != "_f"], "_f.*").withColumn("finding_id", F.concat(prefix[F.col("category")], F.lit("-"), F.col("segment_id")))
