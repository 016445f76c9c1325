"""Hand-computed cases of text expressions, rules, validators and fuzzy matches."""

import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import fuzzy, rules, validate


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("run,want", [("오", 5), ("십오", 15), ("십", 10), ("백사십오", 145), ("구십이", 92), ("백", 100), ("일이", None), ("오진", None), ("이만삼천", 23000), ("만", 10000)])
def test_numerals(spark, run, want):
    assert one(spark, run, T.numeral_value) == want


@pytest.mark.parametrize("text,want", [("오 밀리그램", "5 밀리그램"), ("오 분", "오 분"), ("어머 오! 회", "어머 오! 회"), ("삼", "삼"), ("a  b", "a  b")])
def test_numerals_before_units(spark, text, want):
    assert one(spark, text, T.normalize_numerals) == want


@pytest.mark.parametrize("text,want", [("12", True), ("백이십", True), ("abc", False), ("", False), ("①", True)])
def test_number_evidence(spark, text, want):
    assert one(spark, text, T.has_number) is want


@pytest.mark.parametrize(
    "text,ms,want",
    [("안녕하세요 어디가 아프세요", 2000, False), ("안녕하세요 어디가 아프세요", 100, True), ("...", 2000, True), ("这是", 2000, True), ("hello there", 2000, False), ("구독과 좋아요", 2000, True), ("-", 2000, True)],
)
def test_garbage(spark, text, ms, want):
    assert one(spark, text, lambda x: T.is_garbage(x, F.lit(ms))) is want


def test_negated_stop_is_continue(spark):
    rows = spark.createDataFrame([("s1", "doctor", "그 약은 끊지 마세요")], "segment_id string, role string, text string")
    r = rules.extract(rows).first()
    assert (r.category, r.action, r.polarity, r.finding_id) == ("medication", "continue", "negated", "med-s1")


def test_roles_map_takes_the_place_of_the_segment_role(spark):
    rows = spark.createDataFrame([("s1", "A", "unknown", "진단은 감기입니다")], "segment_id string, speaker string, role string, text string")
    assert rules.extract(rows).count() == 0
    assert rules.extract(rows, roles=F.create_map(F.lit("A"), F.lit("doctor"))).first().category == "diagnosis"


FINDING = "conv_id long, category string, finding_id string, raw_text string, ord long, action string, score_computable boolean, dose_candidates array<string>, score_candidates array<string>, value_candidates array<string>, needs_review boolean"


def validated(spark, finding, spans, text="그 약은 끊지 마세요 점수 삼"):
    f = spark.createDataFrame([(1, *finding)], FINDING)
    s = spark.createDataFrame([(1, finding[0], finding[1], i, *x) for i, x in enumerate(spans)], "conv_id long, category string, finding_id string, span_ord int, segment_id string, quote string, role string")
    segs = spark.createDataFrame([(1, "s1", text)], "conv_id long, segment_id string, text string")
    valid, violations = validate.validate_findings(f, s, segs)
    return valid.collect(), [r.violation for r in violations.orderBy("violation_ord").collect()]


def test_ungrounded_finding_is_dropped(spark):
    valid, said = validated(spark, ("symptom", "f", "", 0, None, None, [], [], [], False), [("s1", "nothing", "patient")])
    assert valid == [] and [x.split(": ")[1][:10] for x in said] == ["ungrounded", "dropped en"]


def test_finding_without_spans_is_dropped_with_one_message(spark):
    f = spark.createDataFrame([(1, "plan", "f", "", 0, None, None, [], [], [], False)], FINDING)
    s = spark.createDataFrame([], "conv_id long, category string, finding_id string, span_ord int, segment_id string, quote string, role string")
    segs = spark.createDataFrame([(1, "s1", "x")], "conv_id long, segment_id string, text string")
    valid, violations = validate.validate_findings(f, s, segs)
    assert valid.count() == 0 and violations.count() == 1


def test_stop_against_negation_is_unknown(spark):
    valid, said = validated(spark, ("medication", "f", "", 0, "stop", None, [], [], [], False), [("s1", "끊지 마세요", "doctor")])
    assert valid[0].action == "unknown" and valid[0].needs_review and len(said) == 1


@pytest.mark.parametrize("quote,scores,computable", [("약은", [], False), ("점수 삼", ["3"], True)])
def test_score_needs_a_number_in_the_quote(spark, quote, scores, computable):
    valid, _ = validated(spark, ("exam", "f", "", 0, None, True, [], ["3"], [], False), [("s1", quote, "doctor")])
    assert (valid[0].score_candidates, valid[0].score_computable, valid[0].needs_review) == (scores, computable, True)


def test_diagnosis_without_doctor_becomes_follow_up(spark):
    valid, said = validated(spark, ("diagnosis", "f", "", 0, None, None, [], [], [], False), [("s1", "약은", "patient")])
    assert (valid[0].category, valid[0].finding_id) == ("follow_up", "demoted-f") and "no doctor" in said[0]


def test_explanation_items(spark):
    docs = spark.createDataFrame([(1, "aspirin 5 mg daily")], "doc_id long, text string")
    e = spark.createDataFrame([(1, [" aspirin "], ["10 mg"], ["  "])], "doc_id long, current_situation array<string>, warning_signs array<string>, follow_up array<string>")
    r = validate.explanation_issues(e, docs, fields=("current_situation", "warning_signs", "follow_up")).first()
    assert (r.valid, r.issues) == (False, ["warning_signs: '10 mg' is not grounded in the source transcript"])


def found(spark, text, least=0.6):
    from skein.functions.constants import MEDICATIONS

    names = spark.createDataFrame([(n, i) for i, n in enumerate(MEDICATIONS)], "name string, ord int")
    c = fuzzy.fuzzy_candidates(spark.createDataFrame([(1, text)], "doc_id long, text string"), names, min_similarity=least)
    return [(r.span, r.name, r.similarity) for r in fuzzy.select_candidates(c).orderBy("start").collect()]


def test_fuzzy_names(spark):
    assert found(spark, "오늘 리시노프닐 드세요") == [("리시노프닐", "리시노프릴", 0.8)]
    assert found(spark, "오늘 아스피린 드세요") == []
    assert found(spark, "오늘 날씨가 좋네요") == []
    assert found(spark, "오늘 리시노프닐 드세요", 0.95) == []
    assert found(spark, "아스피린 을") == []
    assert found(spark, "메트 포르밍 과 와파링") == [("메트포르밍", "메트포르민", 0.8), ("와파링", "와파린", 0.667)]


def test_strip_and_the_last_line(spark, tmp_path):
    from skein.plans.text_queries import explanation_grounding

    texts = ["", " ", "a", " a", "a\n", "\u3000a b\u2028", "a\u00a0", "\u0085\t", "a b", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(T.strip(F.col("t")).alias("s"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("r")).collect()
    assert all(r.s == r.r for r in got) and got[5].s == "a b" and got[9].s is None
    # after a last line feed there is an empty line
    spark.createDataFrame([(3, "one\ntwo\n"), (6, "one\ntwo")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    report = {r.doc_id: r.issues for r in explanation_grounding(spark, str(tmp_path)).collect()}
    assert report == {3: "warning_signs: 'not said:' is not grounded in the source transcript", 6: "warning_signs: 'not said: two' is not grounded in the source transcript"}
