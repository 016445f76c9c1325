"""Edge cases of expectations, typed decoding, retried appends, merged schemas and role maps."""

import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import expectations, store, validate
from skein.sources import decode, tables

KEYS = ["segment_id"]
FINDINGS = "segment_id string, category string, action string, polarity string, scores array<string>, computable boolean"


def passed(spark, findings, *rules):
    rows = [("s1", *r) for r in rules]
    out = expectations.evaluate(spark.createDataFrame(rows, f"segment_id string, {expectations.SCHEMA}"), spark.createDataFrame(findings, FINDINGS), KEYS)
    return {r.check_id: r.passed for r in out.collect()}


def test_operations_and_quantifiers(spark):
    findings = [("s1", "medication", "stop", "affirmed", None, None), ("s1", "exam", None, None, ["1점"], True), ("s1", "symptom", None, "question", [], None), ("s2", "diagnosis", None, None, None, None)]
    rule = lambda check, category, field, op, values, quantifier, alternative=0: (check, "k", alternative, category, field, op, values, quantifier)
    got = passed(
        spark, findings,
        rule("stop", "medication", "action", "equals", ["stop"], "any"), rule("no start", "medication", "action", "equals", ["start"], "none"), rule("start", "medication", "action", "equals", ["start"], "any"),
        rule("all questions", "symptom", "polarity", "equals", ["question"], "all"), rule("nothing cited", "plan", None, "cited", [], "all"), rule("no diagnosis", "diagnosis", None, "cited", [], "none"),
        rule("score", "exam", "scores", "contains", ["점"], "any"), rule("filled", None, "scores", "filled", [], "any"), rule("all filled", None, "scores", "filled", [], "all"), rule("true", "exam", "computable", "true", [], "any"),
        rule("either", "medication", "action", "equals", ["start"], "any"), rule("either", "exam", "computable", "true", [], "any", 1),
        rule("both", "medication", "action", "equals", ["stop"], "any"), rule("both", "exam", "computable", "true", [], "none"),
    )
    assert got == {"stop": True, "no start": True, "start": False, "all questions": True, "nothing cited": True, "no diagnosis": True, "score": True, "filled": True, "all filled": False, "true": True, "either": True, "both": False}


@pytest.mark.parametrize("rule,what", [(("c", "k", 0, None, "nothing", "equals", ["x"], "any"), "field"), (("c", "k", 0, None, "action", "like", ["x"], "any"), "op"), (("c", "k", 0, None, "action", "equals", ["x"], "most"), "quantifier")])
def test_unknown_words_are_errors(spark, rule, what):
    with pytest.raises(Exception, match=f"unknown {what}"):
        passed(spark, [("s1", "medication", "stop", None, None, None)], rule)


def test_expectations_of_empty_tables(spark):
    none = spark.createDataFrame([], FINDINGS)
    assert passed(spark, [], ("c", "k", 0, None, None, "cited", [], "any"), ("d", "k", 0, None, None, "cited", [], "none")) == {"c": False, "d": True}
    assert expectations.evaluate(spark.createDataFrame([], f"segment_id string, {expectations.SCHEMA}"), none, KEYS).count() == 0
    checks = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "kind string, passed boolean")
    assert {(r.kind, r.n_checks, r.n_passed) for r in expectations.counts(checks).collect()} == {("a", 2, 1), ("b", 1, 1)}


def test_decoding(spark):
    fields = (decode.Field("id", "bigint", required=True), decode.Field("status", "string", values=("DRAFT",)), decode.Field("ok", "boolean", flag=True), decode.Field("x", "double"), decode.Field("o", "struct<a:int,b:array<string>>"))
    rows = [
        (1, '{"id": 7, "status": "DRAFT", "ok": 1, "x": 2, "o": {"a": 1, "b": ["q"]}, "more": [1]}'), (2, '{"id": 8, "status": null}'), (3, None), (4, ""), (5, "{"), (6, "3"), (7, '{"id": "8"}'), (8, '{"id": 1.5, "ok": true, "x": "1"}'),
        (9, '{"id": 1, "o": {"a": "z"}}'), (10, '{"id": 2, "status": "draft", "ok": 2}'), (11, '{"id": 3, "o": [1]}'),
    ]
    df = spark.createDataFrame([(k, t, "kept", "old") for k, t in rows], "k int, json string, other string, status string")
    good, bad = decode.decode(df, "json", fields)
    assert good.columns == ["k", "other", "id", "status", "ok", "x", "o"]
    assert [(r.k, r.id, r.status, r.ok, r.x, r.o and r.o.asDict()) for r in good.orderBy("k").collect()] == [(1, 7, "DRAFT", True, 2.0, {"a": 1, "b": ["q"]}), (2, 8, None, None, None, None)]
    assert {r.k: r.reasons for r in bad.collect()} == {
        3: ["not JSON"], 4: ["not JSON"], 5: ["not JSON"], 6: ["not an object"], 7: ["id: not a bigint"], 8: ["id: not a bigint", "ok: not a flag", "x: not a double"],
        9: ["o: not a struct<a:int,b:array<string>>"], 10: ["status: unknown value draft", "ok: not a flag"], 11: ["o: not a struct<a:int,b:array<string>>"],
    }
    assert bad.columns == [*df.columns, "reasons"] and decode.decode(df.limit(0), "json", fields)[0].count() == 0


def test_a_batch_written_twice_leaves_one_copy(spark, tmp_path):
    df, path = spark.createDataFrame([(1, "a"), (2, "b")], "id int, batch string"), str(tmp_path / "log")
    store.append_batch(df, path, "one")
    store.append_batch(df, path, "two")
    store.append_batch(df.where("id = 1"), path, "two")
    store.append_batch(df.where("false"), path, "one")
    assert sorted((r.id, r.batch) for r in spark.read.parquet(path).collect()) == [(1, "one"), (1, "two"), (2, "one")]


def test_files_of_two_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "x")], "id int, name string").write.parquet(path)
    spark.createDataFrame([("y", 2.5, 2)], "name string, added double, id int").write.mode("append").parquet(path)
    assert sorted((r.id, r.name, r.added) for r in tables.read_versions(spark, path).collect()) == [(1, "x", None), (2, "y", 2.5)]


def test_role_maps(spark):
    runs = spark.createDataFrame([(1, 10, None, "t0"), (2, 20, {"A": "doctor"}, "t0")], "run_id int, encounter_id int, roles map<string,string>, updated_at string")
    segments = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A")], "run_id int, speaker string")
    asked = [(1, {"A": "doctor"}, "t1"), (1, {"B": "patient"}, "t2"), (1, {"A": "x", "C": "y"}, "t3"), (2, {}, "t1"), (2, None, "t1"), (9, {"A": "doctor"}, "t1")]
    after, audit, refused = store.set_roles(runs, segments, spark.createDataFrame(asked, "run_id int, roles map<string,string>, created_at string"))
    assert {(r.run_id, tuple(r.roles.items()), r.updated_at) for r in after.collect()} == {(1, (("B", "patient"),), "t2"), (2, (("A", "doctor"),), "t0")}
    assert sorted((r.encounter_id, r.created_at, r.event_type) for r in audit.collect()) == [(10, "t1", "SPEAKER_ROLES_CONFIRMED"), (10, "t2", "SPEAKER_ROLES_CONFIRMED")]
    assert sorted((r.run_id, r.created_at) for r in refused.collect()) == [(1, "t3"), (2, "t1"), (2, "t1"), (9, "t1")]


def test_questions_of_demoted_diagnoses(spark):
    kinds = "conv_id int, category string, finding_id string, raw_text string, ord int, action string, score_computable boolean, dose_candidates array<string>, score_candidates array<string>, value_candidates array<string>, needs_review boolean"
    found = spark.createDataFrame([(1, "diagnosis", "d1", "감기", 0, None, None, None, None, None, False), (1, "diagnosis", "d2", "flu", 1, None, None, None, None, None, False)], kinds)
    spans = spark.createDataFrame([(1, "diagnosis", "d1", 0, "s1", "cold", "patient"), (1, "diagnosis", "d2", 0, "s1", "flu", "doctor")], "conv_id int, category string, finding_id string, span_ord int, segment_id string, quote string, role string")
    segs = spark.createDataFrame([(1, "s1", "cold or flu")], "conv_id int, segment_id string, text string")
    valid, _ = validate.validate_findings(found, spans, segs)
    (r,) = validate.demoted_questions(found, valid).collect()
    assert (r.finding_id, r.trigger_text, r.needs_review) == ("demoted-d1", "감기", True) and r.suggested_question.endswith(": 감기") and r.rationale


@pytest.mark.parametrize("text,want", [("오 밀리그램 드세요", "5 밀리그램 드세요"), ("백사십오 mmHg 입니다", "145 mmHg 입니다"), ("일이 알", "일이 알"), ("오진 회", "오진 회"), ("하루 삼 회", "하루 3 회"), ("십 정", "10 정"), ("백", "백"), ("만 리터", "10000 리터"), ("이만삼천 번", "23000 번"), ("구십이  회", "구십이  회")])
def test_numerals(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(T.normalize_numerals(F.col("x")).alias("y")).first().y == want


def test_json_is_parsed_once(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": "x"}'), (3, "{"), (4, None)], "id long, json string")
    for side in decode.decode(df, "json", [decode.Field("a", "bigint", required=True)]):
        plan = side._jdf.queryExecution().optimizedPlan().toString().lower()
        assert plan.count("parse_json") + plan.count("parsejson") == 1
