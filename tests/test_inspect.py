"""Final outputs against the contract, one broken rule at a time, and the reports over them."""

import pytest
from pyspark.sql import functions as F

from citegrain.operators import inspect, metrics
from citegrain.operators.policy import ABSTENTION

CASE = (
    "case_id string, meaning_id string, split string, language string, question_type string, answerability string, "
    f"paper_id string, question string, gold_pages array<int>, required_markers {inspect.MARKERS}, "
    "required_facts array<struct<any_of:array<string>>>"
)
OUTPUT = (
    f"case_id string, paper_id string, runtime_paper_id string, question_language string, asked string, payload {inspect.PAYLOAD}, "
    f"evidence {inspect.EVIDENCE}, fallback_used boolean, abstention_source string, wall_seconds double"
)


def case(case_id="c", language="en", kind="answerable", pages=(3, 4), markers=(("m", ["92.5 %", "ninety"]),), meaning="m1"):
    return (case_id, meaning, "dev", language, "fact", kind, "p1", "How good is it?", list(pages), [*markers], [(["92.5"],), (["Good"],)])


def cited(number=1, page=3, text="Good: 92.5 %.", paper="p1", chunk=None, place="p1-p003-c001", shown="p1-p003-c001"):
    return (f"ev-{number:02d}-{shown}", page, text, paper, chunk, (place,))


def output(case_id="c", answer="It is good, 92.5 % of it.", ids=None, sufficiency="sufficient", reason=None, evidence=None, **other):
    shown = [cited()] if evidence is None else evidence
    row = {"paper_id": "p1", "runtime_paper_id": None, "question_language": "en", "asked": "How good is it?"} | other
    payload = (answer, [e[0] for e in shown] if ids is None else ids, sufficiency, reason)
    return (case_id, *[row[k] for k in ("paper_id", "runtime_paper_id", "question_language", "asked")], payload, shown, True, "s", 2.0)


BROKEN = {
    None: [output(), output(answer=ABSTENTION["en"], sufficiency="insufficient", reason="why", evidence=[])],
    "other_paper": [output(paper_id="p2"), output(runtime_paper_id="r1"), output(paper_id=None)],
    "other_question": [output(asked="How bad is it?"), output(question_language="ko"), output(asked=None)],
    "answer_text": [output(answer=" \n"), output(answer=None), output(answer="x" * 4001)],
    "answer_language": [output(answer="좋다")],
    "citation_list": [output(ids=["ev-01-p1-p003-c001", None])],
    "citation_contract": [output(ids=["ev-1-p1"]), output(ids=["ev-01-p1-p003-c001"] * 2)],
    "unresolved_citations": [output(ids=[]), output(ids=["ev-01-p1-p003-c001", "ev-02-p1-p003-c002"]), output(evidence=[cited(), cited()], ids=["ev-01-p1-p003-c001"])],
    "evidence_page": [output(evidence=[cited(page=0)]), output(evidence=[cited(page=None)])],
    "evidence_text": [output(evidence=[cited(text=" ")])],
    "evidence_of_other_paper": [output(evidence=[cited(paper="p2")])],
    "evidence_scope": [output(evidence=[cited(shown="p2-p003-c001", place="p2-p003-c001")])],
    "evidence_locator": [output(evidence=[cited(place="p1-p003-c002")])],
    "evidence_chunk": [output(evidence=[cited(chunk="p1-p003-c002")])],
    "uncited_answer": [output(evidence=[]), output(reason="why")],
    "answer_is_refusal": [output(answer=ABSTENTION["en"].upper())],
    "non_answer": [output(answer="how  GOOD is it?"), output(answer=" String")],
    "refusal_contract": [
        output(answer=ABSTENTION["en"], sufficiency="insufficient", reason="why"),
        output(answer=ABSTENTION["en"], sufficiency="insufficient", reason=" ", evidence=[]),
        output(answer=ABSTENTION["en"], sufficiency="insufficient", reason="x" * 1001, evidence=[]),
    ],
    "other_refusal": [output(answer="I cannot tell.", sufficiency="insufficient", reason="why", evidence=[])],
    "sufficiency": [output(sufficiency="maybe"), output(sufficiency=None)],
}


def test_first_broken_rule(spark):
    rows = [(f"c{k}", error, out) for k, (error, out) in enumerate((e, o) for e, outs in BROKEN.items() for o in outs)]
    cases = spark.createDataFrame([case(c) for c, _, _ in rows] + [case("none")], CASE)
    outputs = spark.createDataFrame([(c, *o[1:]) for c, _, o in rows], OUTPUT).drop("wall_seconds")
    found = {r.case_id: r for r in inspect.inspect_outputs(cases, outputs).collect()}
    assert found.pop("none").error == "missing_output"
    assert {c: found[c].error for c in found} == {c: e for c, e, _ in rows}
    for r in found.values():
        assert r.valid_contract == (r.error is None)
        assert r.fallback_used == (r.error not in ("other_paper", "other_question"))
        assert r.valid_contract or not (r.final_answer or r.final_refusal)
    good, refused = found["c0"], found["c1"]
    assert good.final_answer and good.citation_locator_recall == 0.5 and not good.all_required_pages_cited
    assert good.required_markers_present == ["m"] and good.all_required_markers_present
    assert refused.final_refusal and refused.all_required_markers_present is False and refused.citation_locator_recall == 0


@pytest.mark.parametrize("answer, term, there", [
    ("Accuracy rose to 92.5 %.", "92.5 %", True), ("Accuracy 192.5 %", "92.5", False), ("It is 92.51", "92.5", False),
    ("a state-of-the-art net", "state of the art", True), ("the ＧＰＵ costs", "gpu", True), ("subgraphs", "graph", False),
    ("정확도는 92.5입니다", "92.5", True), ("모델이었습니다", "모델", True), ("the net(v2)", "net(v2)", True), ("BERT를 쓴다", "bert", True),
    ("ends in 3.5", "3", False), ("v.net", "net", False), ("STRASSE", "straße", True),
])
def test_markers(spark, answer, term, there):
    df = spark.createDataFrame([(answer, [("m", ["not there", term])])], f"a string, m {inspect.MARKERS}")
    rows = df.withColumns({"terms": inspect.marker_terms(F.col("m")), "said": inspect.squeeze(inspect.folded(F.col("a")))})
    found = rows.select(inspect.markers_present(F.col("said"), F.col("m"), F.col("terms")).alias("f")).first().f
    assert (found == ["m"]) == there


def test_both_saved_shapes(spark):
    item = "struct<evidence_id:string,page:int,text:string,paper_id:string,chunk_id:string,locator:struct<chunk_id:string>>"
    run = "struct<fallback_used:boolean,abstention_source:string>"
    schema = (
        "case_id string, paper_id string, runtime_paper_id string, question_language string, query string, question string, "
        f"response {inspect.PAYLOAD}, answer string, sufficiency string, abstention_reason string, cited_evidence array<{item}>, "
        f"evidence array<{item}>, pipeline {run}, runtime {run}"
    )
    rows = [
        ("a", "p", None, "en", "q", None, ("x", ["i"], "sufficient", None), None, None, None, [cited()], None, (True, "s"), None),
        ("b", "p", None, "en", None, "q", None, "x", "sufficient", None, None, [cited()], None, (None, "t")),
        ("c", "p", None, "en", None, None, None, None, None, None, None, None, None, None),
    ]
    a, b, c = inspect.final_outputs(spark.createDataFrame(rows, schema)).orderBy("case_id").collect()
    assert (a.payload.evidence_ids, a.asked, a.fallback_used, a.abstention_source) == (["i"], "q", True, "s")
    assert (b.payload.evidence_ids, b.asked, b.fallback_used, b.abstention_source) == (["ev-01-p1-p003-c001"], "q", False, "t")
    assert c.payload is None and c.evidence == []


def test_reports_keep_missing_outputs_in_the_denominators(spark):
    cases = spark.createDataFrame(
        [case("a"), case("b", "ko"), case("u", kind="unsupported", meaning="m2"), case("x", meaning="m3")], CASE
    )
    refusal = output("u", answer=ABSTENTION["en"], sufficiency="insufficient", reason="why", evidence=[])
    korean = output("b", answer="92.5 좋다", question_language="ko")
    outputs = spark.createDataFrame([output("a"), korean, refusal], OUTPUT)
    report = {(r.grain, r.value): r for r in metrics.quality_report(inspect.inspect_outputs(cases, outputs)).collect()}
    assert set(report) == {("overall", "all"), ("split", "dev"), ("language", "en"), ("language", "ko"), ("question_type", "fact")}
    whole = report["overall", "all"]
    assert (whole.units, whole.answerable_units, whole.answerable_retention, whole.invalid_outputs) == (3, 2, 0.5, 1)
    assert whole.unsupported_final_refusal_rate == 1 and report["language", "ko"].units == 1
    facts = {r.case_id: r for r in inspect.fact_records(cases, outputs).collect()}
    assert facts["a"].all_fact_aliases and facts["a"].acceptable_source_page_hit and facts["a"].fact_alias_hits == 2
    assert facts["b"].fact_alias_hits == 1 and not facts["b"].all_fact_aliases
    assert not facts["x"].contract_valid and facts["x"].wall_seconds == 0 and facts["u"].refused
