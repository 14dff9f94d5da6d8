"""Run comparison, gates and set-equality checks on small tables."""

import pytest

from citegrain.operators import compare, validate

RANKED = "query_id long, paper_id string, chunk_id string, rank int"
ANSWER = (
    "query_id long, paper_id string, payload struct<answer:string,evidence_ids:array<string>,sufficiency:string,"
    "abstention_reason:string>, fallback_used boolean"
)


def ranked(spark, lists):
    return spark.createDataFrame([(q, "p", c, k + 1) for q, cs in lists.items() for k, c in enumerate(cs)], RANKED)


def test_ranked_changes(spark):
    before, after = ranked(spark, {1: "abcdef", 2: "xy", 3: "k"}), ranked(spark, {1: "bacfgd", 2: "xy", 4: "n"})
    rows = compare.ranked_changes(before, after)
    found = {(r.query_id, r.chunk_id): (r.change, r.old_rank, r.new_rank) for r in rows.collect()}
    assert found == {
        (1, "a"): ("moved", 1, 2), (1, "b"): ("moved", 2, 1), (1, "c"): ("kept", 3, 3), (1, "d"): ("lost", 4, None),
        (1, "e"): ("lost", 5, None), (1, "f"): ("gained", None, 4), (1, "g"): ("gained", None, 5), (2, "x"): ("kept", 1, 1),
        (2, "y"): ("kept", 2, 2), (3, "k"): ("lost", 1, None), (4, "n"): ("gained", None, 1),
    }
    told = compare.run_comparison(rows).first()
    assert (told.questions, told.changed, told.lost, told.gained, told.moved, told.kept, told.same_first) == (4, 3, 3, 3, 2, 3, 1)
    assert told.mean_overlap == pytest.approx((3 / 7 + 1 + 0 + 0) / 4)


def test_gates(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 6), (3, None), (4, 2)], "query_id long, gold_rank int")
    contracts = spark.createDataFrame([(True,), (False,)], "complete boolean")
    gates = {"questions": 4, "recall_at_5": 0.5, "recall_at_10": 0.8, "mrr": 0.4, "lost_top5": 1}
    found = {r.gate: (r.value, r.passed) for r in compare.retrieval_gates(ranks, contracts, gates).collect()}
    assert found == {
        "questions": (4, True), "recall_at_5": (0.5, True), "recall_at_10": (0.75, False),
        "mrr": (pytest.approx((1 + 1 / 6 + 0.5) / 4), True), "lost_top5": (2, False), "contract": (0.5, False),
    }
    none = {r.gate: r.passed for r in compare.retrieval_gates(ranks.limit(0), contracts.limit(0), gates).collect()}
    assert none == {"questions": False, "recall_at_5": False, "recall_at_10": False, "mrr": False, "lost_top5": True, "contract": False}
    with pytest.raises(ValueError, match="recall_at_3"):
        compare.retrieval_gates(ranks, contracts, {"recall_at_3": 1})


def test_smoke_run(spark):
    asks = spark.createDataFrame([(1, "p", "en"), (2, "p", "ko"), (3, "p", "en")], "query_id long, paper_id string, language string")
    many = ranked(spark, {1: [f"c{k}" for k in range(20)], 2: [f"c{k}" for k in range(19)]})
    evidence = ranked(spark, {1: "abcde", 2: "abcde"})
    rows = {r.language: r for r in compare.smoke_summary(compare.contracts(many, evidence, asks)).collect()}
    assert (rows[None].questions, rows[None].passed, rows[None].least_candidates) == (3, 1, 0)
    assert (rows["en"].passed, rows["en"].failed, rows["ko"].passed, rows["ko"].least_candidates) == (1, 1, 0, 19)


def test_answer_changes(spark):
    yes, no = lambda t, *ids: (t, list(ids), "sufficient", None), lambda r: ("none", [], "insufficient", r)
    before = [yes("a", "i"), yes("a", "i"), no("r"), no("r"), yes("a", "i"), yes("a", "i"), yes("a", "i")]
    after = [yes("a", "i"), no("r"), yes("a", "i"), no("s"), yes("b", "i"), yes("a", "j"), None, yes("n", "i")]
    table = lambda ps: spark.createDataFrame([(k, "p", p, k == 0) for k, p in enumerate(ps) if p], ANSWER)
    found = {r.query_id: r.change for r in compare.answer_changes(table(before), table(after)).collect()}
    assert found == {
        0: "same", 1: "now_refused", 2: "now_answered", 3: "other_reason", 4: "other_text", 5: "other_citations", 6: "missing", 7: "added",
    }


def test_incomplete_keys(spark):
    side = lambda *ks: spark.createDataFrame([(k,) for k in ks], "case_id string")
    rows = validate.incomplete_keys({"manifest": side("a", "b", "c", None), "gold": side("a", "b", "b"), "labels": side("a", "b", "z")}, "case_id")
    found = {r.case_id: (r.missing, r.repeated) for r in rows.collect()}
    assert found == {
        "b": ([], ["gold"]), "c": (["gold", "labels"], []), "z": (["manifest", "gold"], []), None: (["gold", "labels"], []),
    }


def test_map_violations(spark):
    pairs = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2"), ("d", "4"), ("d", "5"), ("e", " "), ("x", "9")], "paper string, run string")
    papers = spark.createDataFrame([(p,) for p in "abcdefa"], "paper string")
    found = {(r.rule, r.id) for r in validate.map_violations(pairs, "paper", "run", papers).collect()}
    assert found == {
        ("several_targets", "d"), ("shared_target", "2"), ("no_target", "e"), ("missing", "f"), ("extra", "x"),
    }
    good = pairs.where("paper in ('a', 'b')")
    assert validate.map_violations(good, "paper", "run", good).count() == 0


def test_same_when_folded(spark):
    rows = [(1, "dev", "Die  Straße"), (2, "dev", "die STRASSE "), (3, "holdout", "ＡＢＣ"), (4, "dev", "abc"), (5, "dev", "other")]
    df = spark.createDataFrame(rows, "case_id long, split string, question string")
    found = {(r.rule, r.id) for r in validate.same_when_folded(df, "question", "case_id").collect()}
    assert found == {("duplicate_text", "1"), ("duplicate_text", "3"), ("leak_text", "3")}


def test_alignment_violations(spark):
    outputs = spark.createDataFrame(
        [("good", "en", "sufficient", "One. Two."), ("order", "en", "sufficient", "Two. One."), ("no", "ko", "insufficient", "x"),
         ("none", "en", "insufficient", "x"), ("bad", "en", "sufficient", "One.")],
        "case_id string, language string, sufficiency string, answer string",
    )
    row = lambda case, at, text, sentence="s1", said=None, page=1, section="A", language="en", evidence="e1": (
        case, at, sentence, evidence, text, said or text, page, section, language)
    aligned = spark.createDataFrame(
        [row("good", 2, "Two.", "s2"), row("good", 1, "One."), row("order", 1, "One."), row("order", 2, "Two.", "s2"),
         row("no", 1, "x", language="ko"), row("bad", 1, "Changed.", said="One.", page=2, section=None, language=None)],
        "case_id string, position int, sentence_id string, evidence_id string, source_text string, answer_text string, page int, "
        "section string, answer_language string",
    )
    sources = spark.createDataFrame(
        [(c, s, "e1", t, 1, "A") for c in ("good", "order", "bad") for s, t in (("s1", "One."), ("s2", "Two."))],
        "case_id string, sentence_id string, evidence_id string, text string, page int, section string",
    )
    cited = spark.createDataFrame([(c, "e1", 1, "A") for c in ("good", "order", "bad")], "case_id string, evidence_id string, page int, section string")
    found = {(r.rule, r.id) for r in validate.alignment_violations(outputs, aligned, sources, cited).collect()}
    assert found == {
        ("rebuilt_answer", "order"), ("aligned_refusal", "no"), ("unknown_sentence", "no"), ("unresolved_evidence", "no"),
        ("changed_source", "bad"), ("changed_page", "bad"), ("changed_section", "bad"), ("changed_language", "bad"),
    }


def test_metric_differences(spark):
    schema = "split string, units long, rate double"
    published = spark.createDataFrame([("dev", 3, 0.5), (None, 9, None), ("old", 1, 1.0)], schema)
    again = spark.createDataFrame([("dev", 3, 0.50000001), (None, 8, None), ("new", 2, 0.0)], schema)
    found = {(r.split, r.metric): (r.published, r.recomputed) for r in validate.metric_differences(published, again, ["split"]).collect()}
    assert found == {
        (None, "units"): (9, 8), ("old", "units"): (1, None), ("old", "rate"): (1, None), ("new", "units"): (None, 2), ("new", "rate"): (None, 0),
    }
