import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from citegrain.operators import jobs, metrics, validate


def test_recall_and_reciprocal_rank(spark):
    pages = spark.createDataFrame([("a", 3, 1), ("a", 5, 2), ("b", 9, 1)], "query_id string, page int, rank int")
    gold = spark.createDataFrame([("a", "en", 5), ("b", "ko", 1), ("c", "en", 2)], "query_id string, language string, page int")
    rows = {r.language: r for r in metrics.retrieval_metrics(metrics.gold_ranks(pages, gold)).collect()}
    assert rows[None].questions == 3 and rows[None].recall_at_1 == 0 and rows[None].recall_at_3 == 1 / 3
    assert rows["en"].mrr == 0.25 and rows["ko"].mrr == 0


def test_paired_groups(spark):
    rec = lambda m, a, answer, **k: {
        "meaning_id": m, "answerability": a, "valid_contract": k.get("valid", True), "final_answer": answer,
        "final_refusal": not answer, "all_required_pages_cited": answer, "fallback_used": False,
        "required_marker_count": 0, "all_required_markers_present": None, "split": "dev",
    }
    rows = [rec("m1", "answerable", True), rec("m1", "answerable", False), rec("m2", "answerable", True),
            rec("m2", "answerable", True), rec("m3", "unsupported", False), rec("m3", "unsupported", True)]
    df = spark.createDataFrame(
        [tuple(r.values()) for r in rows],
        "meaning_id string, answerability string, valid_contract boolean, final_answer boolean, final_refusal boolean, "
        "all_required_pages_cited boolean, fallback_used boolean, required_marker_count int, "
        "all_required_markers_present boolean, split string",
    )
    out = metrics.quality_summary(df).first()
    assert (out.units, out.answerable_retention, out.false_refusal_rate) == (3, 0.5, 0.5)
    assert (out.unsupported_final_refusal_rate, out.unsupported_answer_rate) == (0.0, 1.0)
    assert out.false_premise_final_refusal_rate is None


def test_percentiles_of_one_hot_group(spark):
    rng = random.Random(1)
    data = [("hot", float(rng.randint(0, 50))) for _ in range(500)] + [("one", 4.5), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(data, "k string, v double")
    near = {r.k: r for r in metrics.nearest_rank(df, ["k"], "v").collect()}
    cont = {r.k: r for r in metrics.interpolated(df, ["k"], "v").collect()}
    for key in ("hot", "one", "two"):
        values = sorted(v for k, v in data if k == key)
        assert near[key].p95 == values[max(0, int(np.ceil(0.95 * len(values))) - 1)]
        assert near[key].median == statistics.median(values)
        assert np.isclose(cont[key].p50_seconds, np.quantile(values, 0.5))
        assert np.isclose(cont[key].p95_seconds, np.quantile(values, 0.95))


def brute_thresholds(rows):
    values = sorted({s for *_, s, _ in rows if s is not None})
    cuts = [values[0] - 1e-6] + [(a + b) / 2 for a, b in zip(values, values[1:])] + [values[-1] + 1e-6]
    ok = lambda r, t: not r[3] and (r[2] is None or r[2] >= t)
    groups = {}
    for r in rows:
        groups.setdefault((r[0], r[1]), []).append(r)
    pos = [g for (_, a), g in groups.items() if a == "answerable"]
    neg = [g for (_, a), g in groups.items() if a != "answerable"]
    return {
        round(t, 9): (sum(all(ok(r, t) for r in g) for g in pos) / len(pos),
                      sum(all(not ok(r, t) for r in g) for g in neg) / len(neg))
        for t in cuts
    }


def test_threshold_scan_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"m{i // 2}", ("answerable", "unsupported")[(i // 2) % 2],
             None if rng.random() < 0.1 else round(rng.gauss(0, 2) + ((i // 2) % 2 == 0), 2), rng.random() < 0.1)
            for i in range(60)]
    df = spark.createDataFrame(
        [(m, a, s, 1, x) for m, a, s, x in rows],
        "meaning_id string, answerability string, score double, evidence_count int, missing boolean",
    )
    scan = metrics.threshold_candidates(df)
    got = {round(r.threshold, 9): (r.answerable_group_retention, r.unsupported_group_refusal_recall) for r in scan.collect()}
    expected = brute_thresholds(rows)
    assert got.keys() == expected.keys()
    assert all(np.allclose(got[t], expected[t]) for t in got)
    best = metrics.select_threshold(scan, 0.5).first()
    assert (best.unsupported_group_refusal_recall, round(best.threshold, 9)) == max(
        (v[1], t) for t, v in expected.items() if v[0] >= 0.5
    )
    kept = spark.createDataFrame([(9.0, 1, False)], "score double, evidence_count int, missing boolean")
    assert metrics.threshold_candidates(df, kept).where("additional_retention").count() == len(expected) + 0
    assert metrics.select_threshold(scan, 1.0).count() <= 1


def test_reviews_and_fixed_domains(spark):
    df = spark.createDataFrame(
        [("pass", True, []), ("fail", False, ["false_abstention"])],
        "verdict string, language_match boolean, failure_types array<string>",
    )
    out = metrics.review_summary(df).first()
    assert (out["pass"], out.partial, out.fail, out.strict_pass_rate, out.false_abstentions) == (1, 0, 1, 0.5, 1)
    counts = {r.verdict: r.n for r in metrics.counts_over(df, "verdict", ("pass", "partial", "fail"), "n").collect()}
    assert counts == {"pass": 1, "partial": 0, "fail": 1}


def test_stage_values(spark):
    df = spark.createDataFrame([(1, {"a": {"x_seconds": 1.0, "n": 2.0}})], "i int, stage_timings map<string,map<string,double>>")
    assert [(r.stage, r.seconds) for r in metrics.stage_values(df).collect()] == [("a.x_seconds", 1.0)]


def test_jobs(spark):
    papers = spark.createDataFrame([(p,) for p in "abcde"], "paper_id string")
    state = spark.createDataFrame([("a", "running"), ("b", "failed"), ("c", "completed")], "paper_id string, status string")
    asked = spark.createDataFrame([(p, i) for i, p in enumerate("abcdex")], "paper_id string, at int")
    got = {r.paper_id: (r.outcome, r.scheduled) for r in jobs.enqueue(asked, papers, state, max_pending=3).collect()}
    assert got == {
        "a": ("running", False), "b": ("queued", True), "c": ("completed", False), "d": ("queued", True),
        "e": ("queue_full", False), "x": ("unknown_paper", False),
    }
    assert {r.paper_id: r.status for r in jobs.recover(state).collect()}["a"] == "queued"
    shown = {r.paper_id: r.public_status for r in jobs.papers_with_jobs(papers, state).collect()}
    assert shown == {"a": "processing", "b": "failed", "c": "ready", "d": "uploaded", "e": "uploaded"}


def test_constraints(spark):
    cases = spark.createDataFrame(
        [("1", "m", "p", "dev", "en", "answerable", "What?", [1], ["f"]),
         ("2", "m", "p", "dev", "ko", "answerable", "무엇?", [1], ["f"]),
         ("3", "n", "p", "holdout", "en", "unsupported", "Who?", [], [])],
        "case_id string, meaning_id string, paper_id string, split string, language string, answerability string, "
        "question string, gold_pages array<int>, required_facts array<string>",
    )
    papers = spark.createDataFrame([("p", "dev", 3)], "paper_id string, split string, page_count int")
    found = {(r.rule, r.id) for r in validate.case_rules(cases, papers).collect()}
    assert found == {("split", "3"), ("pair", "n"), ("leak_paper_id", "p")}
    made = spark.createDataFrame([("1",), ("1",), ("9",)], "case_id string")
    assert {(r.rule, r.id) for r in validate.prediction_coverage(cases, made).collect()} == {
        ("missing", "2"), ("missing", "3"), ("extra", "9"), ("duplicate", "1"),
    }
    gaps = validate.category_coverage(cases, "answerability", ("answerable", "unsupported"))
    assert {(r.rule, r.id) for r in gaps.collect()} == {
        ("missing_answerability", "dev|unsupported"), ("missing_answerability", "holdout|answerable"),
    }
    new = cases.withColumn("question", F.when(F.col("case_id") == "1", "New").otherwise(F.col("question"))).where("case_id < '3'")
    assert {(r.case_id, r.change) for r in validate.changed_rows(cases, new, "case_id").collect()} == {
        ("1", "changed"), ("3", "removed"),
    }


def test_fact_aliases(each):
    cases = [("Up to 3 . 5 points", "3.5"), ("Up to 13.5", "3.5"), ("A trade–off", "trade-off"), ("12", "1")]
    assert each(metrics.fact_stated, cases) == [True, False, True, False]


def test_thresholds_are_chosen_on_development_rows_only(spark):
    rows = spark.createDataFrame([("m", "dev"), ("n", "dev")], "meaning_id string, split string")
    assert metrics.calibration_rows(rows).count() == 2
    for split in ("holdout", None):
        more = rows.unionByName(spark.createDataFrame([("x", split)], rows.schema))
        with pytest.raises(ValueError, match="dev rows only"):
            metrics.calibration_rows(more)
