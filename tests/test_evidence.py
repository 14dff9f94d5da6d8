import itertools
import random

import pytest
from pyspark.sql import functions as F

from citegrain.operators import evidence

SCHEMA = (
    "query_id string, paper_id string, question string, rank int, chunk_id string, page int, "
    "section string, section_index int, chunk_index int, source_page_id string, text string, "
    "reranker_score double, retrieval_score double, pre_rerank_rank int, source_ranks map<string,int>"
)


def candidates(spark, question, rows):
    """rows: (page, chunk_index, text) in rank order."""
    data = [
        ("q", "p", question, i, f"c{i:02d}", page, "S", 1, index, f"p-p{page:03d}", text,
         10.0 - i, 0.1, i, {"bm25": i})
        for i, (page, index, text) in enumerate(rows, 1)
    ]
    return spark.createDataFrame(data, SCHEMA)


def picked(spark, question, rows, **policy):
    row = evidence.select(candidates(spark, question, rows), evidence.EvidencePolicy(**policy)).first()
    return [s.chunk_id for s in row.selected], row


def brute(rows, k, cap, threshold):
    def grams(words):
        return set(words) if len(words) < 3 else {tuple(words[i:i + 3]) for i in range(len(words) - 2)}

    kept, pages, skipped = [], [], dict.fromkeys(("text", "near", "page"), 0)
    for i, (page, _, text) in enumerate(rows, 1):
        words = text.lower().split()
        if len(kept) == k:
            break
        if any(words == w for _, w in kept):
            skipped["text"] += 1
        elif any(len(grams(words) & grams(w)) / max(1, len(grams(words) | grams(w))) >= threshold for _, w in kept):
            skipped["near"] += 1
        elif pages.count(page) >= cap:
            skipped["page"] += 1
        else:
            kept.append((f"c{i:02d}", words))
            pages.append(page)
    return [c for c, _ in kept], skipped


@pytest.mark.parametrize("seed", range(4))
def test_greedy_scan_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = ["alpha beta gamma delta epsilon zeta", "alpha beta gamma delta epsilon eta",
             "one two three four", "red green blue", "sun moon star sky sea"]
    rows = [(rng.randint(1, 3), 0, " ".join([rng.choice(texts)] * rng.randint(1, 2))) for _ in range(14)]
    chosen, row = picked(spark, "Hello there", rows, near_duplicate=0.6)
    expected, skipped = brute(rows, 5, 2, 0.6)
    assert chosen == expected
    assert (row.duplicate_text, row.near_duplicate, row.page_cap) == (
        skipped["text"], skipped["near"], skipped["page"]
    )


def test_questions_with_a_kind_lift_the_page_cap(spark):
    rows = [(1, i, f"word{i} other{i} thing{i}") for i in range(5)]
    assert len(picked(spark, "Hello there", rows)[0]) == 2
    assert len(picked(spark, "List the datasets", rows)[0]) == 5


def test_equal_words_with_other_facts_are_no_duplicate(spark):
    rows = [(1, 0, "the loss is 5 points"), (2, 0, "the loss is 5 points"), (3, 0, "the loss is 5% points")]
    assert picked(spark, "Hello there", rows)[0] == ["c01", "c03"]


def test_cut_off_cause_pulls_its_continuation(spark):
    tail = "the gap appears because the training data of the second stage"
    rows = [
        (1, 1, "A claim. We think " + tail),
        (2, 1, "unrelated words about birds"), (3, 1, "unrelated words about fish"),
        (4, 1, "unrelated words about cats"), (5, 1, "unrelated words about dogs"),
        (1, 2, tail + " was small. More follows."),
    ]
    assert picked(spark, "Hello there", rows)[0][1] == "c02"
    chosen, row = picked(spark, "Why is there a gap?", rows)
    assert chosen[:2] == ["c01", "c06"] and row.continuations == ["c06"]


def test_missing_aspect_reserves_a_slot_behind_the_best(spark):
    rows = [(i, 1, f"plain words number{i} here") for i in range(1, 6)]
    rows.append((9, 1, "we flip images at random"))
    chosen, row = picked(spark, "Do they use a flip?", rows)
    assert chosen == ["c01", "c06", "c02", "c03", "c04"] and row.reserved == ["c06"]


def test_task_definition_joins_as_supplement(spark):
    rows = [(i, 1, f"plain words number{i} here") for i in range(1, 6)]
    rows.append((9, 1, "Intro = x. The pretext task aims to identify pairs."))
    row = evidence.select(candidates(spark, "Which pretext task is used?", rows))
    found = sorted(evidence.evidence(row).collect(), key=lambda r: r.rank)
    assert [r.evidence_id for r in found][-1] == "ev-06-c06"
    assert [r.supplemental for r in found] == [False] * 5 + [True]


def test_counts_follow_the_policy(spark):
    with pytest.raises(ValueError):
        evidence.EvidencePolicy(top_k=0)
    for k, cap in itertools.product((1, 3), (1, 2)):
        rows = [(i % 2, 0, f"w{i} x{i} y{i}") for i in range(8)]
        chosen, _ = picked(spark, "Hello there", rows, top_k=k, max_per_page=cap)
        assert chosen == brute(rows, k, cap, 0.85)[0]


def test_context_windows_respect_sections_and_budget(spark):
    body = ["a" * 30 + " shared tail of the first part", "shared tail of the first part " + "b" * 30, "c" * 30]
    chunks = spark.createDataFrame(
        [("p", f"c{i}", 1, "S", 1, i, t) for i, t in enumerate(body)] + [("p", "d0", 1, "T", 2, 0, "other")],
        "paper_id string, chunk_id string, page int, section string, section_index int, chunk_index int, text string",
    )
    rows = chunks.where("chunk_id = 'c1'").select(
        F.lit("q").alias("query_id"), "paper_id", F.lit("e").alias("evidence_id"), "page", "chunk_id", "text"
    )
    wide = evidence.context_windows(rows, chunks).first()
    assert wide.source_chunk_ids == ["c0", "c1", "c2"]
    assert wide.text == body[0] + " " + "b" * 30 + "\n" + body[2]
    narrow = evidence.context_windows(rows, chunks, max_chars=95).first()
    assert narrow.source_chunk_ids == ["c0", "c1"]
    assert evidence.context_windows(rows, chunks, max_chars=60).first().window_sha256 is None
