import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from citegrain.operators import index, retrieve

WORDS = ["the", "model", "loss", "data", "graph", "node", "bert-base", "speed", "memory", "zebra"]


def tokenize(text):
    out = []
    for word in text.split():
        out.append(word)
        if "-" in word:
            out += word.split("-")
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    rows = []
    for paper, count in (("big", 40), ("small", 3), ("one", 1)):
        for i in range(count):
            text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 14)))
            rows.append((paper, f"{paper}-p{i % 5 + 1:03d}-c{i:03d}", i % 5 + 1, text))
    return rows, spark.createDataFrame(rows, "paper_id string, chunk_id string, page int, text string").cache()


@pytest.fixture(scope="module")
def asks(spark):
    rows = [(q, p, t) for p in ("big", "small", "one")
            for q, t in (("a", "the bert-base model model"), ("b", "zebra"), ("c", "unseen words"))]
    return rows, spark.createDataFrame(rows, "query_id string, paper_id string, question string").cache()


def brute_bm25(rows, question, paper, k):
    docs = {c: tokenize(t) for p, c, _, t in rows if p == paper}
    average = sum(map(len, docs.values())) / len(docs)
    df = Counter(w for words in docs.values() for w in set(words))
    idf = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    scores = {}
    for chunk, words in docs.items():
        counts = Counter(words)
        scores[chunk] = sum(
            idf.get(w, 0) * counts[w] * 2.5 / (counts[w] + 1.5 * (0.25 + 0.75 * len(words) / average))
            for w in tokenize(question)
        )
    return sorted(scores.items(), key=lambda s: (-round(s[1], 9), s[0]))[:k]


def test_bm25_equals_brute_force_and_ranks_unmatched_chunks(corpus, asks):
    rows, chunks = corpus
    ask_rows, ask_df = asks
    found = retrieve.bm25_top_k(index.build_index(chunks), chunks, ask_df, 10).collect()
    for query, paper, question in ask_rows:
        mine = sorted((r.rank, r.chunk_id, r.score) for r in found
                      if (r.query_id, r.paper_id) == (query, paper))
        theirs = brute_bm25(rows, question, paper, 10)
        assert [c for _, c, _ in mine] == [c for c, _ in theirs]
        assert np.allclose([s for *_, s in mine], [s for _, s in theirs])


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    make = lambda n, prefix: [
        (p, f"{prefix}{i:03d}", i % 7, rng.integers(-3, 4, 8).astype(float).tolist())
        for p in ("x", "y") for i in range(n)
    ]
    chunks, asked = make(50, "c"), make(9, "q")
    schema = "paper_id string, {} string, page int, vector array<float>"
    return chunks, asked, spark.createDataFrame(chunks, schema.format("chunk_id")), \
        spark.createDataFrame(asked, schema.format("query_id"))


def brute_dense(chunks, vector, paper):
    return sorted(
        ((c, page, float(np.dot(v, vector))) for p, c, page, v in chunks if p == paper),
        key=lambda s: (-round(s[2], 9), s[0]),
    )


@pytest.mark.parametrize("blocks", [(4096, 1024), (8, 3)])
def test_dense_blocks_equal_brute_force(vectors, blocks):
    chunks, asked, chunk_df, ask_df = vectors
    found = retrieve.dense_top_k(chunk_df, ask_df, 5, *blocks).collect()
    pages = retrieve.dense_pages(chunk_df, ask_df, None, *blocks).collect()
    for paper, query, _, vector in asked:
        scored = brute_dense(chunks, vector, paper)
        own = [r for r in found if (r.query_id, r.paper_id) == (query, paper)]
        assert [r.chunk_id for r in sorted(own, key=lambda r: r.rank)] == [c for c, *_ in scored[:5]]
        best = {}
        for c, page, s in scored:
            best.setdefault(page, (s, c))
        order = sorted(best, key=lambda p: (-best[p][0], p))
        mine = [r for r in pages if (r.query_id, r.paper_id) == (query, paper)]
        mine.sort(key=lambda r: r.rank)
        assert [(r.page, r.chunk_id) for r in mine] == [(p, best[p][1]) for p in order]


def ranking(spark, rows):
    return spark.createDataFrame(
        [("q", "p", c, page, r, 1.0 / r) for r, (c, page) in enumerate(rows, 1)],
        "query_id string, paper_id string, chunk_id string, page int, rank int, score double",
    )


def test_fusion_adds_reciprocal_ranks(spark):
    a = ranking(spark, [("c1", 1), ("c2", 1), ("c3", 2)])
    b = ranking(spark, [("c3", 2), ("c4", 3)])
    rows = {r.chunk_id: r for r in retrieve.fuse({"bm25": a, "dense": b}).collect()}
    assert rows["c3"].rank == 1 and math.isclose(rows["c3"].score, 1 / 63 + 1 / 61)
    assert rows["c3"].source_ranks == {"bm25": 3, "dense": 1}
    swapped = {r.chunk_id: r.rank for r in retrieve.fuse({"dense": b, "bm25": a}).collect()}
    assert swapped == {c: r.rank for c, r in rows.items()}
    assert retrieve.rerank_pool({"bm25": a, "dense": b}, 2).count() == 2
    with pytest.raises(ValueError):
        retrieve.fuse({"bm25": a}, weights={"bm25": 0})


def test_front_page_takes_the_last_slot(spark):
    pool = ranking(spark, [(f"c{i}", 2 if i < 5 else 1) for i in range(1, 8)])
    rows = sorted(retrieve.ensure_page(pool, 1, 3).collect(), key=lambda r: r.rank)
    assert [(r.chunk_id, r.injected) for r in rows] == [("c1", False), ("c2", False), ("c5", True)]
    present = retrieve.ensure_page(pool, 2, 3).collect()
    assert [r.injected for r in present] == [False] * 3
    assert retrieve.ensure_page(pool, 9, 3).count() == 3


def test_rerank_and_pages(spark):
    rows = ranking(spark, [("c1", 1), ("c2", 1), ("c3", 2)]).withColumns(
        {"question": F.lit("graph node"),
         "text": F.when(F.col("chunk_id") == "c3", "graph node").otherwise("other")}
    )
    ranked = sorted(retrieve.rerank(rows).collect(), key=lambda r: r.rank)
    assert [r.chunk_id for r in ranked] == ["c3", "c1", "c2"]
    assert ranked[0].pre_rerank_rank == 3
    pages = retrieve.unique_candidate_pages(rows, 1).collect()
    assert [(r.page, r.page_rank) for r in pages] == [(1, 1)]
    best = sorted(retrieve.rank_pages(rows.select("query_id", "paper_id", "chunk_id", "page", "score")).collect(),
                  key=lambda r: r.rank)
    assert [(r.page, r.chunk_id) for r in best] == [(1, "c1"), (2, "c3")]


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = [("p", f"c{i}", f"text {i}") for i in range(30)]
    make = lambda data: index.fingerprint(
        spark.createDataFrame(data, "paper_id string, chunk_id string, text string")
    ).first().fingerprint
    assert make(rows) == make(rows[::-1])
    assert make(rows) != make(rows[:-1] + [("p", "c29", "text x")])


def test_only_changed_chunks_are_encoded_again(spark):
    chunks = spark.createDataFrame(
        [("p", "c1", 1, "graph"), ("p", "c2", 1, "node")],
        "paper_id string, chunk_id string, page int, text string",
    )
    empty = spark.createDataFrame([], "model string, chunk_id string, text_sha string")
    cache = index.missing_vectors(chunks, empty, "m@1").cache()
    assert cache.count() == 2
    changed = chunks.withColumn("text", F.concat("text", F.when(F.col("chunk_id") == "c2", "s").otherwise("")))
    assert [r.chunk_id for r in index.missing_vectors(changed, cache, "m@1").collect()] == ["c2"]
    assert index.missing_vectors(chunks, cache, "m@2").count() == 2


def test_questions_about_unknown_papers_are_refused_on_request(spark):
    from citegrain.plans import search

    chunks = spark.createDataFrame(
        [("p", "p-1", 1, "s", "S", 1, 1, "graph models")],
        "paper_id string, chunk_id string, page int, source_page_id string, section string, "
        "section_index int, chunk_index int, text string",
    )
    asks = spark.createDataFrame([("q", "nowhere", "graph?")], "query_id string, paper_id string, question string")
    with pytest.raises(ValueError, match="nowhere"):
        search.search(asks, chunks, known_only=True)


def test_vectors_are_found_by_their_text(spark):
    rows = [("p", f"c{k}", t) for k, t in enumerate(["one text", "two texts", "one text", "three"])]
    chunks = spark.createDataFrame(rows, "paper_id string, chunk_id string, text string")
    first = index.build_vectors(chunks, None, "m@1")
    assert {r.provenance for r in first.vectors.collect()} == {"encoded"} and first.additions.count() == 3
    later = spark.createDataFrame(
        [("q", "new name", "one text"), ("p", "c1", "two texts, changed"), ("p", "c3", "three")], chunks.schema
    )
    store = first.additions.unionByName(first.additions)
    second = index.build_vectors(later, store, "m@1")
    found = {r.chunk_id: r for r in second.vectors.collect()}
    assert {k: r.provenance for k, r in found.items()} == {"new name": "stored", "c1": "encoded", "c3": "stored"}
    assert second.additions.count() == 1
    fresh = {r.chunk_id: r.vector for r in index.encode_passages(later).collect()}
    assert {k: r.vector for k, r in found.items()} == fresh
    assert index.build_vectors(later, store, "m@2").additions.count() == 3


@pytest.mark.parametrize("k, block", [(1, 3), (3, 5), (7, 1000)])
def test_first_pages_lose_none_to_their_blocks(spark, k, block):
    chance = np.random.default_rng(k)
    vectors = chance.integers(-2, 3, size=(120, 4)).astype(float)
    rows = [("p", f"c{i:03d}", int(chance.integers(0, 30)), v.tolist()) for i, v in enumerate(vectors)]
    stored = spark.createDataFrame(rows, "paper_id string, chunk_id string, page int, vector array<double>")
    asked = spark.createDataFrame([(q, "p", v.tolist()) for q, v in enumerate(vectors[:20])], "query_id int, paper_id string, vector array<double>")
    key = lambda r: (r.query_id, r.rank, r.page, r.chunk_id, r.score)
    whole = sorted(key(r) for r in retrieve.dense_pages(stored, asked).where(f"rank <= {k}").collect())
    assert sorted(key(r) for r in retrieve.dense_pages(stored, asked, k, block, 7).collect()) == whole


def test_overlapping_vectors_leave_out_what_shares_no_component(spark):
    rows = [("p", "a", [1.0, 0.0, 0.0]), ("p", "b", [0.0, 1.0, 0.0]), ("p", "c", [1.0, -1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "paper_id string, chunk_id string, vector array<double>")
    asked = spark.createDataFrame(
        [("q", "p", [1.0, 1.0, 0.0]), ("r", "p", [1.0, 0.0, 0.0]), ("none", "p", [0.0, 0.0, 1.0])],
        "query_id string, paper_id string, vector array<double>",
    )
    found = lambda **how: sorted(
        (r.query_id, r["rank"], r.chunk_id) for r in retrieve.dense_top_k(vectors, asked, 3, **how).collect()
    )
    # c meets q in two components that cancel out: found, with score 0
    assert found(overlapping=True) == [
        ("q", 1, "a"), ("q", 2, "b"), ("q", 3, "c"), ("r", 1, "a"), ("r", 2, "c"),
    ]
    assert len(found()) == 9


def test_terms_are_counted_in_one_pass_without_a_row_for_each_posting(corpus):
    rows, chunks = corpus
    made = index.build_index(chunks)
    counted = index.vocabulary(chunks)
    plan = counted._jdf.queryExecution().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") > 0
    want = Counter((p, w) for p, _, _, t in rows for w in {*tokenize(t), None})
    assert {(r.paper_id, r.term): r.df for r in counted.collect()} == want
    assert {r.paper_id: r.chunks for r in made.papers.collect()} == {"big": 40, "small": 3, "one": 1}


def test_rows_are_sent_to_a_bounded_number_of_blocks(spark):
    count = 300
    rows = spark.range(count).select(
        F.col("id").alias("chunk_id"), F.lit("p").alias("paper_id"), (F.col("id") % 40).cast("int").alias("page"),
        F.array(*[F.sin(F.col("id") * (n + 1)) for n in range(4)]).alias("vector"),
    )
    asked = rows.select(F.col("chunk_id").alias("query_id"), "paper_id", "vector")
    pairs = retrieve._blocks(rows, asked, ["chunk_id", "vector"], 2, 2, widest=400)
    sent = lambda own, other: pd.DataFrame({"n": [len(own)], "m": [len(other)]})
    total = pairs.applyInPandas(sent, "n long, m long").agg(F.sum("n"), F.sum("m")).first()
    assert tuple(total) == (count * retrieve.BLOCKS, count * retrieve.BLOCKS)
    vectors = np.array([r.vector for r in rows.orderBy("chunk_id").collect()])
    scores = np.round(vectors @ vectors.T, 9)
    for found in (retrieve.dense_pages(rows, asked, 7, 2, 2), retrieve.dense_pages(rows, asked, 7)):
        got = {(r.query_id, r["rank"]): (r.page, r.chunk_id) for r in found.collect()}
        for q in (0, 13, 299):
            best = {}
            for c in sorted(range(count), key=lambda c: (-scores[q, c], c)):
                best.setdefault(c % 40, (-scores[q, c], c % 40, c))
            assert [got[q, n + 1] for n in range(7)] == [(p, c) for _, p, c in sorted(best.values())[:7]]
