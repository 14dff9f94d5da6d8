"""Quality rules and the weak-label classifier."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citegrain.llm import hashed, quality_rules, weak_labels
from citegrain.llm.common import word_hashes

SF = "/root/testdata/sf0.1"


def slow_metrics(text):
    words = quality_rules.WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if quality_rules.WORD.search(line):
            repeats += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeats, len(inside))


@pytest.mark.parametrize("text", [
    "", "\n\n", "a b c a b c", "a a a a", "x\ny\nx\n \n \nx", "#* $%&|<>\x1c\x85 é", "a b\x0bc\x0ca b c", "one two",
])
def test_base_metrics(text):
    assert quality_rules.base_metrics(text) == slow_metrics(text)


def test_word_hashes_do_not_depend_on_place():
    words = ("ab", "é", "ab", "abc", "x" * 5000, "ab")
    _, _, found = word_hashes("  ".join(words).encode())
    assert len(set(found.tolist())) == 4 and found[0] == found[2] == found[5]
    data = (" ".join(["alpha", "beta"] * 200_000)).encode()
    assert len(set(word_hashes(data)[2].tolist())) == 2


def test_scores_are_sums_of_sparse_rows():
    texts = [b"one two three", b"", b"x " * 50, b"A b!! A b!!"]
    scorer = hashed.Scorer(np.random.default_rng(1).normal(size=hashed.SIZE).astype(np.float32), 0.3)
    rows = hashed.sparse_rows(texts)
    slow = [0.3 + float((scorer.weights[i] * v).sum()) for i, v in rows]
    assert np.allclose(scorer.raw(texts), slow)


def test_platt_brings_back_the_rate():
    chance = np.random.default_rng(2)
    z = chance.normal(size=4000)
    y = (chance.random(4000) < hashed.sigmoid(2 * z - 1)).astype(float)
    slope, shift = hashed.platt(z, y)
    assert abs(slope - 2) < 0.3 and abs(shift + 1) < 0.2


def test_samples_are_the_smallest_hashes(spark):
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    found = [r.h for r in hashed.smallest(rows, "h", 20_000, 500).collect()]
    everything = sorted(r.h for r in rows.collect())
    assert 400 < len(found) <= 500 and found == everything[: len(found)]
    assert hashed.smallest(rows.limit(10), "h", 10, 500).count() == 10
    assert hashed.smallest(rows.limit(0), "h", 0, 500).count() == 0


def test_em_finds_the_bad_labeller():
    chance = np.random.default_rng(3)
    truth = chance.random(20_000) < 0.8
    votes = np.stack(
        [np.where(chance.random(20_000) < p, truth, ~truth) * 2 - 1 for p in (0.95, 0.9, 0.9, 0.6)], axis=1
    )
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_labels.estimate(patterns, counts)
    assert model.accuracy.argmin() == 3 and abs(model.prior - 0.8) < 0.05
    judged = model.posterior(votes) > 0.5
    assert (judged == truth).mean() > 0.95


needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@needs_tables
def test_held_out_accuracy(spark):
    documents, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    labels = labels.where("doc_id % 3 <> 0")
    held = spark.read.parquet(f"{SF}/labels.parquet").where("doc_id % 3 = 0")
    rules = quality_rules.quality_rules(documents, labels).join(held, "doc_id").where("not base_failed")
    told = rules.select("kept", "quality", "p_quality").toPandas()
    assert ((told.kept) == (told.quality == 1)).mean() > 0.98
    assert abs(told.p_quality.mean() - told.quality.mean()) < 0.05
    weak = weak_labels.quality_classifier(documents.select("doc_id", "text")).join(held, "doc_id").toPandas()
    assert (weak.kept == (weak.quality == 1)).mean() > 0.97
    assert weak.kept[weak.quality == 1].mean() > 0.99


def rows(spark):
    chance = random.Random(5)
    names = [a + b for a in ("gar", "hou", "riv", "mou", "cit") for b in ("den", "se", "er", "tain", "y", "let", "ing")]
    small = ("the", "of", "and", "in", "a", "is", "on", "with")
    made = [(k, " ".join(chance.choice(names if j % 2 else small) for j in range(90))) for k in range(60)]
    made += [(100 + k, " ".join(f"w{k}{j}***" for j in range(60))) for k in range(20)]
    made += [(500, None), (None, "tiny"), (501, ""), (502, " \n\t "), (3, made[3][1]), (503, "é" * 100_000)]
    return spark.createDataFrame(made, "doc_id long, text string").selectExpr("*", "'s' as kept", "1 as score")


def test_edges_of_both(spark):
    documents = rows(spark)
    labels = spark.createDataFrame(
        [(k, 1, 0) for k in range(60)] + [(100 + k, 0, 0) for k in range(20)] + [(None, 1, 0), (7, None, None), (9999, 0, 0)],
        "doc_id long, quality int, toxic int",
    )
    told = {r.doc_id: r for r in quality_rules.quality_rules(documents, labels).collect()}
    assert told[500].n_words == 0 and told[500].base_failed and not told[500].kept
    assert not told[101].kept and told[503].n_words == 1
    assert quality_rules.quality_rules(documents, labels).count() == documents.count()
    none = quality_rules.quality_rules(documents, labels.limit(0)).collect()
    assert all(r.p_quality is None and r.kept == (not r.base_failed) for r in none)
    assert quality_rules.quality_rules(documents.limit(0), labels).count() == 0
    judged = weak_labels.quality_classifier(documents).collect()
    by_id = {r.doc_id: r for r in judged}
    assert len(judged) == documents.count() and sorted(judged[0].asDict()) == ["doc_id", "kept", "score", "text"]
    assert not by_id[500].kept and not by_id[502].kept and by_id[5].kept and not by_id[105].kept
    assert weak_labels.quality_classifier(documents.limit(0)).count() == 0


def plain_estimate(patterns, counts, rounds=200):
    """EM with loops: each labeller has a chance of every vote in either class."""
    votes = [tuple(int(v) for v in p) for p in patterns]
    total = sum(counts)
    p = [0.1 if sum(v == -1 for v in x) * 9 > sum(v != 0 for v in x) else 0.95 for x in votes]
    for _ in range(rounds):
        mass = [sum(c * (1 - q) for c, q in zip(counts, p)) / total, sum(c * q for c, q in zip(counts, p)) / total]
        chance = []
        for n in range(len(votes[0])):
            seen = {v: [1e-3 / 2, 1e-3 / 2] for v in (-1, 1)}
            for x, c, q in zip(votes, counts, p):
                if x[n]:
                    seen[x[n]][0] += c / total * (1 - q)
                    seen[x[n]][1] += c / total * q
            chance.append({v: [seen[v][k] / (seen[-1][k] + seen[1][k]) for k in (0, 1)] for v in (-1, 1)})
        prior = min(0.99, max(0.01, mass[1]))
        p = []
        for x in votes:
            odds = [1 - prior, prior]
            for n, v in enumerate(x):
                if v:
                    odds = [o * chance[n][v][k] for k, o in enumerate(odds)]
            p.append(odds[1] / sum(odds))
    return prior, p


def test_em_against_loops():
    chance = random.Random(11)
    patterns = sorted({tuple(chance.choice((-1, 0, 1, 1)) for _ in range(4)) for _ in range(60)})
    counts = [chance.randint(1, 400) for _ in patterns]
    model = weak_labels.estimate(np.array(patterns), np.array(counts), 25)
    prior, p = plain_estimate(patterns, counts, 25)
    assert abs(model.prior - prior) < 1e-9
    assert np.allclose(model.posterior(np.array(patterns)), p, atol=1e-9)


def test_few_bad_texts_and_many_copies_still_train_a_scorer(spark):
    """Four bad texts among thousands, a third of them copies of one: the scorer knows both classes."""
    chance = random.Random(6)
    small, names = ("the", "of", "and", "in", "a", "is"), [f"name{k}x" for k in range(300)]
    good = lambda: " ".join(chance.choice(names if j % 2 else small) for j in range(60))
    made = [(k, good()) for k in range(1500)]
    made += [(5000 + k, made[3][1]) for k in range(800)] + [(9000 + k, " ".join(f"w{k}{j}*** !!" for j in range(60))) for k in range(12)]
    documents = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    model, scorer = weak_labels.fit(documents, 400)
    assert scorer is not None
    judged = {r.doc_id: r.kept for r in weak_labels.judge(documents, scorer).collect()}
    assert not any(judged[9000 + k] for k in range(12)) and sum(judged[k] for k in range(1500)) > 1480
    # kept follows the score of the whole text, row by row
    for r in weak_labels.judge(documents, scorer).limit(50).collect():
        assert r.score == pytest.approx(scorer.probability([r.text.encode()])[0]) and r.kept == (r.score >= 0.5)
    assert weak_labels.fit(documents.where("doc_id < 100"))[1] is None
