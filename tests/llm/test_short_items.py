"""Benchmark items under thirteen words, against all pairs."""

import itertools
import random

from citegrain.llm import decontaminate
from tests.llm import brute


def test_every_substitution_in_a_short_item_is_found(spark):
    items, documents = [], []
    for n in range(1, 14):
        item = [f"item{n}w{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for gone in range(3):
            for places in itertools.combinations(range(n), gone):
                copy = [f"other{k}" if k in places else w for k, w in enumerate(item)]
                documents += [(len(documents), " ".join(copy)), (len(documents) + 1, " ".join(["a", *copy, "b", "c"]))]
    documents += [(len(documents) + k, " ".join(t.split()[k % 2 : len(t.split()) - 1 + k % 2])) for k, (_, t) in enumerate(items * 2)]
    bench = spark.createDataFrame([*items, (20, None), (21, " . ")], "item_id long, text string")
    df = spark.createDataFrame(documents, "doc_id long, text string")
    mine = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(df, bench).collect()}
    assert mine == brute.leaks(documents, items)


def test_short_items_against_all_pairs(spark):
    chance = random.Random(9)
    text = lambda n: chance.choices([f"w{k}" for k in range(12)], k=n)
    items = [(k, " ".join(text(1 + k % 13))) for k in range(39)]
    documents = [(k, " ".join(text(chance.randint(0, 30)))) for k in range(80)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(documents, "doc_id long, text string")
    rows = decontaminate.overlaps(df, bench).collect()
    expected = brute.leaks(documents, items)
    assert {(r.doc_id, r.item_id) for r in rows} == expected and len(rows) == len(expected)
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == {d for d, _ in documents} - {d for d, _ in expected}
