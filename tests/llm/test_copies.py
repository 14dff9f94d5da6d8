"""Jaccard join, line dedup and the pipeline against plain versions."""

import os
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from citegrain.llm import common, line_dedup, ngram_jaccard, queries
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables absent")


def corpus(seed=1, hot=60):
    """Copies, near copies around one text, shared passages, short and empty texts."""
    chance = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(900)] + ["É", "é", "of", "the"]
    text = lambda n: chance.choices(vocabulary, k=n)
    base, passage = text(140), text(50)
    rows = []
    for _ in range(hot):
        copy = [*base]
        for _ in range(chance.randint(0, 7)):
            copy[chance.randrange(140)] = f"edit{chance.randrange(10**6)}"
        rows.append(" ".join(copy))
    rows += [" ".join(base)] * 12
    for k in range(60):
        words = text(chance.randint(1, 90))
        if k % 2:
            words += passage
        rows.append(" ".join(words))
        if k % 7 == 0:
            rows += [" ".join(words).upper(), " ".join(words[1:]), "\n".join(words)]
    rows += ["", " \n", "a", "A", "a b c d", "A b\tc D", "a b c d e", "a b c", None, "x " * 3000, "x " * 2000]
    return [(k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    rows = corpus(seed) + [(None, corpus(seed)[0][1]), (3, corpus(seed)[3][1]), (3, "another text of id three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as root", "1 as n")
    mine = [tuple(r) for r in ngram_jaccard.jaccard_components(df.repartition(5)).collect()]
    expected = brute.jaccard_components(rows)
    assert sorted(mine, key=str) == sorted(expected, key=str)
    kept = ngram_jaccard.keep_one(df).collect()
    assert kept[0].asDict().keys() == set(df.columns)
    named = {c for d, n, c in expected if n}
    wordless = [d for d, n, _ in expected if not n]
    assert sorted(r.doc_id for r in kept) == sorted([*named, *wordless, *[3 for d, n, c in expected if d == 3 and c == 3][2:]])


def test_groups_of_equal_prefix_are_expanded(spark, monkeypatch):
    """With one slot for all shingles the order is by hash, so edits often leave the prefix alone."""
    monkeypatch.setattr(ngram_jaccard, "slot_counts", lambda _: np.zeros(1 << ngram_jaccard.SKETCH, np.int64))
    rows = corpus(5, hot=120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    slim = ngram_jaccard._slim(df)
    found = ngram_jaccard.signatures(slim, ngram_jaccard.slot_counts(slim)).toPandas()
    found = found[found.n > 0].drop_duplicates("cid")
    assert found.gkey.nunique() < len(found)
    mine = sorted(tuple(r) for r in ngram_jaccard.jaccard_components(df).collect())
    assert mine == sorted(brute.jaccard_components(rows))


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_jaccard.jaccard_components(df).count() == ngram_jaccard.keep_one(df).count() == 0
    assert line_dedup.line_dedup(df).count() == 0


@needs_tables
def test_components_of_the_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    mine = sorted(tuple(r) for r in queries.QUERIES["op9_ngram_jaccard"](spark, SMALL).collect())
    assert mine == sorted(brute.jaccard_components(rows))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    sql = duck.sql(queries.ORACLES["op9_ngram_jaccard"]).df()[["doc_id", "n_shingles", "component_id"]]
    assert sorted(map(tuple, sql.values.tolist())) == mine


def test_connected_components(spark):
    chance = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7), (200, 150), (150, 151)]
    edges += [(chance.randrange(300, 400), chance.randrange(300, 400)) for _ in range(60)]
    union = brute.Union()
    for a, b in edges:
        union.join(a, b)
    groups = defaultdict(set)
    for x in {x for e in edges for x in e}:
        groups[union.root(x)].add(x)
    expected = {(x, min(g)) for g in groups.values() if len(g) > 1 for x in g}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {tuple(r) for r in common.components(df).collect()} == expected
    assert common.components(df.limit(0)).count() == 0


def test_bitmap_holds_its_values(spark):
    values = np.array([0, 1, -1, 2**62, -(2**63), 12345], np.int64)
    words = common.bitmap(spark.createDataFrame([(int(v),) for v in values], "x long"), "x", 12)
    assert common.in_bitmap(words, values.view(np.uint64)).all()
    assert common.in_bitmap(words, np.arange(4096, dtype=np.uint64)).sum() == 4


# line dedup

def lines_corpus(seed=1):
    chance = random.Random(seed)
    vocabulary = [f"wörd{k}" for k in range(300)] + ["the", "of"]
    pool = [chance.choices(vocabulary, k=chance.randint(1, 60)) for _ in range(120)]
    rows = []
    for k in range(120):
        lines = []
        for _ in range(chance.randint(0, 8)):
            line = [*chance.choice(pool)]
            for _ in range(chance.choice((0, 0, 0, 1, 2, 9))):
                line[chance.randrange(len(line))] = chance.choice(vocabulary)
            lines.append(chance.choice((" ", ", ")).join(line) + chance.choice(("", ".", " !")))
        rows.append((k, "\n".join([*lines, *chance.choice(([], [""], ["---", ""]))])))
    return rows + [(None, rows[0][1]), (4, rows[4][1]), (500, None), (501, ""), (502, "y " * 30_000), (503, "Y, " * 29_000)]


def block_links(rows):
    """Classes of lines, and the links between those that share the SimHash of a segment."""
    lines = sorted({tuple(brute.plain_words(x)) for _, t in rows for x in (t or "").split("\n")} - {()})
    made = line_dedup.Lines([" ".join(x) for x in lines])
    prints, blocks, of = made.prints()
    held = [set(blocks[of == k].tolist()) if len(x) >= line_dedup.LEAST_WORDS else set() for k, x in enumerate(lines)]
    links = []
    for i, a in enumerate(lines):
        away = np.bitwise_count(prints[i] ^ prints).sum(axis=1)
        for j in range(i):
            b = lines[j]
            longest = max(len(a), len(b))
            if held[i] & held[j] and away[j] <= line_dedup.RADIUS and min(len(a), len(b)) >= 0.8 * longest:
                if longest > 5000 or longest - brute.edit_distance(a, b) >= 0.8 * longest:
                    links.append((a, b))
    return lines, links


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_against_all_pairs(spark, seed):
    rows = lines_corpus(seed)
    lines, links = block_links(rows)
    assert any(a != b for a, b in links)
    union = brute.Union()
    for a, b in links:
        union.join(a, b)
    order = sorted(enumerate(rows), key=lambda r: (r[1][0] is None, r[1][0] or 0))
    expected, seen = {}, {}
    for at, (doc_id, text) in order:
        if doc_id == 4 and 4 in expected:
            continue
        out = []
        for n, line in enumerate((text or "").split("\n")):
            words = tuple(brute.plain_words(line))
            root = union.root(words)
            if words and root in seen:
                continue
            if words:
                seen[root] = at
            out.append(line)
        expected[doc_id] = None if text is None else "\n".join(out)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as line", "'k' as key", "9 as n_lines")
    found = line_dedup.line_dedup(df.repartition(4)).collect()
    assert len(found) == len(rows) and found[0].asDict().keys() == set(df.columns) | {"n_removed"}
    for r in found:
        assert r.text == expected[r.doc_id], r.doc_id
        source = next(t for d, t in rows if d == r.doc_id)
        assert r.n_lines == (0 if source is None else source.count("\n") + 1)
        assert r.text is None or r.n_lines - r.n_removed == r.text.count("\n") + 1 or r.text == ""


def test_edit_distance():
    chance = random.Random(2)
    for _ in range(2000):
        a, b = ([chance.randint(0, 5) for _ in range(chance.randint(0, 14))] for _ in range(2))
        assert line_dedup.edit_distance(a, b) == brute.edit_distance(a, b)


def test_simhashes_are_the_majority_of_bits(monkeypatch):
    """Of whole lines and of their segments, whatever the chunks that words are counted in."""
    chance = random.Random(8)
    line = " ".join(f"v{chance.randrange(37)}" for _ in range(20_000))
    texts = [line + "\nshort one of five words\n\nlast", "other\r\ntext", "y " * 9000]
    majority = lambda words: int("".join(str(int(2 * c > len(words))) for c in np.unpackbits(
        words.view(np.uint8).reshape(-1, 8), axis=1).sum(0)), 2).to_bytes(8, "big")
    for chunk in (1 << 15, 100):
        monkeypatch.setattr(line_dedup, "CHUNK", chunk)
        made = line_dedup.Lines(texts)
        assert made.number.tolist() == [0, 1, 3, 0, 1, 0] and made.text.tolist() == [0, 0, 0, 1, 1, 2]
        prints, blocks, of = made.prints()
        cuts = made.cuts()
        segments = np.split(made.words, cuts[1:])
        for row in range(len(made.first)):
            words = made.words[made.first[row] : made.last[row]]
            assert prints[row].tobytes() == majority(words) + majority(common.mix(words + np.uint64(common.BASE)))
            own = [s for s, c in zip(segments, cuts) if made.first[row] <= c < made.last[row]]
            assert sum(map(len, own)) == len(words)
            longest = sorted({(-len(s), int.from_bytes(majority(s), "little")) for s in own})
            seen, expected = set(), []
            for _, value in longest:
                expected += [value] if value not in seen else []
                seen.add(value)
            assert set(blocks[of == row].tolist()) <= set(expected)
            assert len(blocks[of == row]) <= line_dedup.SEGMENTS and (len(blocks[of == row]) == min(line_dedup.SEGMENTS, len(expected)) or len(seen) < len(longest))


def test_an_edit_leaves_the_other_segments():
    chance = random.Random(9)
    kept = 0
    for _ in range(300):
        words = [f"w{chance.randrange(10**6)}" for _ in range(chance.randint(12, 60))]
        edited = [*words]
        edited[chance.randrange(len(words))] = "edited"
        made = line_dedup.Lines([" ".join(words), " ".join(edited)])
        _, blocks, of = made.prints()
        kept += bool(set(blocks[of == 0].tolist()) & set(blocks[of == 1].tolist()))
    assert kept >= 297


# pipeline

@needs_tables
def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.toPandas()
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        after = docs.toPandas()
        assert set(after.doc_id) <= set(before.doc_id)
        if k < 4:
            assert docs.columns == columns
        if k == 2:
            told = brute.jaccard_components(list(zip(before.doc_id.tolist(), before.text)))
            assert set(after.doc_id) == {c for _, _, c in told}
        if k == 3:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            leaked = {d for d, _ in brute.leaks(list(zip(before.doc_id.tolist(), before.text)), items)}
            assert leaked and set(after.doc_id) == set(before.doc_id) - leaked
    assert counts[0] > counts[1] > counts[2] >= counts[3] > counts[4] == counts[5]
    run = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert run == {r.doc_id: r.token_ids for r in docs.collect()}


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    bench = str(tmp_path / "sf")
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{bench}/benchmark.parquet")
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "of the house and a dog", None, "s", None)] * 2
    for docs in (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
                 spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs.withColumn("extra", docs.doc_id), bench)
            assert out.count() <= docs.count() and "doc_id" in out.columns


@needs_tables
def test_pipeline_stages_keep_own_columns_of_documents(spark):
    """Columns of documents that operators also add keep the values of documents."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr(
        "*", "doc_id + 0.5 as score", "concat('k', doc_id) as kept", "doc_id * 2 as n_lines", "'r' as n_removed"
    )
    for _, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(
            (r.score, r.kept, r.n_lines, r.n_removed) == (r.doc_id + 0.5, f"k{r.doc_id}", r.doc_id * 2, "r") for r in rows
        )
