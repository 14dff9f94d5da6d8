"""License, secret and URL scans, and decontamination, against plain versions."""

import hashlib
import itertools
import random

import duckdb
import numpy as np
import pytest

from citegrain.llm import decontaminate, license_scan, secret_scan, url_filter
from tests.llm import brute


# licenses

def test_every_template_is_found_where_it_stands(spark):
    chance = random.Random(6)
    filler = [f"wörd{k}" for k in range(500)]
    rows, expected = [], set()
    for k, (name, text) in enumerate(license_scan.TEMPLATES.items()):
        before = " ".join(chance.choices(filler, k=k * 7)) + "\n"
        rows.append((k, f"{before}{text.upper()}\nafter {k}"))
        expected.add((k, name))
        assert before[-1:] == "\n"
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert expected <= {(r.doc_id, r.license) for r in found if r.coverage == 1.0}
    texts = dict(rows)
    for r in found:
        if (r.doc_id, r.license) in expected:
            part = texts[r.doc_id][r.start : r.end]
            assert brute.plain_words(part) == brute.plain_words(license_scan.TEMPLATES[r.license])


def test_edited_copies_and_clean_texts(spark):
    words = license_scan.TEMPLATES["MIT"].split()
    edited = [w for k, w in enumerate(words) if k % 17] + ["x"]
    edited.insert(20, "inserted")
    rows = [
        (1, " ".join(edited)), (2, " ".join(words[: len(words) // 2])), (3, "This license is under the tree"),
        (4, None), (None, ""), (5, "Released under the MIT License.\n" * 3), (5, "Released under the MIT License.\n" * 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as license")
    found = [(r.doc_id, r.license, r.start) for r in license_scan.scan(df).collect()]
    assert sorted(found) == [(1, "MIT", 0)] + [(5, "MIT-notice", s) for s in (0, 0, 32, 32, 64, 64)]
    assert license_scan.scan(df.limit(0)).count() == 0


def test_alignment_bridges_gaps():
    score, matched, first, last = license_scan.align([1, 2, 3, 4, 5, 6], [9, 1, 2, 8, 3, 4, 5, 6], -3, 4)
    assert (score, matched, first, last) == (5, 6, 1, 7)
    assert license_scan.align([1, 2], [3, 4], -2, 2)[1] == 0


# secrets

@pytest.fixture(scope="module")
def scanner():
    return secret_scan.SecretScanner()


def test_spans_equal_the_expressions(scanner):
    chance = random.Random(1)
    parts = [
        "token", "Token = ", "api_key", "apikey: '", "PASSWORD", "AKIA", "AKIAABCDEFGH1234", "deadbeef" * 4,
        "0123456789abcdef", "\n", " ", "=", ":", '"', "é", "ſecret=abcdefghij", "abcdefgh", "secret",
        "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890", "ghp_" + "a" * 36, "eyJabcd.eyJabcd.abcd", "sk_live_", "Z9",
    ]
    for _ in range(4000):
        text = "".join(chance.choices(parts, k=chance.randint(0, 25)))
        assert scanner.spans(text) == brute.secrets(text, scanner.rules)


def test_minimal_automaton_agrees_with_search(scanner):
    rule = secret_scan.Rule("x", r"a(b|cd)+[0-9]{2}", r"a(b|cd)+[0-9]{2}")
    table = secret_scan.compile_rules((rule,))
    assert len(table) < 8
    for text in map("".join, itertools.product("abcd1", repeat=6)):
        state = 0
        for byte in text.encode():
            state = table[state, byte]
        assert (state == len(table) - 1) == bool(brute.re.search(rule.scan, text))
    with pytest.raises(ValueError):
        secret_scan.compile_rules((secret_scan.Rule("y", r"a\n?b", r"a\n?b"),))


def test_secret_digest(spark):
    text = "é token: short\npassword = 'longenough' AKIAABCDEFGH1234 " + "a1" * 16
    rows = [(1, text), (1, text), (2, None), (None, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as spans", "'' as secrets")
    found = secret_scan.digests(df).collect()
    spans = [(s, secret_scan.RULES[n].kind, e) for s, n, e in brute.secrets(text, secret_scan.RULES)]
    told = ",".join(f"{k}:{s}:{e}" for s, k, e in spans)
    ones = [r for r in found if r.doc_id == 1]
    assert len(found) == 4 and len(ones) == 2 and ones[0] == ones[1]
    assert (ones[0].n_assign, ones[0].n_access, ones[0].n_hex, ones[0].spans) == (1, 1, 1, told)
    assert ones[0].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.base_sha256 for r in found if r.doc_id != 1} == {empty}
    assert secret_scan.digests(df.limit(0)).count() == 0


# URLs

URLS = [
    None, "", "no scheme", "http://A.Example.COM/en/x", "https://www.example.com/en/", "https://www.example.com/EN/",
    "http://example.com/en", "http://notexample.com/en/1", "http://x.net/es/", "http://x.net/de/", "http://net/fr/?a",
    "http://a.net?x/es/", "http://a.net#/fr/", "ftp://casino-win.example.org/de/1", "http://x.org/poker/1",
    "http://x.org/pokers/1", "http://mycasino.org/", "http://casino.com/", "://h/es/", "a://b://c.net/es/", "http://x.net:80/es/",
    "http://İ.com/", "http://u@x.net/fr/a#b?c", "http://" + "a." * 20_000 + "net/es/", "http://x.net/es/", "http://x.net/es/",
]


def test_urls_against_sql(spark):
    rows = [(k, u, "h") for k, u in enumerate(URLS)] + [(None, "http://adult-x.example.net/", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    mine = url_filter.filter_urls(pages).toPandas()
    connection = duckdb.connect()
    connection.register("pages", pages.toPandas())
    theirs = connection.sql(url_filter.oracle_sql()).df()
    key = lambda frame: sorted(map(str, frame[["page_id", "host", "path", "rule", "verdict"]].astype(object).where(frame.notna(), None).values.tolist()))
    assert key(mine) == key(theirs)
    assert len(mine) == len(rows)
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_rules_are_filed_under_their_rarest_token():
    rules = (url_filter.host_rule("block", "a.com/x/"), url_filter.word_rule("casino"), url_filter.UrlRule("q", (), "block"))
    assert rules[0].tokens == ("a", "com", "x")
    index = url_filter.index_rules(rules, {"a": 5, "com": 90, "x": 2, "casino": 7})
    assert index == {"x": [0], "casino": [1], "": [2]}


# decontamination

def test_masks_reach_every_pair_of_two_substitutions():
    for gone in itertools.combinations(range(13), 2):
        assert any(
            all(kept == "0" or at + k not in gone for k, kept in enumerate(mask))
            for mask in decontaminate.MASKS for at in range(13 - len(mask) + 1)
        )


def test_leaks_against_all_pairs(spark):
    chance = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)] + ["thé", "of"]
    text = lambda n: chance.choices(vocabulary, k=n)
    items = [(k, text(chance.choice((7, 9, 12, 13, 30, 60)))) for k in range(25)]
    documents = []
    for k in range(150):
        words = text(chance.randint(0, 80))
        if k % 2:
            part = [*chance.choice(items)[1]]
            start = chance.randint(0, max(0, len(part) - 13)) if k % 3 == 0 else 0
            part = part[start : start + chance.choice((8, 13, 20, 60))]
            for _ in range(chance.randint(0, 4)):
                part[chance.randrange(len(part))] = "changed"
            words[len(words) // 2 : len(words) // 2] = part
        documents.append((k, ", ".join(words).upper() if k % 5 == 0 else " ".join(words)))
    items = [(k, " ".join(w) + ".") for k, w in items]
    documents += [(150, None), (151, ""), (1, documents[1][1]), (152, "long " * 60_000 + items[0][1])]
    bench = spark.createDataFrame([*items, (25, None), (26, "too short to seed"), (3, items[3][1])], "item_id long, text string")
    df = spark.createDataFrame(documents, "doc_id long, text string").selectExpr("*", "1 as seed", "2 as item_id")
    found = decontaminate.overlaps(df, bench)
    rows = found.collect()
    expected = {p for p in brute.leaks(documents[:-1], items)} | {(152, 0)}
    # an item of 7 to 12 words may only differ where a mask does not look
    whole = {k for k, t in items if len(brute.plain_words(t)) < 13}
    mine = {(r.doc_id, r.item_id) for r in rows}
    assert mine <= expected and {p for p in expected if p[1] not in whole} <= mine
    assert (152, 0) in mine and len(rows) == len({(r.doc_id, r.doc_key, r.item_id) for r in rows})
    clean = decontaminate.clean(df, bench)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in documents} - {d for d, _ in mine}
    assert decontaminate.overlaps(df.limit(0), bench).count() == 0
    assert decontaminate.clean(df, bench.limit(0)).count() == df.count()


def test_null_ids_keep_their_rows_apart(spark):
    item = " ".join(f"q{k}" for k in range(20))
    df = spark.createDataFrame([(None, item), (None, "clean words only"), (1, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item)], "item_id long, text string")
    assert [r.text for r in decontaminate.clean(df, bench).orderBy("text").collect()] == [None, "clean words only"]


def test_window_agreement():
    ours = np.arange(66, dtype=np.uint32).reshape(2, 33) + 5
    theirs = ours.copy()
    theirs[0, ::4] = 0
    assert decontaminate.agrees(ours, theirs, np.array([13, 13])).tolist() == [False, True]
