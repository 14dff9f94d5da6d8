"""Token automaton and whole-token counts against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from citegrain.llm import bpe, token_counts
from citegrain.llm.bpe_tables import load_tables

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def automaton():
    return bpe.compile_automaton(PATH)


@pytest.fixture(scope="module")
def whole():
    return token_counts.WholeTokens(load_tables(PATH))


def texts():
    chance = random.Random(4)
    wide = [chr(c) for c in [*range(1, 0x3100), *range(0xAC00, 0xAC40), 0x1F600, 0x558, 0x323B0, 0x2028]]
    tight = "ab  \t\n's'tre<|endoftext|>1é漢字́aaaa\x1c\x85"
    made = ["".join(chance.choices(wide, k=chance.randint(0, 40))) for _ in range(400)]
    made += ["".join(chance.choices(tight, k=chance.randint(0, 80))) for _ in range(400)]
    return made + [
        "", " ", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|", "a" * 3000,
        "ab" * 1500 + "é" * 900, " " * 2000, "\n\n\n x", "the quick brown fox's don't",
    ]


def test_ids_counts_and_round_trip(library, automaton, whole):
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        mine = np.frombuffer(automaton.encode(text), np.uint32).tolist()
        assert mine == ids
        assert automaton.decode(mine) == library.decode(ids, skip_special_tokens=False) == text
        assert whole.count(text) == len(ids)


def test_every_vocabulary_string_alone(library, automaton, whole):
    for label in automaton.tables.labels[::7]:
        text = label.decode("utf-8", "replace")
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(automaton.encode(text), np.uint32).tolist() == ids
        assert whole.count(text) == len(ids)


def test_split_of_every_character(library, automaton):
    split = library.pre_tokenizer
    for c in [*range(0x110000)][::3]:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}1"
            assert len(automaton.tables.pieces(text)) == len(split.pre_tokenize_str(text))


def test_a_state_forbids_what_merges(automaton):
    ids = {label: k for k, label in enumerate(automaton.tables.labels)}
    assert not automaton.has_arc(automaton.target[ids[b"h"]], ids[b"e"])
    assert automaton.has_arc(automaton.target[ids[b"z"]], ids[b"q"])


def test_operators_and_edge_rows(spark, library):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (2, None, None), (None, "", "y"), (3, "é" * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    coded = bpe.encode(df, PATH)
    assert dict(coded.dtypes)["token_ids"] == "array<int>"
    back = bpe.decode(coded.drop("text"), PATH)
    spelt = sorted((r.doc_id is None, r.doc_id, r.text) for r in back.collect())
    assert [t for *_, t in spelt] == ["Hello world", "Hello world", "", "é" * 50_000, ""]
    told = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, PATH).collect()}
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()) in told
    counts = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df, PATH).collect()}
    assert (2, 0, 0, False) in counts and (None, 0, 0, False) in counts
    long = len(library.encode("é" * 50_000, add_special_tokens=False).ids)
    assert (3, 100_000, long, True) in counts
    assert bpe.digests(df.limit(0), PATH).count() == token_counts.token_counts(df.limit(0), PATH).count() == 0


def test_other_tokenizer_files_are_refused():
    with pytest.raises(ValueError):
        load_tables(public_tokenizers.path("word_bpe_49k.json"))
