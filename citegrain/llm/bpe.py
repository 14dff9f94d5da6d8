"""BPE encoding and decoding through a tokenization automaton.

The merges are compiled, by rank, into a deterministic automaton over tokens that accepts exactly
the correct token sequences. It starts with one state that loops on every byte token. The gadget
of a merge (u, v) takes the state s that u leads to: a copy of s without the v arc becomes the new
target of u, and the arc uv, leading where v leads, joins u wherever u may stand. All arcs of a
token lead to one state, so a state is kept as (parent, arc removed, rank) and a token as (first
part, rank, target); whether a state has an arc follows from walking both chains by rank.

Encoding searches, for each pre-split word, the one accepted path whose labels spell the word:
longest label first, never entering a position twice, since a prefix has one correct path only.
Transitions found are kept in a table, words found in another; both are emptied when full.
Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from citegrain.llm.bpe_tables import BpeTables, load_tables
from citegrain.llm.common import arrow_pass, texts_of

MAX_TRANSITIONS = 1 << 21
MAX_WORDS = 1 << 18


class TokenAutomaton:
    def __init__(self, tables: BpeTables) -> None:
        self.tables = tables
        size = len(tables.labels)
        self.parent, self.removed, self.rank = [0], [-1], [-1]
        self.target = [0] * size
        self.first = [-1] * size
        self.born: list[int | None] = [None] * size
        for token in tables.byte_ids:
            self.born[token] = -1
        for at, merge in enumerate(tables.merges):
            self._gadget(at, *merge)
        self.ids = {tables.labels[t]: t for t in range(size) if self.born[t] is not None}
        self.longest = max(map(len, self.ids))
        self._reset()

    def _gadget(self, at: int, left: int, right: int, new: int) -> None:
        if self.born[left] is None or self.born[right] is None:
            return
        state = self.target[left]
        if not self.has_arc(state, right):
            return
        if self.born[new] is not None:
            raise ValueError(f"two merges make token {new}")
        onward = self.target[right]
        self.parent.append(state)
        self.removed.append(right)
        self.rank.append(at)
        self.target[left] = len(self.parent) - 1
        self.first[new], self.born[new], self.target[new] = left, at, onward

    def has_arc(self, state: int, token: int) -> bool:
        while state:
            if self.rank[state] > self.born[token]:
                if self.removed[state] == token:
                    return False
                state = self.parent[state]
            else:
                token = self.first[token]
        return True

    def _reset(self) -> None:
        self.moves: dict[int, int] = {}
        self.words: dict = _Words(self)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"moves": None, "words": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def path(self, word: bytes) -> list[int]:
        """Tokens on the accepted path that spells the word."""
        n, size, ids, moves = len(word), len(self.first), self.ids, self.moves
        if (whole := ids.get(word)) is not None and self.has_arc(0, whole):
            return [whole]
        dead = bytearray(n + 1)
        tokens: list[int] = []
        ends, states, tried = [0], [0], [self.longest]
        while ends[-1] < n:
            at, state, found = ends[-1], states[-1], -1
            length = min(tried[-1], n - at)
            while length:
                token = ids.get(word[at : at + length])
                if token is not None and not dead[at + length]:
                    key = state * size + token
                    onward = moves.get(key)
                    if onward is None:
                        if len(moves) >= MAX_TRANSITIONS:
                            moves.clear()
                        onward = self.target[token] if self.has_arc(state, token) else -1
                        moves[key] = onward
                    if onward >= 0:
                        found = token
                        break
                length -= 1
            if found < 0:
                dead[at] = 1
                ends.pop(), states.pop(), tried.pop(), tokens.pop()
                continue
            tried[-1] = length - 1
            tokens.append(found)
            ends.append(at + length)
            states.append(onward)
            tried.append(self.longest)
        return tokens

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.words.__getitem__, self.tables.pieces(text)))

    def decode(self, ids: list[int]) -> str:
        labels = self.tables.labels
        return b"".join([labels[i] for i in ids]).decode("utf-8", "replace")


class _Words(dict):
    """Packed ids of the words met; special tokens come as their id."""

    def __init__(self, automaton: TokenAutomaton) -> None:
        self.automaton = automaton

    def __missing__(self, word: str | int) -> bytes:
        ids = [word] if isinstance(word, int) else self.automaton.path(word.encode())
        packed = array("I", ids).tobytes()
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = packed
        return packed


def compile_automaton(path: str) -> TokenAutomaton:
    return TokenAutomaton(load_tables(path))


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with the column; one of the same name is replaced."""
    keep = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(i) for i in keep), values], [*(batch.schema.names[i] for i in keep), name]
    )


def _schema(df: DataFrame, name: str, kind: str) -> str:
    fields = [f"`{n}` {t}" for n, t in df.dtypes if n != name]
    return ", ".join([*fields, f"`{name}` {kind}"])


def encode(
    df: DataFrame, path: str, text: str = "text", ids: str = "token_ids"
) -> DataFrame:
    """All columns and the token ids of the text.

    A null text counts as empty and has no ids. Rows stay as they are, repeated ones too; a column
    named like `ids` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(compile_automaton(path))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = shared.value
        packed = [automaton.encode(t) for t in texts_of(batch.column(text))]
        return _with_column(batch, ids, id_lists(packed))

    return arrow_pass(df, step, _schema(df, ids, "array<int>"))


def decode(
    df: DataFrame, path: str, ids: str = "token_ids", text: str = "text"
) -> DataFrame:
    """All columns and the text that the ids spell; null ids give an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(load_tables(path).labels)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        labels = shared.value
        rows = batch.column(ids).to_pylist()
        spelt = [b"".join([labels[i] for i in row or ()]).decode("utf-8", "replace") for row in rows]
        return _with_column(batch, text, pa.array(spelt, pa.string()))

    return arrow_pass(df, step, _schema(df, text, "string"))


def id_lists(packed: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed]))).astype(np.int32)
    flat = np.frombuffer(b"".join(packed), np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, its ids decoded again."""
    shared = df.sparkSession.sparkContext.broadcast(compile_automaton(path))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        automaton = shared.value
        counts, coded, spelt = [], [], []
        for text in texts_of(batch.column("text")):
            packed = automaton.encode(text)
            counts.append(len(packed) // 4)
            coded.append(hashlib.sha256(packed).hexdigest())
            back = automaton.decode(memoryview(packed).cast("I").tolist())
            spelt.append(hashlib.sha256(back.encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded, pa.string()),
             pa.array(spelt, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return arrow_pass(
        df.select("doc_id", "text"), step,
        f"doc_id {dict(df.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
