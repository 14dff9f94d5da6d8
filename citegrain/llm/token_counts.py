"""Token counts by the whole-token shortcut.

Compiling proves, for each string of the vocabulary, whether it encodes alone as one token, by
running the merges on it. A pre-token in that set counts as one token by one look-up; only the
others are merged. Counts of merged words are kept in a table that is emptied when full.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame

from citegrain.llm.bpe_tables import BpeTables, load_tables
from citegrain.llm.common import arrow_pass, texts_of

MAX_WORDS = 1 << 18
SHORT = 40


class WholeTokens:
    def __init__(self, tables: BpeTables) -> None:
        self.tables = tables
        self.rank = {(a, b): (k, new) for k, (a, b, new) in reversed([*enumerate(tables.merges)])}
        self.alone = frozenset(
            text
            for label in tables.labels
            if (text := _text(label)) is not None and text not in tables.special
            and tables.pieces(text) == [text] and self.merged(label) == 1
        )
        self.counts = _Counts(self)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"counts": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.counts = _Counts(self)

    def merged(self, word: bytes) -> int:
        """How many tokens are left after all merges of a word."""
        ids = [self.tables.byte_ids[b] for b in word]
        return self._merge_short(ids) if len(ids) <= SHORT else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> int:
        rank = self.rank
        while len(ids) > 1:
            found = [(r[0], k, r[1]) for k in range(len(ids) - 1) if (r := rank.get((ids[k], ids[k + 1])))]
            if not found:
                break
            _, k, new = min(found)
            ids[k : k + 2] = [new]
        return len(ids)

    def _merge_long(self, ids: list[int]) -> int:
        """The same merges with a heap over linked neighbours, for words of any length."""
        n, rank = len(ids), self.rank
        after, before, left = [*range(1, n + 1)], [*range(-1, n - 1)], n
        heap = [(r[0], k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := rank.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = rank[a, b][1], -1
            left -= 1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if r := rank.get((ids[k], ids[after[k]])):
                    heapq.heappush(heap, (r[0], k, ids[k], ids[after[k]]))
            if (p := before[k]) >= 0 and (r := rank.get((ids[p], ids[k]))):
                heapq.heappush(heap, (r[0], p, ids[p], ids[k]))
        return left

    def count(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, self.tables.pieces(text)))


def _text(label: bytes) -> str | None:
    try:
        return label.decode() or None
    except UnicodeDecodeError:
        return None


class _Counts(dict):
    """Tokens by pre-token; a special token comes as its id and counts as one."""

    def __init__(self, whole: WholeTokens) -> None:
        self.whole = whole
        self._seed()

    def _seed(self) -> None:
        self.clear()
        self.update(dict.fromkeys(self.whole.alone, 1))

    def __missing__(self, word: str | int) -> int:
        if isinstance(word, int):
            return 1
        if len(self) >= MAX_WORDS + len(self.whole.alone):
            self._seed()
        self[word] = count = self.whole.merged(word.encode())
        return count


def token_counts(df: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the tokens exceed the limit, for each row.

    A null text counts as empty; repeated rows are counted each; other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(WholeTokens(load_tables(path)))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole, texts = shared.value, texts_of(batch.column("text"))
        counts = [whole.count(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
             pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return arrow_pass(
        df.select("doc_id", "text"), step,
        f"doc_id {dict(df.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean",
    )
