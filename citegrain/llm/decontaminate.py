"""Benchmark decontamination by spaced seeds.

Texts and benchmark items are words of letters and digits, case ignored. A mask keeps six of seven
or nine neighbouring words; the hash of the kept words is a seed. The three masks together hit
every pair of thirteen aligned words with at most two substitutions. Seeds of the benchmark set
bits in a bitmap of fixed size; training words whose seeds fall on set bits are joined with the
benchmark by the seed itself, each side with the words around it, and every hit is verified: some
thirteen aligned words (or the whole item, where shorter) must agree in four fifths.

The masks leave gaps in items under thirteen words. Such an item of n words may differ in n // 5 of
them; cut in one part more, it keeps a whole part (pigeonhole), so its parts are seeds too. Texts
have seeds of those lengths only that the benchmark has parts of.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import (
    BASE, PLAIN, arrow_pass, bitmap, document_key, in_bitmap, joined, mix, signed, stored, texts_of,
    word_hashes,
)

MASKS = ("1111101", "1110111", "111001011")
SPAN = max(map(len, MASKS))
OVERLAP = 13
SHARE = 0.8
REACH = OVERLAP - 1
WIDTH = REACH + SPAN + REACH
BITS = 26
# PARTS[n, k]: words of the part that starts at word k of an item of n words, 0 where none does.
PARTS = np.zeros((OVERLAP, OVERLAP), np.int64)
for _n in range(1, OVERLAP):
    _cuts = [_n * k // (_n // 5 + 1) for k in range(_n // 5 + 2)]
    PARTS[_n, _cuts[:-1]] = np.diff(_cuts)
RUNS = tuple(range(1, int(PARTS.max()) + 1))


def seeds(words: np.ndarray, owner: np.ndarray, runs: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of all masks and of runs of words, the word each starts at, and its run or 0."""
    found, places, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    kinds = [(n, mask, 0) for n, mask in enumerate(MASKS)] + [(len(MASKS) + k, "1" * k, k) for k in runs]
    for n, mask, run in kinds:
        count = len(words) - len(mask) + 1
        if count <= 0:
            continue
        total = np.full(count, n + 1, np.uint64)
        for k, kept in enumerate(mask):
            if kept == "1":
                total = total * np.uint64(BASE) + words[k : k + count]
        at = np.flatnonzero(owner[:count] == owner[len(mask) - 1 :])
        found.append(mix(total[at]))
        places.append(at)
        of.append(np.full(len(at), run))
    return np.concatenate(found), np.concatenate(places), np.concatenate(of)


def around(words: np.ndarray, owner: np.ndarray, at: np.ndarray, blank: int) -> pa.Array:
    """WIDTH words from REACH before each place, as 32-bit hashes; `blank` beyond the text's ends."""
    place = at[:, None] + np.arange(-REACH, WIDTH - REACH)
    inside = (place >= 0) & (place < len(words))
    place = np.where(inside, place, 0)
    inside &= owner[place] == owner[at][:, None]
    short = np.where(inside, (words[place] | np.uint64(2)).astype(np.uint32), np.uint32(blank))
    return pa.array([row.tobytes() for row in short], pa.binary())


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = joined([t.encode().translate(PLAIN) for t in texts])
    starts, _, words = word_hashes(data)
    return words, np.searchsorted(offsets, starts, "right") - 1


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """(seed, run, item_id, item_at, length, item_words) of every seed of every item."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, owner = _words(texts_of(batch.column("text")))
        seed, at, run = seeds(words, owner, RUNS)
        first = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        size, place = np.diff(first)[owner[at]], at - first[owner[at]]
        part = PARTS[np.where(size < OVERLAP, size, 0), np.minimum(place, OVERLAP - 1)]
        keep = (run == 0) | (part == run)
        seed, at, run, length = seed[keep], at[keep], run[keep], np.minimum(size[keep], OVERLAP)
        return pa.RecordBatch.from_arrays(
            [signed(seed), pa.array(run.astype(np.int32)), batch.column("item_id").take(pa.array(owner[at])),
             pa.array((at - first[owner[at]]).astype(np.int32)), pa.array(length.astype(np.int32)),
             around(words, owner, at, 0)],
            ["seed", "run", "item_id", "item_at", "length", "item_words"],
        )

    return arrow_pass(
        benchmark.select("item_id", "text"), step,
        f"seed long, run int, item_id {dict(benchmark.dtypes)['item_id']}, item_at int, length int, item_words binary",
    )


def text_seeds(documents: DataFrame, words_of_bitmap: np.ndarray, runs: tuple[int, ...] = ()) -> DataFrame:
    """(doc_id, doc_key, seed, at, words) of the seeds that the bitmap lets through."""
    shared = documents.sparkSession.sparkContext.broadcast(words_of_bitmap)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, owner = _words(texts_of(batch.column("text")))
        seed, at, _ = seeds(words, owner, runs)
        keep = in_bitmap(shared.value, seed)
        seed, at = seed[keep], at[keep]
        first = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        rows = pa.array(owner[at])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(rows), batch.column("doc_key").take(rows), signed(seed),
             pa.array((at - first[owner[at]]).astype(np.int32)), around(words, owner, at, 1)],
            ["doc_id", "doc_key", "seed", "at", "words"],
        )

    return arrow_pass(
        documents.select("doc_id", "text", document_key(F.col("text"), F.col("doc_id")).alias("doc_key")),
        step, f"doc_id {dict(documents.dtypes)['doc_id']}, doc_key long, seed long, at int, words binary",
    )


def agrees(ours: np.ndarray, theirs: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether some `length` aligned words of each pair of rows agree in SHARE of them."""
    same = np.cumsum(np.pad(ours == theirs, ((0, 0), (1, 0))), axis=1)
    found = np.zeros(len(length), bool)
    for n in np.unique(length):
        rows = length == n
        most = (same[rows, n:] - same[rows, :-n]).max(axis=1)
        found[rows] = most >= SHARE * n
    return found


def overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, doc_key, item_id, n_hits, first_word, last_word) of each leaked pair.

    Words are counted from 0 in the text. Null texts and items have no words and are
    not looked for. Rows alike in doc_id and text count as one
    document; a null doc_id or item_id stays null.
    """
    items = item_seeds(benchmark)
    # written, so that no task keeps a Python worker for the seeds and one for the check
    runs = tuple(sorted(r.run for r in items.where("run > 0").select("run").distinct().collect()))
    hits = stored(text_seeds(documents, bitmap(items, "seed", BITS), runs).join(items, "seed"))

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        side = [
            np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint32).reshape(-1, WIDTH)
            for n in ("words", "item_words")
        ]
        good = pa.array(agrees(*side, batch.column("length").to_numpy()))
        return batch.select(["doc_id", "doc_key", "item_id", "at", "length"]).filter(good)

    kinds = dict(hits.dtypes)
    verified = arrow_pass(
        hits.select("doc_id", "doc_key", "item_id", "at", "length", "words", "item_words"), verify,
        f"doc_id {kinds['doc_id']}, doc_key long, item_id {kinds['item_id']}, at int, length int",
    )
    return verified.groupBy("doc_id", "doc_key", "item_id").agg(
        F.count_distinct("at").alias("n_hits"), F.min("at").alias("first_word"),
        F.max(F.col("at") + F.least(F.lit(SPAN), "length") - 1).alias("last_word"),
    )


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that share no passage with the benchmark, with all their columns."""
    leaked = overlaps(documents, benchmark).select(
        F.col("doc_id").alias("_leaked_id"), F.col("doc_key").alias("_leaked_key")
    ).distinct()
    key = document_key(documents["text"], documents["doc_id"])
    return documents.join(
        leaked, documents["doc_id"].eqNullSafe(leaked["_leaked_id"]) & (key == leaked["_leaked_key"]), "left_anti"
    )
