"""Hashed n-gram features and a logistic regression over them, shared by both quality operators.

A text is five families of n-grams: words, word pairs, runs of four bytes, word shapes (the kinds
of the first and last byte), and whether a word repeats the one before it. Each family is the mean
of its hashed indicators, shrunk as if SHRINK empty ones were there, so the score of a text is a
bias plus the mean weight of each family, and a few words alone decide little. Training reads a bounded sample on the driver; scoring runs in Arrow
batches over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import SLICE, arrow_pass, grams, joined, word_hashes

BITS = 16
FAMILIES = 5
SHRINK = 20
# Families of few values are scaled up, or the many n-grams of the others would drown them.
SCALE = np.array([2.0, 2.0, 2.0, 2.0, 4.0])
SIZE = FAMILIES << BITS
KIND = np.array(
    [0 if chr(b).islower() else 1 if chr(b).isupper() else 2 if chr(b).isdigit() else 3 for b in range(128)]
    + [4] * 128
)


def _families(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(family, index of each n-gram in the weights, its text), in bounded parts."""
    data, offsets = joined(texts)
    starts, ends, words = word_hashes(data)
    owner = np.searchsorted(offsets, starts, "right") - 1
    shift = np.uint64(64 - BITS)
    yield 0, (words >> shift).astype(np.int64), owner
    pairs, at = grams(words, owner, 2)
    yield 1, (pairs >> shift).astype(np.int64) + (1 << BITS), owner[at]
    raw = np.frombuffer(data, np.uint8)
    again = np.zeros(len(words), np.int64)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    yield 3, KIND[raw[starts]] * 5 + KIND[raw[ends - 1]] + (3 << BITS), owner
    yield 4, again + (4 << BITS), owner
    for at in range(0, len(raw), SLICE):
        part = raw[at : at + SLICE + 3].astype(np.uint32)
        n = len(part) - 3
        if n <= 0:
            continue
        code = part[:n] | part[1 : n + 1] << 8 | part[2 : n + 2] << 16 | part[3 : n + 3] << 24
        index = (code * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int64)
        text = np.searchsorted(offsets, np.arange(at, at + n), "right") - 1
        inside = at + np.arange(n) + 4 < offsets[text + 1]
        yield 2, index[inside] + (2 << BITS), text[inside]


@dataclass
class Scorer:
    """Weights, bias, and the calibration p = 1 / (1 + exp(-(slope * z + shift)))."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, texts: list[bytes]) -> np.ndarray:
        total = np.zeros((FAMILIES, len(texts)))
        count = np.zeros((FAMILIES, len(texts)))
        for family, index, owner in _families(texts):
            total[family] += np.bincount(owner, self.weights[index], len(texts))
            count[family] += np.bincount(owner, minlength=len(texts))
        return self.bias + SCALE @ (total / (count + SHRINK))

    def probability(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.slope * self.raw(texts) + self.shift)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def sparse_rows(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Indices and values of each text's features, made for texts of about SLICE bytes at once: the
    n-grams of a text, all in memory, take some fifty times its size."""
    ends = np.cumsum([len(t) for t in texts]) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
    return [row for low, high in zip(cuts, cuts[1:]) if low < high for row in _sparse_rows(texts[low:high])]


def _sparse_rows(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    keys, shares = [], []
    counts = np.zeros((FAMILIES, len(texts)))
    parts = [*_families(texts)]
    for family, _, owner in parts:
        counts[family] += np.bincount(owner, minlength=len(texts))
    for family, index, owner in parts:
        key, n = np.unique(owner * SIZE + index, return_counts=True)
        keys.append(key)
        shares.append(SCALE[family] * n / (counts[family][key // SIZE] + SHRINK))
    key, share = np.concatenate(keys), np.concatenate(shares)
    order = np.argsort(key, kind="stable")
    key, share = key[order], share[order]
    cuts = np.searchsorted(key, np.arange(1, len(texts)) * SIZE)
    return [*zip(np.split(key % SIZE, cuts), np.split(share, cuts), strict=True)]


def smallest(df: DataFrame, column: str, total: int, limit: int) -> DataFrame:
    """At most `limit` rows of the smallest hashes, of `total` rows in all.

    The rows below a hash that about a tenth more than the limit pass are taken first, wherever
    they lie, so the final order never gathers more than those in one task.
    """
    share = min(1.0, 1.1 * limit / max(1, total))
    below = min(2**63 - 1, int(share * 2**64) - 2**63)
    return df.where(F.col(column) <= below).orderBy(column).limit(limit)


def sample_rows(df: DataFrame, label: str, limit: int) -> pa.Table:
    """At most `limit` rows of (y, fold, index, value), those of the smallest hash of their text.

    `df` holds text and the label column; the fold is a hash from 0 to 9.
    """
    picked = (
        df.where(F.col(label).isNotNull())
        .select("text", F.col(label).cast("double").alias("y"), F.xxhash64("text").alias("h"))
        .orderBy("h", "y")
        .limit(limit)
        .select("text", "y", F.pmod("h", F.lit(10)).cast("int").alias("fold"))
    )

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = sparse_rows([(t or "").encode() for t in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays(
            [batch.column("y"), batch.column("fold"),
             pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())),
             pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32()))],
            ["y", "fold", "index", "value"],
        )

    return arrow_pass(
        picked, step, "y double, fold int, index array<int>, value array<float>"
    ).toArrow()


class _Sparse:
    """A matrix by rows and by columns, 16 bytes an entry; no row is empty."""

    def __init__(self, index: pa.ListArray, value: pa.ListArray) -> None:
        column, self.value = index.flatten().to_numpy(), value.flatten().to_numpy()
        sizes = index.value_lengths().to_numpy(zero_copy_only=False)
        self.first = np.cumsum(sizes) - sizes
        order = np.argsort(column, kind="stable")
        ranked = column[order]
        self.column_first = np.flatnonzero(np.diff(ranked, prepend=-1))
        self.used = ranked[self.column_first]
        self.column = np.searchsorted(self.used, column).astype(np.int32)
        self.row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        self.value_by_column = self.value[order]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.value * w.astype(np.float32)[self.column], self.first, dtype=np.float64)

    def back(self, slack: np.ndarray) -> np.ndarray:
        parts = self.value_by_column * slack.astype(np.float32)[self.row]
        return np.add.reduceat(parts, self.column_first, dtype=np.float64)


def train(
    rows: pa.Table, rounds: int = 200, rate: float = 0.4, decay: float = 1e-5,
    stands_for: tuple[float, float] = (1.0, 1.0),
) -> Scorer:
    """Logistic regression by accelerated gradient steps on folds 0-6, Platt calibration on 7-9.

    A row with a label below 0.5 stands for the first of `stands_for` rows in the calibration, any
    other for the second. Rows may have soft labels. Both classes weigh the same in the fit; the calibration brings back
    their shares. Without held-out rows of both classes the fit is not calibrated. Plain steps
    move the n-grams that many texts share first, and leave those of one text near zero.
    """
    rows = rows.filter(pc.greater(pc.list_value_length(rows["index"]), 0))
    y, fold = rows["y"].to_numpy(), rows["fold"].to_numpy()
    if not len(y):
        return Scorer(np.zeros(SIZE, np.float32), 0.0)
    matrix = _Sparse(rows["index"].combine_chunks(), rows["value"].combine_chunks())
    fit = fold < 7
    share = np.clip(y[fit].mean() if fit.any() else 0.5, 1e-3, 1 - 1e-3)
    weigh = np.where(fit, y / share + (1 - y) / (1 - share), 0) / max(1, 2 * fit.sum())
    used = matrix.used
    w, ahead, bias, bias_ahead = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for k in range(rounds):
        slack = weigh * (sigmoid(matrix.times(ahead) + bias_ahead) - y)
        new = ahead - rate * (matrix.back(slack) + decay * ahead)
        new_bias = bias_ahead - rate * slack.sum()
        pull = k / (k + 3)
        ahead, bias_ahead = new + pull * (new - w), new_bias + pull * (new_bias - bias)
        w, bias = new, new_bias
    weights = np.zeros(SIZE, np.float32)
    weights[used] = w
    scorer = Scorer(weights, float(bias))
    z, held = matrix.times(w) + bias, y[~fit]
    if len(held) and held.min() < 0.5 <= held.max():
        scorer.slope, scorer.shift = platt(z[~fit], held, np.where(held < 0.5, *stands_for))
    return scorer


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the calibrating sigmoid, by damped Newton steps on smoothed labels."""
    weight = np.ones(len(y)) if weight is None else weight / weight.mean()
    up, n = (weight * y).sum(), len(y)
    goal = y * (up + 1) / (up + 2) + (1 - y) / (n - up + 2)
    x = np.stack([z, np.ones(n)])
    at = np.array([1.0, 0.0])
    loss = lambda v: -np.mean(
        weight * (goal * np.log(sigmoid(v @ x)) + (1 - goal) * np.log(sigmoid(-(v @ x))))
    )
    for _ in range(rounds):
        p = sigmoid(at @ x)
        down = x @ (weight * (p - goal)) / n
        bend = (x * (weight * p * (1 - p))) @ x.T / n + 1e-6 * np.eye(2)
        move, size = np.linalg.solve(bend, down), 1.0
        while size > 1e-3 and loss(at - size * move) > loss(at):
            size /= 2
        at = at - size * move
    return float(at[0]), float(at[1])
