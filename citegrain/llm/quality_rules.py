"""Quality rules: fixed base rules, then a calibrated hashed n-gram regression.

The regression (citegrain.llm.hashed) is trained on a bounded sample of labelled rows and scores
every text in Arrow batches; a text is kept when the calibrated probability of good quality
reaches a fixed threshold.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import arrow_pass, free_arrow, texts_of
from citegrain.llm.hashed import Scorer, sample_rows, smallest, train

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def repeated_words(words: list[str]) -> int:
    """Words in 3-word windows that the text has twice or more."""
    windows = [*zip(words, words[1:], words[2:])]
    if len(set(windows)) == len(windows):
        return 0
    counts, inside = Counter(windows), bytearray(len(words))
    for at, window in enumerate(windows):
        if counts[window] > 1:
            inside[at : at + 3] = b"\1\1\1"
    return sum(inside)


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def base_metrics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORD.findall(text)
    return (
        len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)),
        duplicate_lines(text), repeated_words(words),
    )


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = 2000) -> Scorer | None:
    """A scorer from at most `max_rows` labelled rows; None where no labelled row has a text.

    Labels are 0 or 1; null labels and labels of unknown documents are left out. Rows with several
    labels or ids with several rows count once each.
    """
    known = labels.where("quality is not null and doc_id is not null").select(
        "doc_id", F.col("quality").alias("label"), F.xxhash64("doc_id", "quality").alias("h")
    )
    picked = smallest(known, "h", known.count(), max_rows).drop("h")
    rows = sample_rows(documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), "label", max_rows)
    scorer = train(rows) if rows.num_rows and len(set(rows["y"].to_pylist())) > 1 else None
    del rows
    free_arrow()
    return scorer


def judge(documents: DataFrame, scorer: Scorer | None, least: float = 0.5) -> DataFrame:
    """One row for each document: the base metrics, base_failed, p_quality and kept.

    A null text has no words and fails the base rules. Without a scorer (no labels, or of one
    class only) p_quality is null and the base rules decide. Repeated rows are judged each.
    """
    shared = documents.sparkSession.sparkContext.broadcast(scorer)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column("text"))
        found = np.array([base_metrics(t) for t in texts], np.int64).reshape(-1, 5)
        failed = (found[:, 0] < 50) | (100 * found[:, 4] > 50 * found[:, 0])
        model = shared.value
        p = model.probability([t.encode() for t in texts]) if model else None
        kept = ~failed if p is None else ~failed & (p >= least)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(found[:, k]) for k in range(5)), pa.array(failed),
             pa.array(kept), pa.array(p, pa.float64()) if model else pa.nulls(len(texts), pa.float64())],
            ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "base_failed", "kept", "p_quality"],
        )

    return arrow_pass(
        documents.select("doc_id", "text"), step,
        f"doc_id {dict(documents.dtypes)['doc_id']}, n_words long, word_chars long, n_symbols long, "
        "n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_quality double",
    )


def quality_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(documents, fit(documents, labels))
