"""Quality classifier from weak labels.

Nine heuristic labellers vote good, bad or nothing on every document. Documents with the same
votes are counted together, at most 3**9 rows for any corpus; on these counts expectation-
maximisation estimates how often each labeller is right and, from that, the posterior of each vote
pattern. The posteriors label a bounded sample, on which a hashed linear scorer
(citegrain.llm.hashed) is trained; the scorer, not the votes, judges every document.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import Scratch, arrow_pass, document_key, free_arrow, texts_of
from citegrain.llm.hashed import Scorer, sample_rows, smallest, train
from citegrain.llm.quality_rules import SYMBOLS, WORD, duplicate_lines, repeated_words

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with be at this by an from or have not "
    "der die das und ist nicht von zu mit ein eine den auf für im dem des sich als auch "
    "le la les de des et un une du est en que qui pour dans par sur au il elle "
    "el los las y del se por con una su para es al lo como o".split()
)
LABELLERS = (
    "symbols", "capitals", "repeats", "echoes", "lines", "stop_words", "marks", "word_length", "size",
)


def votes(text: str) -> tuple[int, ...]:
    """1 good, -1 bad, 0 nothing, by labeller; a text without words only gets a bad size."""
    words = WORD.findall(text)
    n = len(words)
    if not n:
        return (0,) * (len(LABELLERS) - 1) + (-1,)
    lines = text.count("\n") + 1
    shares = (
        (sum(map(text.count, SYMBOLS)) / n, 0.05, 0.2),
        (sum(w.isupper() and len(w) > 1 for w in words) / n, 0.1, 0.5),
        (repeated_words(words) / n, 0.2, 0.5),
        (sum(map(eq, words, words[1:])) / n, 0.03, 0.2),
        (duplicate_lines(text) / lines, 0.1, 0.4),
    )
    found = [1 if share < low else -1 if share > high else 0 for share, low, high in shares]
    if lines < 3:
        found[4] = 0
    known = sum(map(STOP_WORDS.__contains__, words)) / n
    found.append(1 if known > 0.08 else -1 if known < 0.03 and n >= 20 else 0)
    marks = text.count("!!") / n
    found.append(1 if marks < 0.02 else -1 if marks > 0.2 else 0)
    mean = sum(map(len, words)) / n
    found.append(1 if 3 <= mean <= 8 else -1 if not 2 <= mean <= 14 else 0)
    found.append(1 if n >= 50 else 0)
    return tuple(found)


@dataclass
class LabelModel:
    """Share of good documents; chances[labeller, vote + 1, class] with class 1 the good one.

    A labeller that does not vote says nothing about the document.
    """

    prior: float
    chances: np.ndarray

    @property
    def accuracy(self) -> np.ndarray:
        """Share of right votes among the votes of each labeller."""
        mass = np.array([1 - self.prior, self.prior])
        right = self.chances[:, 0, 0] * mass[0] + self.chances[:, 2, 1] * mass[1]
        return right / ((self.chances[:, 0] + self.chances[:, 2]) @ mass)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance of the good class for each row of votes."""
        logs = np.log(self.chances)[np.arange(patterns.shape[1]), patterns + 1]
        logs = (logs * (patterns != 0)[:, :, None]).sum(axis=1)
        odds = logs[:, 1] - logs[:, 0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """EM over vote patterns: each labeller has a chance of every vote in either class.

    It starts from calling a document bad on more bad votes than a ninth of its votes; one
    pseudo-document in a thousand smooths every chance.
    """
    p = np.where((patterns == -1).sum(axis=1) * 9 > (patterns != 0).sum(axis=1), 0.1, 0.95)
    share = counts / max(1, counts.sum())
    model = LabelModel(0.9, np.full((patterns.shape[1], 3, 2), 1 / 2))
    for _ in range(rounds if len(counts) else 0):
        weight = np.stack([(1 - p) * share, p * share], axis=1)
        seen = np.stack([(patterns == v).T @ weight for v in (-1, 0, 1)], axis=1) + 1e-3 / 2
        chances = seen / (seen[:, :1] + seen[:, 2:])
        model = LabelModel(float(np.clip(weight[:, 1].sum(), 0.01, 0.99)), chances)
        p = model.posterior(patterns)
    return model


def with_votes(documents: DataFrame) -> DataFrame:
    """(pattern, h, key): the votes of each document as digits 0, 1, 2 of a base-3 number, the hash
    of its text (null for none) and a hash of its row."""
    row = document_key(F.col("text"), F.col("doc_id")) if "doc_id" in documents.columns else F.xxhash64("text")
    hashed = documents.select("text", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("h"), row.alias("key"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        cast = np.array([votes(t) for t in texts_of(batch.column("text"))], np.int64)
        code = (cast.reshape(-1, len(LABELLERS)) + 1) @ 3 ** np.arange(len(LABELLERS))
        return pa.RecordBatch.from_arrays([pa.array(code), batch.column("h"), batch.column("key")], ["pattern", "h", "key"])

    return arrow_pass(hashed, step, "pattern long, h long, key long")


def _digits(code: np.ndarray) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


def fit_labels(cast: DataFrame) -> tuple[LabelModel, np.ndarray]:
    """The label model, from the votes on all documents, and all vote patterns."""
    found = cast.groupBy("pattern").count().orderBy("pattern").toArrow()
    patterns = found["pattern"].to_numpy()
    return estimate(_digits(patterns), found["count"].to_numpy()), patterns


def fit(documents: DataFrame, max_rows: int = 2000) -> tuple[LabelModel, Scorer | None]:
    """The label model of all documents, and a scorer from a sample of at most `max_rows` texts.

    Half the sample are texts whose posterior is bad, half such whose posterior is good, each the
    distinct texts of the smallest hashes: however few are bad, and however often a text is copied,
    both are there. Weights give each class its share of all distinct texts again. The scorer is
    None only where no text at all has a bad posterior, or none a good one.
    """
    spark = documents.sparkSession
    with Scratch(spark) as tables:
        cast = tables.keep(with_votes(documents))
        model, patterns = fit_labels(cast)
        y = model.posterior(_digits(patterns)) if len(patterns) else np.zeros(0)
        # an Arrow table needs no Python workers of its own, as rows would
        known = spark.createDataFrame(pa.table({"pattern": pa.array(patterns, pa.int64()), "y": y, "bad": y < 0.5}))
        texts = tables.keep(
            cast.where("h is not null").groupBy("h").agg(F.min("pattern").alias("pattern"), F.min("key").alias("key"))
            .join(F.broadcast(known), "pattern")
        )
        counts = {r.bad: r["count"] for r in texts.groupBy("bad").count().collect()}
        if len(counts) < 2:
            return model, None
        halves = {b: smallest(texts.where(F.col("bad") == b), "h", n, max_rows // 2) for b, n in counts.items()}
        picked = tables.keep(halves[True].unionByName(halves[False]).select("key", "y"))
        taken = {r.bad: r["count"] for r in picked.groupBy((F.col("y") < 0.5).alias("bad")).count().collect()}
        row = document_key(F.col("text"), F.col("doc_id")) if "doc_id" in documents.columns else F.xxhash64("text")
        # rows alike in id and text come once
        labelled = tables.keep(
            documents.select("text", row.alias("key")).join(F.broadcast(picked), "key").dropDuplicates(["key"])
        )
        rows = sample_rows(labelled, "y", max_rows)
        scorer = train(rows, stands_for=tuple(counts[b] / max(1, taken.get(b, 0)) for b in (True, False)))
        del rows
        free_arrow()
    return model, scorer


def judge(documents: DataFrame, scorer: Scorer | None, least: float = 0.5) -> DataFrame:
    """All columns and score and kept, for each row; columns of these names are replaced.

    A text that is null or has no words is not kept. Without a scorer (all documents alike) every
    other text is kept with a null score.
    """
    shared = documents.sparkSession.sparkContext.broadcast(scorer)
    names = [n for n in documents.columns if n not in ("score", "kept")]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, model = texts_of(batch.column("text")), shared.value
        worded = np.array([WORD.search(t) is not None for t in texts])
        p = model.probability([t.encode() for t in texts]) if model else None
        kept = worded if p is None else worded & (p >= least)
        score = pa.nulls(len(texts), pa.float64()) if p is None else pa.array(p)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), score, pa.array(kept)], [*names, "score", "kept"]
        )

    kinds = dict(documents.dtypes)
    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "score double, kept boolean"])
    return arrow_pass(documents.select(*names), step, schema)


def quality_classifier(documents: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """The documents judged by a scorer fitted on `training`, by default on themselves."""
    _, scorer = fit(documents if training is None else training)
    return judge(documents, scorer)
