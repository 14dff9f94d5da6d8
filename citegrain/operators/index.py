"""Term index per paper and passage vectors.

Terms are counted in one pass over the chunks, which shuffles a vocabulary per batch and no
postings. Postings, one row per chunk and term, are made only where they are stored or joined.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.functions.text import token_list, tokens
from citegrain.session import checkpoint, hinted, spread

# --- fixed values: the Okapi weighting -------------------------------------------------
K1, B, NEGATIVE_IDF_SHARE = 1.5, 0.75, 0.25
# ---------------------------------------------------------------------------------------


def term_counts(chunks: DataFrame) -> DataFrame:
    """One row per (paper, chunk, term): frequency and chunk length in tokens."""
    tokenized = spread(chunks.select("paper_id", "chunk_id", "text"), "chunk_id").select(
        "paper_id", "chunk_id", tokens(F.col("text")).alias("tokens")
    )
    return (
        tokenized.select(
            "paper_id", "chunk_id", F.size("tokens").alias("length"),
            F.explode("tokens").alias("term"),
        )
        .groupBy("chunk_id", "paper_id", "length", "term")
        .agg(F.count("*").alias("tf"))
    )


def vocabulary(chunks: DataFrame) -> DataFrame:
    """Chunks of each (paper, term) in one pass over the texts; the row without a term counts all
    chunks of the paper, those without tokens too, and their tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: defaultdict[str, Counter[str | None]] = defaultdict(Counter)
            lengths: Counter[str] = Counter()
            for paper, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                listed = token_list(text)
                found[paper].update({*listed, None})
                lengths[paper] += len(listed)
            for paper, counts in found.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(paper, len(counts)),
                        pa.array(counts.keys(), pa.string()),
                        pa.array(counts.values(), pa.int64()),
                        pa.repeat(pa.scalar(lengths[paper], pa.int64()), len(counts)),
                    ],
                    ["paper_id", "term", "df", "tokens"],
                )

    rows = chunks.select("paper_id", "text")
    partial = rows.mapInArrow(count, "paper_id string, term string, df long, tokens long")
    return partial.groupBy("paper_id", "term").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens"))


def paper_stats(counted: DataFrame) -> DataFrame:
    """Chunks and mean chunk length per paper."""
    return counted.where(F.col("term").isNull()).select(
        "paper_id", F.col("df").alias("chunks"), (F.col("tokens") / F.col("df")).alias("mean_length")
    )


def term_stats(counted: DataFrame, papers: DataFrame) -> DataFrame:
    """Document frequency and inverse document frequency per (paper, term).

    A term found in over half of a paper's chunks would weigh negatively; it gets a fixed
    share of the mean weight over that paper's vocabulary instead.
    """
    # one paper may hold nearly all terms, so a short list of papers is joined where the terms lie
    few = hinted(papers)
    raw = counted.where(F.col("term").isNotNull()).join(few(papers), "paper_id").select(
        "paper_id",
        "term",
        "df",
        (F.ln(F.col("chunks") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw_idf"),
    )
    mean = raw.groupBy("paper_id").agg(F.avg("raw_idf").alias("mean_idf"))
    return raw.join(few(mean), "paper_id").select(
        "paper_id",
        "term",
        "df",
        F.when(F.col("raw_idf") < 0, NEGATIVE_IDF_SHARE * F.col("mean_idf"))
        .otherwise(F.col("raw_idf"))
        .alias("idf"),
    )


@dataclass(frozen=True)
class TermIndex:
    postings: DataFrame
    terms: DataFrame
    papers: DataFrame

    def save(self, path: str, buckets: int = 64) -> None:
        """Store the index; postings stay clustered by chunk, statistics by term."""
        self.postings.repartition(buckets, "chunk_id").write.mode("overwrite").parquet(
            f"{path}/postings"
        )
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.papers.write.mode("overwrite").parquet(f"{path}/papers")


def build_index(chunks: DataFrame) -> TermIndex:
    counted = checkpoint(vocabulary(chunks))
    papers = paper_stats(counted)
    return TermIndex(term_counts(chunks), term_stats(counted, papers), papers)


def load_index(spark: SparkSession, path: str) -> TermIndex:
    return TermIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "papers")))


# --- vectors ---------------------------------------------------------------------------

Encoder = Callable[[Column], Column]
DIMENSIONS = 64
KNOWN_WORDS = 1 << 18  # whose slots a task keeps


def hashing_encoder(dimensions: int = DIMENSIONS) -> Encoder:
    """Deterministic stand-in for an embedding model: hashed token counts, unit length.

    A model plugs in as any function from a text column to an ``array<float>`` column.
    """

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        class Slots(dict):
            def __missing__(self, word: str) -> int:
                if len(self) >= KNOWN_WORDS:
                    self.clear()
                self[word] = slot = int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % dimensions
                return slot

        slots = Slots()  # lives for one task

        def vector(text: str) -> np.ndarray:
            listed = token_list(text)
            hashed = np.fromiter(map(slots.__getitem__, listed), np.int64, len(listed))
            counts = np.bincount(hashed, minlength=dimensions).astype(np.float64)
            norm = np.sqrt(counts @ counts)
            return (counts / norm if norm else counts).astype(np.float32)

        for texts in batches:
            yield texts.map(vector)

    return encode


def encode_passages(chunks: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    encoder = encoder or hashing_encoder()
    return chunks.withColumn("vector", encoder(F.concat(F.lit("passage: "), F.col("text"))))


def encode_questions(asks: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    encoder = encoder or hashing_encoder()
    return asks.withColumn("vector", encoder(F.concat(F.lit("query: "), F.col("question"))))


def fingerprint(chunks: DataFrame) -> DataFrame:
    """Content hash per paper that any order of rows reproduces.

    The eight words of each row's SHA-256 are added up, so partial sums merge and a paper of any
    size is a few numbers; the hash of the sums and the row count is the fingerprint.
    """
    row = F.sha2(F.concat(F.col("chunk_id"), F.lit("\0"), F.col("text"), F.lit("\0")), 256)
    hashed = chunks.select("paper_id", row.alias("h"))
    words = [F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(10,0)") for k in range(8)]
    summed = hashed.groupBy("paper_id").agg(
        *[F.sum(w).cast("decimal(38,0)").alias(f"w{k}") for k, w in enumerate(words)], F.count("*").alias("chunks")
    )
    parts = [F.col(f"w{k}").cast("string") for k in range(8)] + [F.col("chunks").cast("string")]
    return summed.select("paper_id", F.sha2(F.concat_ws(":", *parts), 256).alias("fingerprint"), "chunks")


# a stored vector is found by its encoder and its very text, whatever chunk carries it
VECTOR_KEY = ("encoder", "text_sha")


@dataclass(frozen=True)
class VectorBuild:
    """Chunks with ``vector`` and ``provenance`` (stored, encoded), and what to append to the store."""

    vectors: DataFrame
    additions: DataFrame


def build_vectors(
    chunks: DataFrame, store: DataFrame | None, encoder_name: str, encoder: Encoder | None = None
) -> VectorBuild:
    """Vectors of all chunks: those of known texts from the store, each other text encoded once.

    The store is keyed by the encoder's fingerprint and the SHA-256 of the text, so a renamed chunk
    costs nothing, a changed one is encoded, and another encoder finds nothing.
    """
    keyed = chunks.withColumns({"encoder": F.lit(encoder_name), "text_sha": F.sha2("text", 256)})
    if store is None:
        store = encode_passages(keyed.limit(0), encoder).select(*VECTOR_KEY, "vector")
    # an entry appended twice is one entry
    stored = store.where(F.col("encoder") == encoder_name).dropDuplicates(list(VECTOR_KEY))
    unknown = keyed.join(stored.select(*VECTOR_KEY), list(VECTOR_KEY), "left_anti")
    texts = unknown.select(*VECTOR_KEY, "text").dropDuplicates(list(VECTOR_KEY))
    fresh = checkpoint(encode_passages(texts, encoder).select(*VECTOR_KEY, "vector"))
    tagged = lambda df, name: df.select(*VECTOR_KEY, "vector", F.lit(name).alias("provenance"))
    known = tagged(stored, "stored").unionByName(tagged(fresh, "encoded"))
    return VectorBuild(keyed.join(known, list(VECTOR_KEY)), fresh)


def missing_vectors(
    chunks: DataFrame, cache: DataFrame, model: str, encoder: Encoder | None = None
) -> DataFrame:
    """Vectors for chunks the cache lacks under this model and this very text."""
    keyed = chunks.withColumn("model", F.lit(model)).withColumn("text_sha", F.sha2("text", 256))
    return encode_passages(
        keyed.join(cache.select("model", "chunk_id", "text_sha"), ["model", "chunk_id", "text_sha"], "left_anti"),
        encoder,
    ).select("model", "chunk_id", "text_sha", "paper_id", "page", "vector")
