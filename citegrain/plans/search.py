"""From questions and chunks to reranked candidates, evidence and their signals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.operators import evidence, retrieve
from citegrain.operators.index import (
    Encoder, TermIndex, build_index, encode_passages, encode_questions,
)
from citegrain.operators.windows import ASK
from citegrain.session import checkpoint, hinted


@dataclass(frozen=True)
class SearchPolicy:
    source_k: int = retrieve.SOURCE_K
    candidate_k: int = retrieve.CANDIDATE_K
    rrf_k: int = retrieve.RRF_K
    front_matter_page: int = 1
    evidence: evidence.EvidencePolicy = evidence.EvidencePolicy()

    def __post_init__(self) -> None:
        if self.candidate_k < self.evidence.top_k:
            raise ValueError("candidate_k must be at least the number of evidence items")
        if self.source_k <= 0:
            raise ValueError("source_k must be positive")


@dataclass(frozen=True)
class SearchResult:
    bm25: DataFrame
    dense: DataFrame
    pool: DataFrame
    candidates: DataFrame
    selection: DataFrame
    evidence: DataFrame


def unknown_papers(asks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Questions whose paper has no chunks; a run should reject these."""
    return asks.join(chunks.select("paper_id").distinct(), "paper_id", "left_anti")


def search(
    asks: DataFrame,
    chunks: DataFrame,
    index: TermIndex | None = None,
    vectors: DataFrame | None = None,
    encoder: Encoder | None = None,
    scorer: retrieve.Scorer = retrieve.lexical_scorer,
    policy: SearchPolicy = SearchPolicy(),
    known_only: bool = False,
) -> SearchResult:
    """Retrieve, fuse, guard the front page, rerank and select, for all questions.

    With ``known_only`` a question about a paper without chunks is an error; else it finds
    nothing and is refused later.
    """
    if known_only and (unknown := unknown_papers(asks, chunks).first()) is not None:
        raise ValueError(f"unknown paper: {unknown['paper_id']}")
    index = index or build_index(chunks)
    vectors = vectors if vectors is not None else encode_passages(chunks, encoder)
    bm25 = retrieve.bm25_top_k(index, chunks, asks, policy.source_k)
    # counts of hashed tokens: a chunk that shares no slot with the question is not found by them
    dense = retrieve.dense_top_k(
        vectors, encode_questions(asks, encoder), policy.source_k, overlapping=encoder is None
    )
    fused = checkpoint(
        retrieve.rerank_pool({"bm25": bm25, "dense": dense}, mode="source_union", rrf_k=policy.rrf_k)
    )
    # at most 2 * source_k rows per question meet the chunk table once, for page and text
    pool = with_chunks(fused, chunks)
    guarded = retrieve.ensure_page(pool, policy.front_matter_page, policy.candidate_k)
    ranked = retrieve.rerank(
        guarded.join(asks.select(*ASK, "question"), list(ASK)), scorer, policy.candidate_k
    )
    chosen = evidence.select(ranked, policy.evidence)
    return SearchResult(bm25, dense, pool, ranked, chosen, evidence.evidence(chosen))


def with_chunks(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    detail = chunks.select(
        "paper_id", "chunk_id", "page", "source_page_id", "section", "section_index",
        "chunk_index", "text",
    )
    return hinted(ranked, 20_000)(ranked).join(detail, ["paper_id", "chunk_id"])
