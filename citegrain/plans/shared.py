"""Intermediate tables that several queries of one session read.

Each is declared once per (application, folder) and persisted, so the collection is
chunked, indexed and searched once, however many queries look at the result. Lost blocks
are recomputed from their lineage.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from citegrain.operators import index as indexing
from citegrain.operators.ingest import Ingested
from citegrain.operators.sentences import SentencePolicy
from citegrain.plans import corpora
from citegrain.plans.answer import Answered, answer
from citegrain.plans.search import SearchResult, search

# the driver's texts have no headings, so unclassified body text may be quoted
OPEN_BODY = SentencePolicy(allow_unclassified_body=True)

T = TypeVar("T")
_memo: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, folder: str, name: str, build: Callable[[], T]) -> T:
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _memo:
        _memo[key] = build()
    return _memo[key]  # type: ignore[return-value]


def _kept(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _ingested(raw: Ingested) -> Ingested:
    return Ingested(_kept(raw.pages), _kept(raw.chunks), raw.warnings, raw.papers)


def documents(spark: SparkSession, folder: str) -> Ingested:
    return _once(spark, folder, "documents", lambda: _ingested(corpora.documents(spark, folder)))


def conversations(spark: SparkSession, folder: str) -> Ingested:
    return _once(
        spark, folder, "conversations", lambda: _ingested(corpora.conversations(spark, folder))
    )


def collection(spark: SparkSession, folder: str) -> DataFrame:
    return corpora.as_collection(documents(spark, folder).chunks)


def _index(chunks: DataFrame) -> indexing.TermIndex:
    made = indexing.build_index(chunks)
    return indexing.TermIndex(made.postings, _kept(made.terms), _kept(made.papers))


def collection_index(spark: SparkSession, folder: str) -> indexing.TermIndex:
    return _once(spark, folder, "index", lambda: _index(collection(spark, folder)))


def conversation_index(spark: SparkSession, folder: str) -> indexing.TermIndex:
    return _once(
        spark, folder, "conversation_index", lambda: _index(conversations(spark, folder).chunks)
    )


def collection_search(spark: SparkSession, folder: str) -> SearchResult:
    """Every benchmark question asked of the whole document collection."""

    def build() -> SearchResult:
        chunks = collection(spark, folder)
        found = search(
            corpora.collection_asks(spark, folder), chunks, collection_index(spark, folder)
        )
        return _kept_result(found)

    return _once(spark, folder, "search", build)


def conversation_search(spark: SparkSession, folder: str) -> SearchResult:
    """Every user turn asked of the other turns of its conversation."""

    def build() -> SearchResult:
        found = search(
            corpora.conversation_asks(spark, folder),
            conversations(spark, folder).chunks,
            conversation_index(spark, folder),
        )
        return _kept_result(found)

    return _once(spark, folder, "conversation_search", build)


def collection_answers(spark: SparkSession, folder: str) -> Answered:
    return _once(
        spark, folder, "answers",
        lambda: answer(
            corpora.collection_asks(spark, folder), collection_search(spark, folder),
            sentence_policy=OPEN_BODY,
        ),
    )


def conversation_answers(spark: SparkSession, folder: str) -> Answered:
    return _once(
        spark, folder, "conversation_answers",
        lambda: answer(
            corpora.conversation_asks(spark, folder), conversation_search(spark, folder),
            sentence_policy=OPEN_BODY,
        ),
    )


def _kept_result(found: SearchResult) -> SearchResult:
    candidates, selection = _kept(found.candidates), _kept(found.selection)
    return SearchResult(found.bm25, found.dense, found.pool, candidates, selection, found.evidence)
