"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.llm import (
    bpe, centroids, decontaminate, license_scan, line_dedup, ngram_jaccard, quality_rules, secret_scan, simhash_tiles,
    token_counts, url_filter, weak_labels, whitening,
)
from citegrain.llm.common import table

VOCABULARY = "byte_bpe_50k.json"


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    judged = weak_labels.quality_classifier(
        table(spark, folder, "documents").select("doc_id", "text")
    )
    return judged.select("doc_id", "score", "kept")


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.overlaps(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    ).drop("doc_key")


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, folder, "pages"))


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digests(table(spark, folder, "documents"))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(
        table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY)
    )


def op9_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(table(spark, folder, "documents"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = line_dedup.line_dedup(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op12_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_tiles.near_duplicates(table(spark, folder, "documents"))


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_license_scan": op4_license_scan,
    "op5_decontamination": op5_decontamination,
    "op6_url_filter": op6_url_filter,
    "op7_secret_scan": op7_secret_scan,
    "op8_token_counts": op8_token_counts,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_line_dedup": op10_line_dedup,
    "op11_whitening": op11_whitening,
    "op12_simhash": op12_simhash,
    "op13_centroids": op13_centroids,
}
ORACLES: dict[str, str] = {
    "op6_url_filter": url_filter.oracle_sql(),
    "op9_ngram_jaccard": ngram_jaccard.oracle_sql(),
    "op13_centroids": centroids.oracle_sql(),
}
