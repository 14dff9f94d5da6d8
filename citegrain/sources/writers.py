"""Writers: record files, staged publication, resumable runs and guards."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.operators.ingest import Ingested, ingestion_summary, warning_counts
from citegrain.operators.validate import duplicates
from citegrain.operators.windows import ASK, gathered


class OutputRefused(ValueError):
    """An output path is protected, taken, or the data must not be published."""


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target, jvm


def guard(spark: SparkSession, path: str, protected: tuple[str, ...] = ()) -> None:
    """Refuse to write onto or below protected folders, or over anything that exists."""
    fs, target, jvm = _filesystem(spark, path)
    full = str(fs.makeQualified(target))
    for folder in protected:
        root = str(fs.makeQualified(jvm.org.apache.hadoop.fs.Path(folder)))
        if full == root or full.startswith(root.rstrip("/") + "/"):
            raise OutputRefused(f"protected output: {path}")
    if fs.exists(target):
        raise OutputRefused(f"output exists: {path}")


def write_records(df: DataFrame, path: str) -> None:
    """JSON Lines, Unicode as is."""
    df.write.mode("errorifexists").json(path)


POINTER = "_current"


def publish(df: DataFrame, path: str, format: str = "parquet", partition: str | None = None) -> str:
    """Write a new version folder, then switch the pointer to it by one rename; returns the version.

    Until the switch readers find the version before, afterwards the new one, and never none. The
    version before stays for readers that have just resolved it; older ones are deleted.
    """
    spark = df.sparkSession
    version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    writer = df.write.mode("errorifexists").format(format)
    (writer.partitionBy(partition) if partition else writer).save(f"{path}/{version}")
    before = current_version(spark, path)
    fs, target, jvm = _filesystem(spark, path)
    place = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    # pointers are ordered by the time in their names; the last one that is complete counts
    staged = place(f".{POINTER}-{version}")
    fs.create(staged).close()
    if not fs.rename(staged, place(f"{POINTER}-{version}")):
        raise OutputRefused(f"could not publish {path}")
    for kind in ("", f"{POINTER}-"):
        for status in fs.listStatus(target):
            name = status.getPath().getName()
            if name.startswith(f"{kind}v-") and name.removeprefix(kind) not in (version, before):
                fs.delete(status.getPath(), True)
    return version


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version that the pointers of a published table name last; NULL where there is none."""
    fs, target, _ = _filesystem(spark, path)
    if not fs.exists(target):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(target)]
    versions = sorted(n.removeprefix(f"{POINTER}-") for n in names if n.startswith(f"{POINTER}-v-"))
    return versions[-1] if versions else None


def published(spark: SparkSession, path: str) -> str:
    """The folder of the current version, to be read."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return f"{path}/{version}"


def publish_ingestion(made: Ingested, folder: str) -> None:
    """Pages, then chunks, then the report; nothing is written for no input or when ids
    repeat, so earlier outputs stay."""
    if made.papers.isEmpty():
        raise OutputRefused("no papers found; existing outputs were not written")
    repeated = duplicates(made.chunks, "chunk_id").unionByName(duplicates(made.pages, "page_id"))
    if not repeated.isEmpty():
        raise OutputRefused("repeated chunk or page ids; outputs were not written")
    publish(made.pages, f"{folder}/pages", partition="paper_id")
    publish(made.chunks, f"{folder}/chunks", partition="paper_id")
    publish(made.papers, f"{folder}/papers")
    publish(warning_counts(made.warnings), f"{folder}/warning_counts")
    publish(ingestion_summary(made.papers), f"{folder}/summary", "json")


def search_results(ranked: DataFrame, retriever: str, config: Column) -> DataFrame:
    """One nested record per question with its ranked results, ready for JSON."""
    fields = [
        c for c in ("score", "chunk_id", "page", "section", "text", "source_ranks",
                    "pre_rerank_rank", "retrieval_score", "reranker_score")
        if c in ranked.columns
    ]
    return ranked.groupBy(*ASK, "question").agg(gathered("rank", *fields).alias("results")).select(
        F.lit(retriever).alias("retriever"), *ASK, "question", config.alias("config"), "results"
    )


def remaining(cases: DataFrame, done: DataFrame, key: str = "case_id") -> DataFrame:
    """Cases a resumed run still has to answer."""
    return cases.join(done.select(key).distinct(), key, "left_anti")


def append_results(results: DataFrame, path: str, key: str = "case_id") -> None:
    """Append what is not stored yet, so that a repeated run changes nothing."""
    spark = results.sparkSession
    fs, target, _ = _filesystem(spark, path)
    fresh = remaining(results, spark.read.parquet(path), key) if fs.exists(target) else results
    fresh.write.mode("append").parquet(path)


def performance_table(rows: DataFrame, path: str) -> None:
    """The short fixed-order metric table as one CSV file with a header."""
    columns = ("metric", "value", "unit", "scope", "source")
    rows.select(*columns).coalesce(1).write.mode("errorifexists").option("header", "true").option(
        "lineSep", "\n"
    ).csv(path)
