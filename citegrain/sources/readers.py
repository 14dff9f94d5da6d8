"""Readers for papers, record files, manifests and cached vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegrain import schemas
from citegrain.operators.ingest import chunk_text
from citegrain.sources.writers import current_version

# --- fixed values ----------------------------------------------------------------------
MAX_UPLOAD_BYTES = 20 * 1024 * 1024
PDF_MAGIC = b"%PDF-"
UPLOAD_TYPES = ("application/pdf", "application/octet-stream", "")
# ---------------------------------------------------------------------------------------

# bytes of one file -> pages, each (text, layout text or None); errors of a single page are
# raised by its own thunk, so that one bad page does not lose the others
Extractor = Callable[[bytes], list[Callable[[], tuple[str, str | None]]]]


def plain_text_pages(content: bytes) -> list[Callable[[], tuple[str, str | None]]]:
    """Text files as papers: form feeds separate pages."""
    pages = content.decode("utf-8").split("\f")
    return [lambda page=page: (page, None) for page in pages]


def read_papers(
    spark: SparkSession, folder: str, extract: Extractor = plain_text_pages,
    pattern: str = "paper-*",
) -> DataFrame:
    """One row per page of every file that matches; an unreadable file gives one row with
    an error and no page. Files are read where they lie, one task per split."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true").load(folder)
    )
    named = files.select(
        F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("paper_id"), "content"
    )

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["paper_id", "page", "raw_text", "layout_text", "error"]
        for batch in batches:
            rows = []
            for paper, content in zip(batch["paper_id"], batch["content"]):
                try:
                    found = extract(content)
                except Exception as error:  # noqa: BLE001 - any unreadable file is reported
                    rows.append((paper, None, None, None, f"{type(error).__name__}: {error}"))
                    continue
                for number, page in enumerate(found, 1):
                    try:
                        rows.append((paper, number, *page(), None))
                    except Exception as error:  # noqa: BLE001
                        rows.append((paper, number, None, None, f"{type(error).__name__}: {error}"))
            frame = pd.DataFrame(rows, columns=columns)
            yield frame.astype({"page": "Int32"})

    return named.mapInPandas(pages, schemas.RAW_PAGE)


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON Lines with a declared schema; blank lines are skipped, a broken line fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_records_tolerant(
    spark: SparkSession, path: str, schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """(good records, lines that are not valid records); a byte order mark is allowed."""
    lines = spark.read.text(path).select(
        F.regexp_replace("value", "^﻿", "").alias("line"), F.col("_metadata.file_path").alias("file")
    ).where(F.trim("line") != "")
    wanted = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    parsed = lines.withColumn("r", F.from_json("line", wanted, options))
    good = parsed.where("r._broken IS NULL").select(*[f"r.{f.name}" for f in schema.fields])
    return good, parsed.where("r._broken IS NOT NULL").select("file", "line")


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Whole-file JSON documents."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """CSV paper manifest; a byte order mark before the header is dropped by the reader."""
    rows = spark.read.schema(schemas.MANIFEST).option("header", "true").csv(path)
    return rows.withColumn("page_count", F.col("page_count").cast("int"))


def read_chunks(spark: SparkSession, path: str, paper_id: str | None = None) -> DataFrame:
    """Stored chunks, of the current version where the table was published; a paper is one
    partition, so others are not read."""
    version = current_version(spark, path)
    chunks = spark.read.schema(schemas.CHUNK).parquet(f"{path}/{version}" if version else path)
    return chunks if paper_id is None else chunks.where(F.col("paper_id") == paper_id)


def read_evaluation(
    spark: SparkSession, questions: str, gold: str
) -> tuple[DataFrame, DataFrame]:
    """Questions and gold, one gold row per question; of repeated rows the last line wins."""
    lines = spark.read.schema(schemas.GOLD).json(gold).withColumn(
        "_at",
        # blocks order a file; inside a block the rows of one partition count upwards
        F.struct(
            F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
            F.monotonically_increasing_id(),
        ),
    )
    last = Window.partitionBy("question_id").orderBy(F.desc("_at"))
    rows = lines.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_at", "_n")
    return read_records(spark, questions, schemas.QUESTION), rows


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Name, size and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("name"),
        F.col("length").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


def changed_files(files: DataFrame, frozen: DataFrame) -> DataFrame:
    """Frozen names whose file is gone or has other bytes; ``frozen``: name, sha256."""
    found = files.select("name", F.col("sha256").alias("found"))
    return frozen.join(found, "name", "left").where(~F.col("sha256").eqNullSafe(F.col("found")))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Number of files and their bytes, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("length").agg(
        F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")
    )


def page_documents(documents: DataFrame, split: str = "all") -> DataFrame:
    """Benchmark papers (paper_id, split, source_kind, pages) as chunks with 0-based
    indexes: authored pages are one chunk each, published text is cut."""
    if split != "all":
        documents = documents.where(F.col("split") == split)
    rows = documents.select("paper_id", "source_kind", F.explode("pages").alias("p"))
    published = rows.where(F.col("source_kind") == "publisher_pdf_extracted_text").select(
        "paper_id", "p", chunk_text(F.col("p.text")).alias("texts")
    )
    authored = rows.where(
        ~F.col("source_kind").eqNullSafe(F.lit("publisher_pdf_extracted_text"))
    ).select("paper_id", "p", F.array("p.text").alias("texts"))
    cut = published.unionByName(authored).select("paper_id", "p", F.posexplode("texts").alias("i", "text"))
    page = F.col("p.page")
    return cut.select(
        F.format_string("%s-p%03d-c%03d", "paper_id", page, F.col("i") + 1).alias("chunk_id"),
        "paper_id",
        page.alias("page"),
        F.format_string("%s-p%03d", "paper_id", page).alias("source_page_id"),
        F.col("p.section").alias("section"),
        (page - 1).alias("section_index"),
        F.col("i").alias("chunk_index"),
        "text",
        F.length("text").alias("char_count"),
    )


def upload_problem(filename: Column, content_type: Column, size: Column, content: Column) -> Column:
    """First reason to refuse an uploaded file, or NULL; the order is part of the contract."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(size <= 0, "empty_file")
        .when(size > MAX_UPLOAD_BYTES, "file_too_large")
        .when(~F.lower(filename).endswith(".pdf"), "invalid_file_type")
        .when(~kind.isin(*UPLOAD_TYPES), "invalid_file_type")
        .when(F.substring(content, 1, 5) != F.lit(PDF_MAGIC), "invalid_pdf")
    )
