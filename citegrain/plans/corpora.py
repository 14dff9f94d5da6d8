"""The driver tables read as papers, pages and questions.

documents      -> pages of the papers named by ``source``; page = doc_id + 1
conversations  -> one paper per conversation; its non-user turns are pages, its user
                  turns are the questions asked of it
benchmark      -> questions asked of all documents at once (paper ``collection``)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.functions.text import plain_tokens
from citegrain.operators.ingest import Ingested, ingest
from citegrain.session import spread_scan

COLLECTION = "collection"
# headings that derived pages open with, by doc_id, and the section some end in
OPENINGS = ("1 Introduction", None, "Abstract", "II. METHODS AND DATA", None, None)
CLOSING = "Conclusion\nClosing words of the page."


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A text table, spread over the cores where the session asks for it."""
    return spread_scan(table(spark, folder, name).select(*columns), columns[0])


def _raw(df: DataFrame) -> DataFrame:
    return df.select(
        "paper_id",
        F.col("page").cast("int").alias("page"),
        "raw_text",
        F.lit(None).cast("string").alias("layout_text"),
        F.lit(None).cast("string").alias("error"),
    )


def document_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _raw(
        texts(spark, folder, "documents", "doc_id", "source", "text").select(
            F.col("source").alias("paper_id"),
            (F.col("doc_id") + 1).alias("page"),
            F.col("text").alias("raw_text"),
        )
    )


def headed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The document pages with headings: every other one opens with one, every fourth ends in
    one more section."""
    rows = texts(spark, folder, "documents", "doc_id", "source", "text")
    opening = F.element_at(
        F.array(*[F.lit(h) for h in OPENINGS]), (F.col("doc_id") % len(OPENINGS) + 1).cast("int")
    )
    closing = F.when(F.col("doc_id") % 4 == 1, F.lit(CLOSING))
    return _raw(
        rows.select(
            F.col("source").alias("paper_id"), (F.col("doc_id") + 1).alias("page"),
            F.concat_ws("\n", opening, "text", closing).alias("raw_text"),
        )
    )


def conversation_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _raw(
        texts(spark, folder, "conversations", "conv_id", "turn", "role", "text")
        .where(F.col("role") != "user")
        .select(
            F.concat(F.lit("conv-"), F.col("conv_id")).alias("paper_id"),
            (F.col("turn") + 1).alias("page"),
            F.col("text").alias("raw_text"),
        )
    )


def documents(spark: SparkSession, folder: str) -> Ingested:
    return ingest(document_pages(spark, folder))


def conversations(spark: SparkSession, folder: str) -> Ingested:
    return ingest(conversation_pages(spark, folder))


def as_collection(chunks: DataFrame) -> DataFrame:
    """All document chunks as one paper; ids still name source and page."""
    return chunks.withColumn("paper_id", F.lit(COLLECTION))


def collection_asks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.lit(COLLECTION).alias("paper_id"),
        F.col("text").alias("question"),
    )


def conversation_asks(spark: SparkSession, folder: str) -> DataFrame:
    """User turns; those of a conversation without other turns find nothing and are refused."""
    turns = table(spark, folder, "conversations")
    return (
        turns.where(F.col("role") == "user")
        .select(
            F.format_string("%d:%d", "conv_id", "turn").alias("query_id"),
            F.concat(F.lit("conv-"), F.col("conv_id")).alias("paper_id"),
            F.col("text").alias("question"),
        )
    )


def passage_gold(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, language, page) for each document that repeats a benchmark passage.

    A passage and a document meet on a hash of up to eight inner tokens, which any verbatim
    copy contains whole, and are then compared in full. A passage too short to have an inner
    token is one run of letters and digits at most; it meets the runs that contain it by the
    hash of the pieces of its length, so no pair is made by a loop over both tables.
    """
    items = table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("passage")
    )
    words = plain_tokens(F.col("passage"))
    keyed = items.withColumn("n", F.least(F.lit(8), F.size(words) - 2)).withColumn(
        "key", F.xxhash64(F.array_join(F.slice(words, F.lit(2), F.greatest("n", F.lit(0))), " "))
    )
    docs = texts(spark, folder, "documents", "doc_id", "lang", "text")
    tokenized = docs.select("doc_id", plain_tokens(F.col("text")).alias("words"))
    long = keyed.where("n > 0")
    runs = (
        tokenized.crossJoin(F.broadcast(_sizes(long, "n")))
        .withColumn("n", F.explode("sizes")).where(F.size("words") >= F.col("n") + 2)
        .select("doc_id", "n", F.explode(_pieces(F.col("words"), F.col("n"))).alias("key"))
    )
    pairs = runs.join(long.select("query_id", "n", "key"), ["n", "key"]).select("query_id", "doc_id").distinct()
    short = keyed.where("n <= 0").withColumn("n", F.length("passage")).withColumn("key", F.xxhash64("passage"))
    letters = F.transform(
        F.sequence(F.lit(1), F.length("text") - F.col("n") + 1),
        lambda i: F.xxhash64(F.substring(F.col("text"), i, F.col("n"))),
    )
    spots = (
        docs.crossJoin(F.broadcast(_sizes(short, "n"))).withColumn("n", F.explode("sizes"))
        .where((F.length("text") >= F.col("n")) & (F.col("n") > 0))
        .select("doc_id", "n", F.explode(F.array_distinct(letters)).alias("key"))
    )
    pairs = pairs.union(
        spots.join(short.select("query_id", "n", "key"), ["n", "key"]).select("query_id", "doc_id").distinct()
    )
    found = (
        pairs.join(docs, "doc_id").join(items, "query_id")
        .where(F.col("text").contains(F.col("passage"))).select("query_id", "lang", "doc_id").distinct()
    )
    first = found.groupBy("query_id").agg(F.min("lang").alias("language"))
    return found.join(first, "query_id").select(
        "query_id", "language", (F.col("doc_id") + 1).cast("int").alias("page")
    )


def _sizes(keyed: DataFrame, column: str) -> DataFrame:
    """One row with the few distinct sizes of the passages."""
    return keyed.agg(F.collect_set(column).alias("sizes"))


def _pieces(words: Column, n: Column) -> Column:
    """Hash of each run of ``n`` inner words."""
    return F.transform(
        F.sequence(F.lit(2), F.size(words) - n),
        lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " ")),
    )
