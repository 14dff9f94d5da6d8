"""Continuous ingestion: new page files become pages and chunks exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citegrain import schemas
from citegrain.operators.ingest import CHUNK_OVERLAP, CHUNK_SIZE, ingest


def ingest_files(
    spark: SparkSession,
    inbox: str,
    output: str,
    checkpoint: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Ingest JSON Lines of extracted pages as they arrive; a file holds whole papers.

    Every micro-batch overwrites its own ``batch`` partition, so a batch replayed after a
    restart replaces itself, and the checkpoint remembers which files are done.
    """
    raw = (
        spark.readStream.schema(schemas.RAW_PAGE)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(inbox)
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        made = ingest(batch, size, overlap)
        for name in ("pages", "chunks", "papers"):
            getattr(made, name).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("batch").parquet(f"{output}/{name}")

    return (
        raw.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
