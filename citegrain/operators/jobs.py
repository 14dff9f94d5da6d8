"""Analysis jobs as an event log: current states, counts, admission and recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------------------
STATUSES = ("queued", "running", "completed", "failed")
PUBLIC_STATUS = {
    "queued": "queued", "running": "processing", "completed": "ready", "failed": "failed",
}
MAX_PENDING = 16
# what each state may follow; None stands for a paper without a job
FOLLOWS = {
    "queued": (None, "failed"),
    "running": ("queued",),
    "completed": ("running",),
    "failed": ("running",),
}
# ---------------------------------------------------------------------------------------


def status_counts(states: DataFrame) -> DataFrame:
    """One row with a count for each of the four statuses."""
    return states.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def public_status(status: Column) -> Column:
    found = F.lit("uploaded")
    for internal, shown in PUBLIC_STATUS.items():
        found = F.when(status == internal, shown).otherwise(found)
    return found


def papers_with_jobs(papers: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each paper with its job, if it has one, and the status shown to callers."""
    return papers.join(jobs, "paper_id", "left").withColumn(
        "public_status", public_status(F.col("status"))
    )


def enqueue(
    requests: DataFrame, papers: DataFrame, jobs: DataFrame, max_pending: int = MAX_PENDING
) -> DataFrame:
    """Decide every analysis request: unknown paper, already scheduled, queued or refused
    because the backlog is full. New and failed papers need a slot, in request order."""
    pending = jobs.where(F.col("status").isin("queued", "running")).agg(
        F.count("*").alias("pending")
    )
    free = max(0, max_pending - pending.first()["pending"])
    known = papers.select("paper_id", F.lit(True).alias("known"))
    judged = (
        requests.groupBy("paper_id").agg(F.min("at").alias("at"))
        .join(known, "paper_id", "left")
        .join(jobs.select("paper_id", "status"), "paper_id", "left")
        .withColumn(
            "needs_slot",
            F.coalesce("known", F.lit(False))
            & (F.col("status").isNull() | (F.col("status") == "failed")),
        )
    )
    # the backlog is bounded, so the admitted rows are too: a top-k without a full sort
    admitted = (
        judged.where("needs_slot").orderBy("at", "paper_id").limit(free)
        .select("paper_id", F.lit(True).alias("admitted"))
    )
    outcome = (
        F.when(F.col("known").isNull(), "unknown_paper")
        .when(~F.col("needs_slot"), F.col("status"))
        .when(F.coalesce("admitted", F.lit(False)), "queued")
        .otherwise("queue_full")
    )
    return judged.join(F.broadcast(admitted), "paper_id", "left").select(
        "paper_id", outcome.alias("outcome"), F.coalesce("admitted", F.lit(False)).alias("scheduled")
    )


def recover(jobs: DataFrame) -> DataFrame:
    """After a restart, interrupted jobs wait in the queue again."""
    return jobs.withColumn(
        "status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status"))
    )
