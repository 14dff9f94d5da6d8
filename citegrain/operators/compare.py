"""Runs against each other and against their gates: what a change of policy gained, lost and moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.operators.metrics import rate
from citegrain.operators.windows import ASK

# --- fixed values: what a smoke run must hold --------------------------------------------
CANDIDATES, EVIDENCE_ITEMS, HEAD = 20, 5, 5
# -----------------------------------------------------------------------------------------


def ranked_changes(before: DataFrame, after: DataFrame, item: str = "chunk_id", head: int = HEAD) -> DataFrame:
    """Every item of two ranked lists of a question, with its change: lost, gained, moved or kept.

    A full outer join of both lists; items beyond ``head`` count as absent from a list, so an item
    that slips out of the head is lost. Items beyond it on both sides are left out.
    """
    side = lambda df, name: df.where(F.col("rank") <= head).select(*ASK, item, F.col("rank").alias(name))
    both = side(before, "old_rank").join(side(after, "new_rank"), [*ASK, item], "full_outer")
    old, new = F.col("old_rank"), F.col("new_rank")
    change = F.when(new.isNull(), "lost").when(old.isNull(), "gained").when(old != new, "moved").otherwise("kept")
    return both.withColumn("change", change)


def run_comparison(changes: DataFrame, versions: tuple[str, str] = ("before", "after")) -> DataFrame:
    """One row over all questions of a comparison: how many changed, by which changes, and what they share."""
    count = lambda name: F.count_if(F.col("change") == name)
    asks = changes.groupBy(*ASK).agg(
        *[count(c).alias(c) for c in ("lost", "gained", "moved", "kept")],
        F.max(F.when((F.col("old_rank") == 1) & (F.col("new_rank") == 1), 1).otherwise(0)).alias("same_first"),
    )
    shared = (F.col("kept") + F.col("moved")) / (F.col("kept") + F.col("moved") + F.col("lost") + F.col("gained"))
    return asks.agg(
        F.count("*").alias("questions"), F.count_if(F.col("lost") + F.col("gained") + F.col("moved") > 0).alias("changed"),
        *[F.sum(c).alias(c) for c in ("lost", "gained", "moved", "kept")],
        F.sum("same_first").alias("same_first"), F.avg(shared).alias("mean_overlap"),
    ).select(F.lit(versions[0]).alias("before"), F.lit(versions[1]).alias("after"), "*")


def gate(name: str, value: Column, threshold: float, at_most: bool = False) -> Column:
    passed = value <= threshold if at_most else value >= threshold
    return F.struct(
        F.lit(name).alias("gate"), value.cast("double").alias("value"), F.lit(float(threshold)).alias("threshold"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
    )


def retrieval_gates(ranked: DataFrame, contracts: DataFrame, gates: dict[str, float]) -> DataFrame:
    """The gates of a frozen retrieval run as rows (gate, value, threshold, passed).

    ``ranked`` has the gold rank of every question (NULL if none was ranked), ``contracts`` whether
    its candidates and evidence are complete. ``gates``: questions, recall_at_5, recall_at_10, mrr
    (least) and lost_top5 (most). An unknown gate is refused.
    """
    known = {"questions", "recall_at_5", "recall_at_10", "mrr", "lost_top5"}
    if unknown := set(gates) - known:
        raise ValueError(f"unknown gates: {sorted(unknown)}")
    rank = F.col("gold_rank")
    within = lambda k: F.avg(F.coalesce((rank <= k).cast("double"), F.lit(0.0)))
    values = {
        "questions": F.count("*"), "recall_at_5": within(5), "recall_at_10": within(10),
        "mrr": F.avg(F.coalesce(1 / rank, F.lit(0.0))), "lost_top5": F.count_if(F.coalesce(rank > 5, F.lit(True))),
    }
    scored = ranked.agg(*[values[g].alias(g) for g in gates])
    rows = scored.select(F.explode(F.array(*[gate(g, F.col(g), t, g == "lost_top5") for g, t in gates.items()])).alias("g"))
    kept = contracts.agg(rate(F.col("complete")).alias("share"))
    return rows.select("g.*").unionByName(kept.select(gate("contract", F.col("share"), 1.0).alias("g")).select("g.*"))


def contracts(candidates: DataFrame, evidence: DataFrame, asks: DataFrame) -> DataFrame:
    """Per question: candidates, evidence items and whether both are as many as a smoke run needs."""
    counted = lambda df, name: df.groupBy(*ASK).agg(F.count("*").alias(name))
    rows = asks.select(*ASK, "language").join(counted(candidates, "candidates"), list(ASK), "left").join(
        counted(evidence, "evidence"), list(ASK), "left"
    ).fillna(0, ["candidates", "evidence"])
    full = (F.col("candidates") == CANDIDATES) & (F.col("evidence") == EVIDENCE_ITEMS)
    return rows.withColumn("complete", full)


def smoke_summary(rows: DataFrame) -> DataFrame:
    """Passed and failed questions, overall (language NULL) and per language."""
    return rows.groupingSets([[], [F.col("language")]], F.col("language")).agg(
        F.count("*").alias("questions"), F.count_if("complete").alias("passed"),
        F.count_if(~F.col("complete")).alias("failed"), F.min("candidates").alias("least_candidates"),
        F.min("evidence").alias("least_evidence"),
    )


def answer_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two versions of the answers over the same evidence: a full outer diff of their payloads.

    Both have ASK, ``payload`` and ``fallback_used``; a question of one version only is told as such.
    """
    side = lambda df, name: df.select(*ASK, F.struct("payload", "fallback_used").alias(name))
    both = side(before, "old").join(side(after, "new"), list(ASK), "full_outer")
    old, new = F.col("old.payload"), F.col("new.payload")
    enough = lambda p: p["sufficiency"] == "sufficient"
    change = (
        F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "added")
        .when(enough(old) & ~enough(new), "now_refused").when(~enough(old) & enough(new), "now_answered")
        .when(~old["evidence_ids"].eqNullSafe(new["evidence_ids"]), "other_citations")
        .when(~old["answer"].eqNullSafe(new["answer"]), "other_text")
        .when(~old["abstention_reason"].eqNullSafe(new["abstention_reason"]), "other_reason").otherwise("same")
    )
    return both.select(*ASK, change.alias("change"), F.coalesce("old.fallback_used", F.lit(False)).alias("old_fallback"),
                       F.coalesce("new.fallback_used", F.lit(False)).alias("new_fallback"))
