"""Scores over ranked pages, answers, reviews and timings.

Ratios stay unrounded; a ratio over nothing is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.operators.windows import running_totals

KS = (1, 3, 5, 10)


def rate(passed: Column, among: Column | None = None) -> Column:
    """Share of the rows ``among`` which ``passed``; NULL when there are none."""
    hit = passed.cast("double")
    return F.avg(hit if among is None else F.when(among, hit))


def gold_ranks(pages: DataFrame, gold: DataFrame) -> DataFrame:
    """Rank of the best gold page per question; NULL when none was ranked.

    ``gold`` has one row per (query_id, language, page).
    """
    found = gold.join(pages.select("query_id", "page", "rank"), ["query_id", "page"], "left")
    return found.groupBy("query_id", "language").agg(F.min("rank").alias("gold_rank"))


def retrieval_metrics(ranked: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Recall at k and mean reciprocal rank, overall (language NULL) and per language."""
    hits = [
        F.avg(F.coalesce((F.col("gold_rank") <= k).cast("double"), F.lit(0.0))).alias(
            f"recall_at_{k}"
        )
        for k in ks
    ]
    mrr = F.avg(F.coalesce(1 / F.col("gold_rank"), F.lit(0.0))).alias("mrr")
    sets = ranked.groupingSets([[], [F.col("language")]], F.col("language"))
    return sets.agg(F.count("*").alias("questions"), *hits, mrr)


def paired_units(records: DataFrame, unit: str, *keep: str) -> DataFrame:
    """Fold outputs to units: what all of a unit's outputs do, and what any of them does."""
    flags = ("valid_contract", "final_answer", "final_refusal", "all_required_pages_cited")
    return records.groupBy(unit, "answerability", *keep).agg(
        F.count("*").alias("outputs"),
        *[F.bool_and(F.coalesce(f, F.lit(False))).alias(f"all_{f}") for f in flags],
        *[F.bool_or(F.coalesce(f, F.lit(False))).alias(f"any_{f}") for f in flags],
        F.bool_or(F.col("required_marker_count") > 0).alias("marked"),
        F.bool_and(F.coalesce("all_required_markers_present", F.lit(False))).alias("all_markers"),
        F.count_if(~F.col("valid_contract")).alias("invalid_outputs"),
        F.count_if(F.col("fallback_used")).alias("fallback_outputs"),
    )


def quality_summary(records: DataFrame, unit: str = "meaning_id", by: str | None = None) -> DataFrame:
    """Contract, retention, refusal and citation rates over paired units."""
    keys = [by] if by else []
    units = paired_units(records, unit, *keys)
    kind = F.col("answerability")
    answerable, unsupported = kind == "answerable", kind == "unsupported"
    false_premise, negative = kind == "false_premise", kind != "answerable"
    col = F.col
    return units.groupBy(*keys).agg(
        F.count("*").alias("units"),
        rate(col("all_valid_contract")).alias("valid_final_contract_rate"),
        F.count_if(answerable).alias("answerable_units"),
        rate(col("all_final_answer"), answerable).alias("answerable_retention"),
        rate(col("any_final_refusal"), answerable).alias("false_refusal_rate"),
        F.count_if(unsupported).alias("unsupported_units"),
        rate(col("all_final_refusal"), unsupported).alias("unsupported_final_refusal_rate"),
        F.count_if(false_premise).alias("false_premise_units"),
        rate(col("all_final_refusal"), false_premise).alias("false_premise_final_refusal_rate"),
        rate(col("any_final_answer"), negative).alias("unsupported_answer_rate"),
        rate(col("all_all_required_pages_cited"), answerable).alias("all_required_pages_cited_rate"),
        F.sum("invalid_outputs").alias("invalid_outputs"),
        F.sum("fallback_outputs").alias("fallback_outputs"),
        F.count_if(answerable & col("marked")).alias("marker_checked_units"),
        rate(col("all_markers"), answerable & col("marked")).alias(
            "all_required_markers_present_rate"
        ),
    )


def quality_report(records: DataFrame) -> DataFrame:
    """The rates overall, by split, by language and by question type.

    Languages are reported output by output, all other grains over paired units.
    """
    def grain(name: str, rows: DataFrame, unit: str, by: str | None) -> DataFrame:
        value = F.col(by) if by else F.lit("all")
        found = quality_summary(rows, unit, by)
        return found.select(F.lit(name).alias("grain"), value.alias("value"), *[c for c in found.columns if c != by])

    parts = [
        grain("overall", records, "meaning_id", None), grain("split", records, "meaning_id", "split"),
        grain("language", records, "case_id", "language"),
        grain("question_type", records, "meaning_id", "question_type"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def corpus_summary(records: DataFrame, unit: str = "meaning_id", by: str | None = None) -> DataFrame:
    """Counts over units of a fact-checked run; one overlapping page is a page hit."""
    keys = [by] if by else []
    flags = ("answered", "refused", "all_fact_aliases", "acceptable_source_page_hit")
    units = records.groupBy(unit, "answerability", *keys).agg(
        F.count("*").alias("outputs"),
        F.count_if("contract_valid").alias("contract_valid"),
        *[F.bool_and(f).alias(f"all_{f}") for f in flags],
        F.bool_or("answered").alias("any_answered"),
        F.count_if("fallback_used").alias("fallback_outputs"),
        F.sum("wall_seconds").alias("wall_sum"),
    )
    kind = F.col("answerability")
    positive = kind == "answerable"
    return units.groupBy(*keys).agg(
        F.sum("outputs").alias("language_outputs"),
        F.count("*").alias("meaning_groups"),
        F.sum("contract_valid").alias("contract_valid"),
        F.count_if(positive).alias("answerable_groups"),
        F.count_if(positive & F.col("all_answered")).alias("answerable_retained"),
        F.count_if(positive & F.col("all_all_fact_aliases")).alias("all_fact_aliases"),
        F.count_if(positive & F.col("all_acceptable_source_page_hit")).alias(
            "acceptable_source_page_hit"
        ),
        F.count_if(~positive).alias("negative_groups"),
        F.count_if(~positive & F.col("any_answered")).alias("negative_answers"),
        F.count_if((kind == "unsupported") & F.col("all_refused")).alias("unsupported_refused"),
        F.count_if((kind == "false_premise") & F.col("all_refused")).alias("false_premise_refused"),
        F.sum("fallback_outputs").alias("fallback_outputs"),
        (F.sum("wall_sum") / F.sum("outputs")).alias("mean_wall_seconds"),
    )


def abstention_summary(decisions: DataFrame) -> DataFrame:
    """Correct refusals and retentions per split; ``expected`` is a sufficiency."""
    correct = F.col("actual") == F.col("expected")
    return decisions.groupBy("split").agg(
        F.count("*").alias("total"),
        F.count_if(correct).alias("correct"),
        rate(correct).alias("accuracy"),
    )


def counts_over(df: DataFrame, column: str, domain: tuple[str, ...], name: str) -> DataFrame:
    """Counts for a fixed set of values, zeros included."""
    values = df.sparkSession.createDataFrame([(v,) for v in domain], f"{column} string")
    counted = df.groupBy(column).agg(F.count("*").alias(name))
    return values.join(counted, column, "left").select(
        column, F.coalesce(name, F.lit(0)).alias(name)
    )


def review_summary(reviews: DataFrame) -> DataFrame:
    verdict = F.col("verdict")
    return reviews.agg(
        F.count("*").alias("questions_reviewed"),
        *[F.count_if(verdict == v).alias(v) for v in ("pass", "partial", "fail")],
        rate(verdict == "pass").alias("strict_pass_rate"),
        rate(verdict.isin("pass", "partial")).alias("pass_or_partial_rate"),
        F.count_if("language_match").alias("language_match"),
        F.count_if(F.array_contains("failure_types", "false_abstention")).alias(
            "false_abstentions"
        ),
    )


def nearest_rank(df: DataFrame, keys: list[str], value: str, quantile: float = 0.95) -> DataFrame:
    """Mean, median, nearest-rank percentile and maximum of each key, exact at any size."""
    at, n = F.col("upto_n"), F.col("all_n")
    rows = running_totals(df.withColumn("n", F.lit(1)), keys, value, ["n"])
    pick = lambda place: F.min(F.when(at >= place, F.col(value)))
    low, high = F.floor((n + 1) / 2), F.ceil((n + 1) / 2)
    return rows.groupBy(*keys).agg(
        F.sum("n").alias("samples"),
        (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"),
        ((pick(low) + pick(high)) / 2).alias("median"),
        pick(F.greatest(F.lit(1), F.ceil(F.lit(quantile) * n))).alias("p95"),
        F.max(value).alias("maximum"),
    )


def interpolated(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Linearly interpolated p50 and p95 with count, minimum and maximum."""
    at, n = F.col("upto_n"), F.col("all_n")
    rows = running_totals(df.withColumn("n", F.lit(1)), keys, value, ["n"])
    pick = lambda place: F.min(F.when(at > place, F.col(value)))

    def quantile(q: float) -> Column:
        position = (n - 1) * F.lit(q)
        low, high = pick(F.floor(position)), pick(F.ceil(position))
        return low + (high - low) * F.max(position - F.floor(position))

    return rows.groupBy(*keys).agg(
        F.sum("n").alias("samples"),
        quantile(0.5).alias("p50_seconds"),
        quantile(0.95).alias("p95_seconds"),
        F.min(value).alias("min_seconds"),
        F.max(value).alias("max_seconds"),
    )


def stage_values(results: DataFrame, timings: str = "stage_timings") -> DataFrame:
    """Flatten nested stage timings to ``group.name`` rows, keeping the seconds."""
    groups = results.select("*", F.explode(timings).alias("stage_group", "entries"))
    return groups.select(
        *[c for c in results.columns if c != timings],
        "stage_group",
        F.explode("entries").alias("stage_name", "seconds"),
    ).where(F.col("stage_name").endswith("_seconds")).select(
        *[c for c in results.columns if c != timings],
        F.concat_ws(".", "stage_group", "stage_name").alias("stage"),
        "seconds",
    )


def calibration_rows(rows: DataFrame, split: str = "dev") -> DataFrame:
    """The rows, where all are of the split that thresholds may be chosen on; others are refused.

    A threshold that has seen held-out rows says nothing about them.
    """
    other = rows.where(~F.col("split").eqNullSafe(split)).select("split").first()
    if other is not None:
        raise ValueError(f"thresholds are chosen on {split} rows only, found {other['split']}")
    return rows


def threshold_candidates(
    rows: DataFrame, retention_rows: DataFrame | None = None
) -> DataFrame:
    """All candidate thresholds with the group retention and refusal each one gives.

    ``rows``: meaning_id, answerability, score (nullable), evidence_count, missing. A row
    is accepted when it has evidence, misses no attribute and reaches the threshold. A
    group is then decided by its lowest (retained) or highest (refused) score, so one
    running total over the distinct scores evaluates every threshold.
    """
    infinity = F.lit(float("inf"))
    positive = F.col("answerability") == "answerable"
    hard = (F.coalesce("evidence_count", F.lit(1)) == 0) | F.coalesce("missing", F.lit(False))
    groups = rows.groupBy("meaning_id", "answerability").agg(
        F.min(F.when(hard, -infinity).otherwise(F.coalesce("score", infinity))).alias("lowest"),
        F.max(F.when(hard, -infinity).otherwise(F.coalesce("score", infinity))).alias("highest"),
    )
    # a positive group is lost, a negative group refused, once the threshold passes ``value``
    decided = groups.select(
        F.when(positive, F.col("lowest")).otherwise(F.col("highest")).alias("value"),
        positive.cast("long").alias("positive"),
        (~positive).cast("long").alias("negative"),
        F.lit(0).cast("long").alias("kept"),
    )
    scores = rows.select(F.col("score").alias("value"))
    empty = [F.lit(0).cast("long").alias(c) for c in ("positive", "negative")]
    extra = None
    if retention_rows is not None:
        lost = (F.coalesce("evidence_count", F.lit(1)) == 0) | F.coalesce("missing", F.lit(False))
        extra = retention_rows.select(
            F.when(lost, -infinity).otherwise(F.coalesce("score", infinity)).alias("value"),
            *empty,
            F.lit(1).cast("long").alias("kept"),
        )
        scores = scores.unionByName(retention_rows.select(F.col("score").alias("value")))
    marks = scores.where(F.col("value").isNotNull()).distinct().select(
        "value", *empty, F.lit(0).cast("long").alias("kept")
    )
    events = decided.unionByName(marks)
    if extra is not None:
        events = events.unionByName(extra)
    finite = F.abs(F.col("value")) != infinity
    totals = running_totals(
        events.withColumn("all_rows", F.lit(0)), ["all_rows"], "value",
        ["positive", "negative", "kept"],
    )
    after = F.when(
        F.abs(F.col("next_value")) != infinity, (F.col("value") + F.col("next_value")) / 2
    ).otherwise(F.col("value") + 0.000001)
    point = lambda threshold, minus: [
        threshold.alias("threshold"),
        (1 - F.try_divide(F.col("upto_positive") - minus("positive"), "all_positive")).alias(
            "answerable_group_retention"
        ),
        F.try_divide(F.col("upto_negative") - minus("negative"), "all_negative").alias(
            "unsupported_group_refusal_recall"
        ),
        (F.col("upto_kept") - minus("kept") == 0).alias("additional_retention"),
    ]
    none, own = (lambda name: F.lit(0)), F.col
    lowest = totals.where(finite).agg(F.min("value").alias("lowest_value"))
    first = totals.where(finite).join(F.broadcast(lowest), F.col("value") == F.col("lowest_value"))
    return totals.where(finite).select(*point(after, none)).unionByName(
        first.select(*point(F.col("value") - 0.000001, own))
    )


def select_threshold(candidates: DataFrame, minimum_retention: float = 0.95) -> DataFrame:
    """The strictest of the thresholds with the most refusals that retain enough; no row
    when none does."""
    if not 0 < minimum_retention <= 1:
        raise ValueError("the retention constraint must lie in (0, 1]")
    eligible = (F.col("answerable_group_retention") >= minimum_retention) & F.col(
        "additional_retention"
    )
    order = ("unsupported_group_refusal_recall", "threshold", "answerable_group_retention")
    best = candidates.where(eligible).agg(F.max(F.struct(*order)).alias("best"))
    return best.where(F.col("best").isNotNull()).select("best.*")


def fact_stated(text: Column, alias: Column) -> Column:
    """Whether a text contains a fact's alias; a bare number must stand alone."""

    def plain(value: Column) -> Column:
        joined = F.regexp_replace(value, r"(?U)(?<=\d)\s*\.\s*(?=\d)", ".")
        return F.regexp_replace(F.translate(F.lower(joined), "–−", "--"), r"(?U)\s+", " ")

    said, wanted = plain(text), plain(alias)
    alone = F.concat(F.lit(r"(?U)(?<![\d.])\Q"), wanted, F.lit(r"\E(?![\d.])"))
    return F.when(wanted.rlike(r"(?U)^[\d,.]+$"), F.rlike(said, alone)).otherwise(
        said.contains(wanted)
    )


def facts_stated(text: Column, facts: Column) -> Column:
    """How many of the facts (each with ``any_of`` aliases) a text states."""
    return F.size(
        F.filter(facts, lambda f: F.exists(f["any_of"], lambda a: fact_stated(text, a)))
    )
