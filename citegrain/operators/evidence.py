"""Diverse evidence from reranked candidates, and context windows around it.

The choice is order-dependent, so each question's candidates (at most the rerank pool)
are folded in order inside one row; nothing is exchanged after they are gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrain.functions import questions
from citegrain.functions.text import (
    SENTENCE_GAP, fact_tokens, jaccard, let, merge_overlap, plain_tokens, shingles,
)
from citegrain.operators.windows import ASK, gathered

# --- fixed values ----------------------------------------------------------------------
CONTINUED_CUE = (
    r"\b(?:because|due to|reason\w*|issue\w*|conjectur\w*|caus\w*|therefore|means?|defined?"
    r"|refers?)\b"
)
CONTEXT_ONLY = "prediction_task"
MAX_CONTINUATIONS = 2
# ---------------------------------------------------------------------------------------

INTS = "array<int>"


@dataclass(frozen=True)
class EvidencePolicy:
    top_k: int = 5
    max_per_page: int = 2
    near_duplicate: float = 0.85

    def __post_init__(self) -> None:
        if self.top_k <= 0 or self.max_per_page <= 0 or not 0 <= self.near_duplicate <= 1:
            raise ValueError("top_k and max_per_page must be positive, the threshold in [0, 1]")


def _insert(order: Column, item: Column, after: Column) -> Column:
    """Move ``item`` to right behind the first ``after`` of the other entries."""
    rest = F.array_remove(order, item)
    return F.concat(
        F.slice(rest, F.lit(1), after), F.array(item), F.slice(rest, after + 1, F.size(rest))
    )


def _behind(order: Column, item: Column, anchor: Column) -> Column:
    return let(
        F.array_position(F.array_remove(order, item), anchor).cast("int"),
        lambda place: _insert(order, item, place),
    )


def _described(candidates: DataFrame) -> DataFrame:
    """Per-candidate facts the fold compares, computed as plain columns."""
    text = F.col("text")
    pieces = F.split(text, SENTENCE_GAP, -1)
    tail = F.element_at(pieces, -1)
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    words = plain_tokens(text)
    return candidates.withColumns(
        {
            "aspects": questions.aspects(F.col("question")),
            "kinds": questions.kinds(F.col("question")),
            "words": words,
        }
    ).withColumns(
        {
            "shown": questions.aspects_in_source(F.col("aspects"), text),
            "shingle_set": shingles(F.col("words")),
            "plain": F.array_join("words", " "),
            "facts": fact_tokens(text),
            "cut_off": ~tail.rlike(r"(?U)[.!?]\s*$") & questions.matches(tail, CONTINUED_CUE),
            "ending": F.when(F.length(trimmed) >= 40, F.right(trimmed, F.lit(40))),
            "opening": F.left(text, F.lit(300)),
        }
    )


def gather(candidates: DataFrame) -> DataFrame:
    """One row per question: ``items`` in candidate order, with places 1..n."""
    described = _described(candidates)
    keys = (*ASK, "question", "aspects", "kinds", "words")
    fields = [c for c in described.columns if c not in keys and c != "rank"]
    return (
        described.groupBy(*ASK, "question")
        .agg(
            gathered("rank", *fields).alias("items"),
            F.any_value("aspects").alias("aspects"),
            F.any_value("kinds").alias("kinds"),
        )
        .withColumn("places", F.sequence(F.lit(1), F.size("items")))
    )


def select(candidates: DataFrame, policy: EvidencePolicy = EvidencePolicy()) -> DataFrame:
    """One row per question with the chosen items, the counters and the applied policy."""
    k = policy.top_k
    items = F.col("items")
    item = lambda place: F.element_at(items, place)
    rows = gather(candidates)

    # 1. a cut-off causal or defining chunk pulls its continuation right behind it
    follows = F.exists("kinds", lambda kind: kind.isin("causal", "definition"))
    continuation = lambda anchor: F.get(
        F.filter(
            "places",
            lambda p: (item(p)["page"] == anchor["page"])
            & (item(p)["section_index"] == anchor["section_index"])
            & (item(p)["chunk_index"] == anchor["chunk_index"] + 1)
            & item(p)["opening"].contains(anchor["ending"]),
        ),
        F.lit(0),
    )
    rows = rows.withColumn(
        "followers",
        F.transform(
            F.slice(items, 1, k),
            lambda anchor, i: F.struct(
                (i + 1).alias("anchor"),
                F.when(follows & anchor["cut_off"], continuation(anchor)).alias("next"),
            ),
        ),
    ).withColumn(
        "moved",
        F.aggregate(
            "followers",
            F.struct(F.col("places").alias("order"), F.array().cast(INTS).alias("taken")),
            lambda state, f: F.when(
                f["next"].isNotNull() & (F.size(state["taken"]) < MAX_CONTINUATIONS),
                F.struct(
                    _behind(state["order"], f["next"], f["anchor"]).alias("order"),
                    F.array_union(state["taken"], F.array(f["next"])).alias("taken"),
                ),
            ).otherwise(state),
        ),
    )

    # 2. aspects asked for but missing among the first k reserve a slot behind the best
    shows = lambda place, name: F.array_contains(item(place)["shown"], name)
    order = F.col("moved.order")
    wanted = F.array_remove("aspects", CONTEXT_ONLY)
    rows = rows.withColumn(
        "reserved",
        F.array_distinct(
            F.array_compact(
                F.transform(
                    F.filter(
                        wanted,
                        lambda name: ~F.exists(F.slice(order, 1, k), lambda p: shows(p, name)),
                    ),
                    lambda name: F.get(F.filter(order, lambda p: shows(p, name)), F.lit(0)),
                )
            )
        ),
    ).withColumn(
        "order",
        F.aggregate(
            F.slice("reserved", 1, k - 1) if k > 1 else F.array().cast(INTS),
            F.struct(order.alias("order"), F.lit(0).alias("at")),
            lambda state, p: F.struct(
                _insert(state["order"], p, state["at"] + 1).alias("order"),
                (state["at"] + 1).alias("at"),
            ),
            lambda state: state["order"],
        ),
    )

    # 3. scan in order; duplicates are judged against what was selected so far
    cap = F.when(F.size("kinds") > 0, F.lit(k)).otherwise(F.lit(policy.max_per_page))
    rows = rows.withColumn("page_cap", cap).withColumn("scan", _scan(items, policy))

    # 4. at most one plain task definition joins as extra context
    picked = F.col("scan.picked")
    task = lambda place: shows(place, F.lit(CONTEXT_ONLY))
    needs = (
        F.array_contains("aspects", CONTEXT_ONLY)
        & (F.size(picked) > 0)
        & ~F.exists(picked, task)
    )
    supplement = F.filter("places", lambda p: ~F.array_contains(picked, p) & task(p))
    names = lambda places: F.transform(places, lambda p: item(p)["chunk_id"])
    return rows.select(
        *ASK,
        "question",
        F.size(items).alias("input_candidates"),
        F.array_max(F.transform(items, lambda x: x["reranker_score"])).alias("top_reranker_score"),
        F.transform(picked, item).alias("selected"),
        F.when(needs, F.get(F.transform(supplement, item), F.lit(0))).alias("supplement"),
        F.col("scan.duplicate_chunk_id").alias("duplicate_chunk_id"),
        F.col("scan.duplicate_text").alias("duplicate_text"),
        F.col("scan.near_duplicate").alias("near_duplicate"),
        F.col("scan.page_cap").alias("page_cap"),
        F.col("page_cap").alias("effective_max_per_page"),
        "kinds",
        F.sort_array(names(F.col("moved.taken"))).alias("continuations"),
        names(F.col("reserved")).alias("reserved"),
    )


def _scan(items: Column, policy: EvidencePolicy) -> Column:
    item = lambda place: F.element_at(items, place)
    counters = ("duplicate_chunk_id", "duplicate_text", "near_duplicate", "page_cap")

    def verdict(state: Column, x: Column) -> Column:
        prior = lambda test: F.exists(state["picked"], lambda p: test(item(p)))
        same_facts = lambda y: y["facts"] == x["facts"]
        on_page = F.filter(state["picked"], lambda p: item(p)["page"] == x["page"])
        return (
            F.when(F.array_contains(state["seen"], x["chunk_id"]), "duplicate_chunk_id")
            .when(prior(lambda y: same_facts(y) & (y["plain"] == x["plain"])), "duplicate_text")
            .when(
                prior(
                    lambda y: same_facts(y)
                    & (jaccard(x["shingle_set"], y["shingle_set"]) >= policy.near_duplicate)
                ),
                "near_duplicate",
            )
            .when(F.size(on_page) >= F.col("page_cap"), "page_cap")
            .otherwise("pick")
        )

    def step(state: Column, place: Column) -> Column:
        advance = lambda found: F.struct(
            F.when(found == "pick", F.concat(state["picked"], F.array(place)))
            .otherwise(state["picked"])
            .alias("picked"),
            F.concat(state["seen"], F.array(item(place)["chunk_id"])).alias("seen"),
            *[(state[c] + (found == c).cast("int")).alias(c) for c in counters],
        )
        return F.when(
            F.size(state["picked"]) < policy.top_k, let(verdict(state, item(place)), advance)
        ).otherwise(state)

    start = F.struct(
        F.array().cast(INTS).alias("picked"),
        F.array().cast("array<string>").alias("seen"),
        *[F.lit(0).alias(c) for c in counters],
    )
    return F.aggregate("order", start, step)


def evidence(selection: DataFrame, with_supplement: bool = True) -> DataFrame:
    """Evidence objects, one row each; a supplement follows the selected ones."""
    extra = F.when(F.col("supplement").isNotNull(), F.array("supplement")).otherwise(
        F.slice("selected", 1, 0)
    )
    listed = F.concat("selected", extra) if with_supplement else F.col("selected")
    rows = selection.select(
        *ASK, "question", F.size("selected").alias("n"), F.posexplode(listed).alias("i", "c")
    )
    c, rank = F.col("c"), (F.col("i") + 1)
    section = c["section"]
    return rows.select(
        *ASK,
        "question",
        F.format_string("ev-%02d-%s", rank, c["chunk_id"]).alias("evidence_id"),
        rank.alias("rank"),
        (F.col("i") >= F.col("n")).alias("supplemental"),
        c["page"].alias("page"),
        section.alias("section"),
        c["chunk_id"].alias("chunk_id"),
        F.coalesce(
            c["source_page_id"], F.format_string("%s-p%03d", F.col("paper_id"), c["page"])
        ).alias("source_page_id"),
        c["text"].alias("text"),
        F.length(c["text"]).alias("char_count"),
        F.struct(
            F.concat(F.lit("p. "), c["page"].cast("string")).alias("page_label"),
            section.alias("section"),
            c["chunk_id"].alias("chunk_id"),
        ).alias("locator"),
        F.struct(
            c["reranker_score"].alias("reranker"),
            c["retrieval_score"].alias("hybrid"),
            c["pre_rerank_rank"].alias("pre_rerank_rank"),
            c["source_ranks"].alias("source_ranks"),
        ).alias("scores"),
        F.struct(
            F.coalesce(c["section_index"], F.lit(0)).alias("section_index"),
            F.coalesce(c["chunk_index"], F.lit(0)).alias("chunk_index"),
        ).alias("source"),
    )


def candidate_rows(reranked: DataFrame) -> DataFrame:
    """The reportable form of candidates, with a 300-character excerpt."""
    return reranked.select(
        *ASK,
        F.col("rank").alias("candidate_rank"),
        "chunk_id",
        "page",
        "section",
        "source_page_id",
        F.left("text", F.lit(300)).alias("text_excerpt"),
        "reranker_score",
        F.col("retrieval_score").alias("hybrid_score"),
        "pre_rerank_rank",
        "source_ranks",
    )


def neighbours(chunks: DataFrame) -> DataFrame:
    """Previous and next chunk in the same page and section."""
    window = Window.partitionBy("paper_id", "page", "section_index", "section").orderBy(
        "chunk_index", "chunk_id"
    )
    near = {}
    for name, step in (("previous", F.lag), ("next", F.lead)):
        near[f"{name}_id"] = step("chunk_id").over(window)
        near[f"{name}_text"] = step("text").over(window)
    return chunks.withColumns(near)


def context_windows(evidence_rows: DataFrame, chunks: DataFrame, max_chars: int = 3200) -> DataFrame:
    """Extend evidence by one chunk on either side where the merged text still fits.

    Only the pages that hold evidence are read from the chunk table.
    """
    pages = evidence_rows.select("paper_id", "page").distinct()
    around = neighbours(chunks.join(pages, ["paper_id", "page"], "left_semi")).select(
        "paper_id", "chunk_id", F.col("text").alias("own_text"), "previous_id", "previous_text",
        "next_id", "next_text",
    )
    joined = evidence_rows.join(around, ["paper_id", "chunk_id"], "left")
    fits = lambda text: F.length(text) <= max_chars
    intact = F.col("own_text") == F.col("text")
    with_previous = F.when(
        intact & F.col("previous_id").isNotNull(), merge_overlap(F.col("previous_text"), F.col("text"))
    )
    first = joined.withColumn("_p", with_previous).withColumn(
        "_base", F.when(fits(F.col("_p")), F.col("_p")).otherwise(F.col("text"))
    )
    with_next = F.when(
        intact & F.col("next_id").isNotNull(), merge_overlap(F.col("_base"), F.col("next_text"))
    )
    second = first.withColumn("_n", with_next)
    sources = F.array_compact(
        F.array(
            F.when(fits(F.col("_p")), F.col("previous_id")),
            F.col("chunk_id"),
            F.when(fits(F.col("_n")), F.col("next_id")),
        )
    )
    window = F.when(fits(F.col("_n")), F.col("_n")).otherwise(F.col("_base"))
    return second.select(
        *[c for c in evidence_rows.columns if c != "text"],
        window.alias("text"),
        sources.alias("source_chunk_ids"),
        F.when(F.size(sources) > 1, F.sha2(window, 256)).alias("window_sha256"),
    )


def retrieval_signals(selection: DataFrame) -> DataFrame:
    return selection.select(
        *ASK,
        F.col("input_candidates").alias("candidate_count"),
        F.size("selected").alias("evidence_count"),
        "top_reranker_score",
    )
