"""What a final output shows, case by case: its identity, contract, citations, refusal and markers.

A case is what was asked and expected, an output what came back. The first broken rule names the
output's error; a broken output neither answers nor refuses, but stays in every denominator. Markers
and aliases say that words occur, never that an answer is right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.functions.text import folded, squeeze
from citegrain.operators.answer import EVIDENCE_ID, HANGUL
from citegrain.operators.metrics import facts_stated
from citegrain.operators.policy import ABSTENTION

# --- fixed values ----------------------------------------------------------------------
# endings that may follow a marker without a blank
PARTICLES = (
    "(?:(?:이었습니다|입니다|이었다|였습니다|이다|이며|이고|인|일|하여|하는|하지|되어|되며|된|한|에서|에게|으로|부터|까지|처럼|보다|"
    "은|는|을|를|이|가|에|로|와|과|도|만|의|개|가지|배|초|명|회|층)(?:는|도|만)?)?"
)
MAXIMUM_ANSWER, MAXIMUM_REASON, MAXIMUM_CITATIONS = 4000, 1000, 5
PLACEHOLDER = "string"
# ---------------------------------------------------------------------------------------

MARKERS = "array<struct<id:string,any_of:array<string>>>"
EVIDENCE = (
    "array<struct<evidence_id:string,page:int,text:string,paper_id:string,chunk_id:string,"
    "locator:struct<chunk_id:string>>>"
)
PAYLOAD = "struct<answer:string,evidence_ids:array<string>,sufficiency:string,abstention_reason:string>"
ANY, EACH = "\u001f", "\u001e"


def final_outputs(records: DataFrame) -> DataFrame:
    """One shape for both kinds of saved outputs, with ``payload``, ``evidence``, ``asked``,
    ``fallback_used`` and ``abstention_source``.

    A public output carries ``response``, ``query``, ``cited_evidence`` and ``pipeline``; an internal
    one its answer, sufficiency and reason as columns, ``question``, ``evidence`` and ``runtime``, and
    cites what its evidence names. An output that is neither has a NULL payload.
    """
    public = F.col("response").isNotNull()
    inner = F.struct(
        F.col("answer"), F.transform("evidence", lambda e: e["evidence_id"]).alias("evidence_ids"),
        F.col("sufficiency"), F.col("abstention_reason"),
    )
    run = F.when(public, F.col("pipeline")).otherwise(F.col("runtime"))
    shape = F.when(public, F.col("response")).when(F.col("evidence").isNotNull(), inner)
    none = F.array().cast(EVIDENCE)
    return records.select(
        "case_id", "paper_id", "runtime_paper_id", "question_language",
        F.when(public, F.col("query")).otherwise(F.col("question")).alias("asked"),
        shape.cast(PAYLOAD).alias("payload"),
        F.coalesce(F.when(public, F.col("cited_evidence")).otherwise(F.col("evidence")), none).alias("evidence"),
        F.coalesce(run["fallback_used"], F.lit(False)).alias("fallback_used"),
        run["abstention_source"].alias("abstention_source"),
    )


def marker_pattern(term: Column) -> Column:
    """A pattern for a folded marker: whole words and numbers, blanks and hyphens alike, Korean
    endings allowed. Of a Korean marker only the stem is looked for."""
    literal = F.concat(F.lit("\\Q"), F.regexp_replace(term, r"[\s-]+", r"\\E[\\s-]*\\Q"), F.lit("\\E"))
    start = F.when(term.rlike(r"^[\p{L}\p{N}]"), r"(?<![\w.])").otherwise("")
    end = (
        F.when(term.rlike(HANGUL), "(?![a-z0-9])")
        .when(term.rlike(r"\p{N}$"), PARTICLES + r"(?!\w|\.\d)")
        .when(term.rlike(r"\p{L}$"), PARTICLES + r"(?!\w)").otherwise("")
    )
    return F.concat(F.lit("(?U)"), start, literal, end)


def marker_terms(markers: Column) -> Column:
    """All alternatives of a row's markers, folded in one pass; to be a column of its own."""
    return folded(F.array_join(F.transform(markers, lambda m: F.array_join(m["any_of"], ANY)), EACH))


def markers_present(said: Column, markers: Column, terms: Column) -> Column:
    """Ids of the markers of which an alternative stands in the folded answer, in given order."""
    found = F.transform(
        markers,
        lambda m, i: F.when(
            F.exists(
                F.split(F.get(F.split(terms, EACH, -1), i), ANY, -1),
                lambda t: (squeeze(t) != "") & F.rlike(said, marker_pattern(squeeze(t))),
            ),
            m["id"],
        ),
    )
    return F.array_compact(found)


def _evidence_error(item: Column, ids: Column, case_paper: Column, runtime_paper: Column, paper: Column) -> Column:
    chunk = F.regexp_extract(item["evidence_id"], r"(?s)^[^-]*-[^-]*-(.*)$", 1)
    own = item["paper_id"].isNull() | item["paper_id"].eqNullSafe(case_paper) | item["paper_id"].eqNullSafe(runtime_paper)
    return (
        F.when(~F.coalesce(item["page"] >= 1, F.lit(False)), "evidence_page")
        .when(~F.coalesce(item["text"].rlike(r"(?U)\S"), F.lit(False)), "evidence_text")
        .when(~own, "evidence_of_other_paper")
        .when(~chunk.startswith(F.concat(paper, F.lit("-"))), "evidence_scope")
        .when(~item["locator"]["chunk_id"].eqNullSafe(chunk), "evidence_locator")
        .when(item["chunk_id"] != chunk, "evidence_chunk")
    )


def _errors() -> list[Column]:
    """The rules in their order; each is NULL unless broken. The last ones look at what was found."""
    c = F.col
    payload = c("payload")
    answer, ids, reason = payload["answer"], payload["evidence_ids"], payload["abstention_reason"]
    enough, short = payload["sufficiency"] == "sufficient", payload["sufficiency"] == "insufficient"
    paper = F.coalesce("runtime_paper_id", "case_paper")
    shown = F.transform("evidence", lambda e: e["evidence_id"])
    written = lambda t: F.coalesce(t.rlike(r"(?U)\S"), F.lit(False))
    broken = lambda test, name: F.when(F.coalesce(test, F.lit(True)), name)
    canonical = F.when(c("language") == "ko", ABSTENTION["ko"]).otherwise(ABSTENTION["en"])
    item_errors = F.array_compact(
        F.transform("evidence", lambda e: _evidence_error(e, ids, c("case_paper"), c("runtime_paper_id"), paper))
    )
    return [
        broken(payload.isNull(), "missing_output"),
        broken(c("paper_id") != paper, "other_paper"),
        broken((c("asked") != c("question")) | (c("question_language") != c("language")), "other_question"),
        broken(~written(answer) | (F.length(answer) > MAXIMUM_ANSWER), "answer_text"),
        broken(answer.rlike(HANGUL) != (c("language") == "ko"), "answer_language"),
        broken(ids.isNull() | F.exists(ids, lambda i: i.isNull()), "citation_list"),
        broken(
            (F.size(ids) > MAXIMUM_CITATIONS) | (F.size(F.array_distinct(ids)) != F.size(ids))
            | F.exists(ids, lambda i: ~i.rlike(EVIDENCE_ID)), "citation_contract",
        ),
        broken(
            (F.size(F.array_distinct(shown)) != F.size(shown)) | (F.size(F.array_except(shown, ids)) > 0)
            | (F.size(F.array_except(ids, shown)) > 0), "unresolved_citations",
        ),
        F.get(item_errors, F.lit(0)),
        F.when(enough & ((F.size(ids) == 0) | reason.isNotNull()), "uncited_answer"),
        F.when(enough & c("folded_answer").isin(*[v.lower() for v in ABSTENTION.values()]), "answer_is_refusal"),
        F.when(
            enough & ((c("folded_answer") == c("folded_question")) | (c("folded_answer") == PLACEHOLDER)), "non_answer"
        ),
        F.when(short & ((F.size(ids) > 0) | ~written(reason) | (F.length(reason) > MAXIMUM_REASON)), "refusal_contract"),
        F.when(short & (F.regexp_replace(answer, r"(?U)^\s+|\s+$", "") != canonical), "other_refusal"),
        broken(~(enough | short), "sufficiency"),
    ]


def inspect_outputs(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row for each case, with what its output shows.

    ``cases`` have case_id, meaning_id, split, language, question_type, answerability, paper_id,
    question, gold_pages and required_markers (MARKERS); ``outputs`` are as ``final_outputs`` gives
    them, at most one a case. A case without output is an invalid one.
    """
    asked = cases.withColumnRenamed("paper_id", "case_paper")
    rows = asked.join(outputs, "case_id", "left").withColumns(
        {
            "folded_answer": squeeze(folded(F.col("payload.answer"))),
            "folded_question": squeeze(folded(F.col("question"))),
            "terms": marker_terms(F.col("required_markers")),
        }
    )
    judged = rows.withColumn("error", F.coalesce(*_errors()))
    valid, pages = F.col("error").isNull(), F.array_distinct(F.transform("evidence", lambda e: e["page"]))
    known = ~F.coalesce(F.col("error").isin("missing_output", "other_paper", "other_question"), F.lit(False))
    required = F.coalesce(F.size("required_markers"), F.lit(0))
    wanted = F.array_distinct("gold_pages")
    final = judged.withColumns(
        {
            "valid_contract": valid,
            "final_answer": valid & (F.col("payload.sufficiency") == "sufficient"),
            "final_refusal": valid & (F.col("payload.sufficiency") == "insufficient"),
            "required_marker_count": F.greatest(required, F.lit(0)),
            "required_markers_present": F.when(
                valid, markers_present(F.col("folded_answer"), F.col("required_markers"), F.col("terms"))
            ),
            "cited_gold": F.when(valid & (F.size("gold_pages") > 0), F.size(F.array_intersect(pages, wanted))),
        }
    )
    marked = F.size("required_markers_present") == F.col("required_marker_count")
    return final.select(
        "case_id", "meaning_id", "split", "language", "question_type", "answerability", "error", "valid_contract",
        F.coalesce("final_answer", F.lit(False)).alias("final_answer"),
        F.coalesce("final_refusal", F.lit(False)).alias("final_refusal"),
        F.coalesce(F.col("cited_gold") == F.size(wanted), F.lit(False)).alias("all_required_pages_cited"),
        (F.col("cited_gold") / F.size("gold_pages")).alias("citation_locator_recall"),
        (known & F.coalesce("fallback_used", F.lit(False))).alias("fallback_used"),
        F.when(known, F.col("abstention_source")).alias("abstention_source"),
        "required_marker_count",
        F.coalesce("required_markers_present", F.array().cast("array<string>")).alias("required_markers_present"),
        F.when(valid & (F.col("required_marker_count") > 0), F.coalesce("final_answer", F.lit(False)) & marked)
        .alias("all_required_markers_present"),
    )


def fact_records(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """Rows for the fact-checked summary: one cited gold page is a hit, every fact needs an alias.

    ``cases`` also have required_facts (arrays of aliases as ``any_of``), ``outputs`` wall_seconds.
    """
    seen = inspect_outputs(cases, outputs).select("case_id", "valid_contract", "final_answer", "final_refusal", "fallback_used")
    rows = (
        cases.select("case_id", "meaning_id", "split", "language", "answerability", "gold_pages", "required_facts")
        .join(outputs.select("case_id", "payload", "evidence", "wall_seconds"), "case_id", "left").join(seen, "case_id")
    )
    hits = F.coalesce(facts_stated(F.col("payload.answer"), F.col("required_facts")), F.lit(0))
    count = F.greatest(F.size("required_facts"), F.lit(0))
    pages = F.transform("evidence", lambda e: e["page"])
    return rows.select(
        "case_id", "meaning_id", "split", "language", "answerability", F.col("valid_contract").alias("contract_valid"),
        F.col("final_answer").alias("answered"), F.col("final_refusal").alias("refused"),
        F.greatest(hits, F.lit(0)).alias("fact_alias_hits"), count.alias("required_fact_count"),
        (F.col("final_answer") & (count > 0) & (hits == count)).alias("all_fact_aliases"),
        (F.col("final_answer") & F.coalesce(F.arrays_overlap(pages, "gold_pages"), F.lit(False)))
        .alias("acceptable_source_page_hit"),
        "fallback_used", F.coalesce("wall_seconds", F.lit(0.0)).alias("wall_seconds"),
    )
