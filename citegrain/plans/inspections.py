"""Final outputs derived from the labelled documents, and their SQL restatement.

Every labelled document is a case whose output quotes the whole document and cites two pages. Rows
are kept whole; rules are broken by changed values (another paper, a missing citation, a wrong page),
so that every rule fires on some row and holds on most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.operators import inspect
from citegrain.operators.policy import ABSTENTION
from citegrain.plans.corpora import table

COMMON = ("of", "de", "und")
TYPES = ("fact", "numeric", "list", "comparison", "limitation")


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents; forty consecutive ids of one source ask for one meaning."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    rows = docs.join(table(spark, folder, "labels"), "doc_id")
    meaning = F.concat_ws(":", "source", F.floor(F.col("doc_id") / 40).cast("string"))
    kinds = rows.groupBy(meaning.alias("meaning_id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    kind = F.when(F.col("q") == 1, "answerable").when(F.col("t") == 1, "false_premise").otherwise("unsupported")
    n = F.col("doc_id")
    return (
        rows.withColumn("meaning_id", meaning).join(kinds.select("meaning_id", kind.alias("answerability")), "meaning_id")
        .withColumn("word", F.regexp_extract("text", "[A-Za-z]{2,}", 0))
        .withColumn("language", F.when(n % 19 == 0, "ko").otherwise("en"))
        .withColumn("question", F.format_string("What does page %d of %s say about %s?", n, "source", "word"))
    )


def cases(rows: DataFrame) -> DataFrame:
    n, marker = F.col("doc_id"), lambda name, *words: F.struct(F.lit(name).alias("id"), F.array(*words).alias("any_of"))
    page = lambda k: (n + k).cast("int")
    markers = F.array(marker("word", F.upper("word"), F.lit("zzzz")), marker("common", *map(F.lit, COMMON)))
    facts = F.array(F.struct(F.array("word", F.lit("zzzz")).alias("any_of")), F.struct(F.array(F.lit("an")).alias("any_of")))
    return rows.select(
        n.cast("string").alias("case_id"), "meaning_id", F.col("source").alias("split"), "language", "answerability",
        F.element_at(F.array(*map(F.lit, TYPES)), (n % len(TYPES) + 1).cast("int")).alias("question_type"),
        F.col("source").alias("paper_id"), "question",
        F.when(n % 4 == 0, F.array(page(1))).when(n % 4 == 1, F.array(page(1), page(2)))
        .when(n % 4 == 2, F.array(page(1), page(5))).otherwise(F.array().cast("array<int>")).alias("gold_pages"),
        F.when(F.col("quality") == 1, markers).otherwise(F.array().cast(inspect.MARKERS)).alias("required_markers"),
        facts.alias("required_facts"),
    )


def _evidence() -> Column:
    n = F.col("doc_id")
    default = lambda k: F.format_string("%s-p%d", "source", n + k)
    scoped = F.when(n % 29 == 4, F.format_string("p%d", n)).otherwise(default(1))

    def item(number: int, chunk: Column, page: Column, paper: Column, locator: Column) -> Column:
        return F.struct(
            F.concat(F.lit(f"ev-{number:02d}-"), chunk).alias("evidence_id"), page.cast("int").alias("page"),
            F.col("text"), paper.alias("paper_id"), chunk.alias("chunk_id"), F.struct(locator.alias("chunk_id")).alias("locator"),
        )

    return F.array(
        item(
            1, scoped, F.when(n % 29 == 1, 0).otherwise(n + 1), F.when(n % 29 == 2, "other").otherwise(F.col("source")),
            F.when(n % 29 == 3, "elsewhere").otherwise(scoped),
        ),
        item(2, default(2), n + 2, F.lit(None).cast("string"), default(2)),
    )


def outputs(rows: DataFrame) -> DataFrame:
    """Saved outputs in their two shapes, the public one for even ids."""
    n, refuses = F.col("doc_id"), F.col("doc_id") % 5 == 0
    refusal = F.when(F.col("language") == "ko", ABSTENTION["ko"]).otherwise(ABSTENTION["en"])
    answer = F.when(refuses, refusal).when(n % 21 == 1, F.upper("question")).otherwise(F.col("text"))
    none = F.array().cast(inspect.EVIDENCE)
    evidence = F.when(refuses, none).otherwise(_evidence())
    ids = F.transform(evidence, lambda e: e["evidence_id"])
    sufficiency = F.when(refuses, "insufficient").when(n % 17 == 5, "maybe").otherwise("sufficient")
    reason = F.when(refuses & (n % 4 < 3), "The pages do not tell.")
    cited = F.when(n % 29 == 5, F.concat(ids, ids)).when(n % 29 == 6, F.slice(ids, 1, 1)).otherwise(ids)
    run = F.struct((F.col("toxic") == 1).alias("fallback_used"), F.when(refuses, "policy").alias("abstention_source"))
    public = n % 2 == 0
    only = lambda c: F.when(~public, c)
    asked = F.when(n % 29 == 8, F.concat("question", F.lit("!"))).otherwise(F.col("question"))
    payload = F.struct(
        answer.alias("answer"), cited.alias("evidence_ids"), sufficiency.alias("sufficiency"), reason.alias("abstention_reason")
    )
    records = rows.where(n % 23 != 3).select(
        n.cast("string").alias("case_id"), F.when(n % 29 == 7, "other").otherwise(F.col("source")).alias("paper_id"),
        F.lit(None).cast("string").alias("runtime_paper_id"), F.col("language").alias("question_language"),
        F.when(public, asked).alias("query"), only(asked).alias("question"), F.when(public, payload).alias("response"),
        only(answer).alias("answer"), only(sufficiency).alias("sufficiency"), only(reason).alias("abstention_reason"),
        F.when(public, evidence).alias("cited_evidence"), only(evidence).alias("evidence"),
        F.when(public, run).alias("pipeline"), only(run).alias("runtime"),
    )
    return inspect.final_outputs(records)


def wall_seconds(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("doc_id").cast("string").alias("case_id"), (F.length("text") / 1000.0).alias("wall_seconds"))


def inspected(spark: SparkSession, folder: str) -> DataFrame:
    rows = labelled(spark, folder)
    return inspect.inspect_outputs(cases(rows), outputs(rows))


def facts(spark: SparkSession, folder: str) -> DataFrame:
    rows = labelled(spark, folder)
    return inspect.fact_records(cases(rows), outputs(rows).join(wall_seconds(rows), "case_id"))


# Rows of cases with their outputs. The internal shape (odd ids) cites what its evidence names, so
# neither repeated nor missing ids occur there.
_ROWS = f"""row0 AS (SELECT d.doc_id AS n, source, text, quality, toxic, source || ':' || (d.doc_id // 40) AS meaning_id,
  CASE WHEN max(quality) OVER m = 1 THEN 'answerable' WHEN max(toxic) OVER m = 1 THEN 'false_premise' ELSE 'unsupported' END
    AS answerability, regexp_extract(text, '[A-Za-z]{{2,}}') AS word, CASE WHEN d.doc_id % 19 = 0 THEN 'ko' ELSE 'en' END AS language,
  d.doc_id % 5 = 0 AS refuses
  FROM documents d JOIN labels l USING (doc_id) WINDOW m AS (PARTITION BY source || ':' || (d.doc_id // 40))),
row1 AS (SELECT *, 'What does page ' || n || ' of ' || source || ' say about ' || word || '?' AS question,
  CASE WHEN n % 4 = 0 THEN [n + 1] WHEN n % 4 = 1 THEN [n + 1, n + 2] WHEN n % 4 = 2 THEN [n + 1, n + 5] ELSE []::BIGINT[] END AS gold,
  CASE WHEN refuses THEN []::BIGINT[] ELSE [CASE WHEN n % 29 = 1 THEN 0 ELSE n + 1 END, n + 2] END AS pages,
  CASE WHEN refuses THEN 'insufficient' WHEN n % 17 = 5 THEN 'maybe' ELSE 'sufficient' END AS sufficiency FROM row0),
row2a AS (SELECT *, CASE WHEN refuses THEN CASE language WHEN 'ko' THEN '{ABSTENTION["ko"]}' ELSE '{ABSTENTION["en"]}' END
    WHEN n % 21 = 1 THEN upper(question) ELSE text END AS answer FROM row1),
row2 AS (SELECT *, trim(regexp_replace(replace(lower(answer), 'ß', 'ss'), '\\s+', ' ', 'g')) AS said FROM row2a),
seen AS (SELECT *, CASE WHEN n % 23 = 3 THEN 'missing_output' WHEN n % 29 = 7 THEN 'other_paper' WHEN n % 29 = 8 THEN 'other_question'
    WHEN NOT regexp_matches(answer, '\\S') OR length(answer) > 4000 THEN 'answer_text'
    WHEN regexp_matches(answer, '[가-힣]') <> (language = 'ko') THEN 'answer_language'
    WHEN NOT refuses AND n % 2 = 0 AND n % 29 = 5 THEN 'citation_contract'
    WHEN NOT refuses AND n % 2 = 0 AND n % 29 = 6 THEN 'unresolved_citations'
    WHEN NOT refuses AND n % 29 = 1 THEN 'evidence_page' WHEN NOT refuses AND NOT regexp_matches(text, '\\S') THEN 'evidence_text'
    WHEN NOT refuses AND n % 29 = 2 THEN 'evidence_of_other_paper' WHEN NOT refuses AND n % 29 = 4 THEN 'evidence_scope'
    WHEN NOT refuses AND n % 29 = 3 THEN 'evidence_locator'
    WHEN sufficiency = 'sufficient' AND n % 21 = 1 THEN 'non_answer'
    WHEN refuses AND n % 4 = 3 THEN 'refusal_contract'
    WHEN sufficiency = 'maybe' THEN 'sufficiency' END AS error,
  list_filter([CASE WHEN word <> '' AND regexp_matches(said, '(?:^|[^\\pL\\pN_.])' || lower(word) || '(?:$|[^\\pL\\pN_])') THEN 'word' END,
    CASE WHEN regexp_matches(said, '(?:^|[^\\pL\\pN_.])(?:{"|".join(COMMON)})(?:$|[^\\pL\\pN_])') THEN 'common' END],
    lambda m: m IS NOT NULL) AS markers
  FROM row2),
told AS (SELECT *, error IS NULL AS valid, error IS NULL AND sufficiency = 'sufficient' AS ans, error IS NULL AND refuses AS ref,
  error IS NULL AND len(gold) > 0 AND len(list_intersect(pages, gold)) = len(gold) AS cited,
  (error IS NULL OR error NOT IN ('missing_output', 'other_paper', 'other_question')) AND toxic = 1 AS fallback,
  CASE WHEN quality = 1 THEN 2 ELSE 0 END AS marks FROM seen)"""
INSPECTED = "WITH " + _ROWS


def records_sql() -> str:
    return INSPECTED + """
SELECT n::VARCHAR AS case_id, coalesce(error, '') AS error, valid AS valid_contract, ans AS final_answer, ref AS final_refusal,
  cited AS all_required_pages_cited, CASE WHEN valid AND len(gold) > 0 THEN
    round(len(list_intersect(pages, gold)) * 1.0::DOUBLE / len(gold), 6) END AS citation_locator_recall, fallback AS fallback_used,
  CASE WHEN (error IS NULL OR error NOT IN ('missing_output', 'other_paper', 'other_question')) AND refuses THEN 'policy' ELSE '' END
    AS abstention_source,
  CASE WHEN valid AND marks > 0 THEN array_to_string(markers, '|') ELSE '' END AS markers,
  coalesce((CASE WHEN valid AND marks > 0 THEN ans AND len(markers) = marks END)::VARCHAR, '') AS all_required_markers_present FROM told"""


def _units(grain: str, value: str, unit: str) -> str:
    return f""" SELECT '{grain}' AS grain, value, count(*)::BIGINT AS units, round(avg(valid::INT), 6) AS valid_final_contract_rate,
  (count(*) FILTER (WHERE a = 'answerable'))::BIGINT AS answerable_units,
  round(avg(all_ans::INT) FILTER (WHERE a = 'answerable'), 6) AS answerable_retention,
  round(avg(any_ref::INT) FILTER (WHERE a = 'answerable'), 6) AS false_refusal_rate,
  round(avg(all_ref::INT) FILTER (WHERE a = 'unsupported'), 6) AS unsupported_final_refusal_rate,
  round(avg(all_ref::INT) FILTER (WHERE a = 'false_premise'), 6) AS false_premise_final_refusal_rate,
  round(avg(any_ans::INT) FILTER (WHERE a <> 'answerable'), 6) AS unsupported_answer_rate,
  round(avg(cited::INT) FILTER (WHERE a = 'answerable'), 6) AS all_required_pages_cited_rate,
  sum(invalid)::BIGINT AS invalid_outputs, sum(fb)::BIGINT AS fallback_outputs,
  round(avg(marks_ok::INT) FILTER (WHERE a = 'answerable' AND marked), 6) AS all_required_markers_present_rate
FROM (SELECT {unit} AS unit, answerability AS a, {value} AS value, bool_and(valid) AS valid, bool_and(ans) AS all_ans,
    bool_or(ans) AS any_ans, bool_and(ref) AS all_ref, bool_or(ref) AS any_ref, bool_and(cited) AS cited, bool_or(marks > 0) AS marked,
    bool_and(valid AND marks > 0 AND ans AND len(markers) = marks) AS marks_ok, sum((NOT valid)::INT) AS invalid,
    sum(fallback::INT) AS fb FROM told GROUP BY ALL) GROUP BY value"""


def summary_sql(*grains: str) -> str:
    """Rates at the named grains; languages output by output, the rest over meanings."""
    parts = {
        "overall": ("'all'", "meaning_id"), "split": ("source", "meaning_id"), "language": ("language", "n::VARCHAR"),
        "question_type": (f"{list(TYPES)}[n % {len(TYPES)} + 1]", "meaning_id"),
    }
    return INSPECTED + " UNION ALL ".join(_units(g, *parts[g]) for g in grains)


FACTS = INSPECTED + """, fact AS (SELECT *, (contains(lowered, lower(word)) OR contains(lowered, 'zzzz'))::INT + contains(lowered, 'an')::INT AS hits
  FROM (SELECT *, regexp_replace(lower(answer), '\\s+', ' ', 'g') AS lowered FROM told))"""
