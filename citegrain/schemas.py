"""Spark schemas of the tables that cross a storage boundary."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


STRING, INT, LONG, DOUBLE, BOOL = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(),
)

SECTION = _struct(position=INT, section=STRING, text=STRING, char_count=INT)
PAGE = _struct(
    page_id=STRING, paper_id=STRING, page=INT, text=STRING, char_count=INT,
    sections=T.ArrayType(SECTION),
)
CHUNK = _struct(
    chunk_id=STRING, paper_id=STRING, page=INT, source_page_id=STRING, section=STRING,
    section_index=INT, chunk_index=INT, text=STRING, char_count=INT,
)
WARNING = _struct(
    page=INT, code=STRING, detail=STRING, count=INT, section=STRING, char_count=INT,
)
# One row per page as an extractor delivers it; a NULL page marks an unreadable file.
RAW_PAGE = _struct(paper_id=STRING, page=INT, raw_text=STRING, layout_text=STRING, error=STRING)
MANIFEST = _struct(
    paper_id=STRING, title=STRING, domain=STRING, source_url=STRING, pdf_filename=STRING,
    language=STRING, license_status=STRING, text_extractable=STRING, page_count=STRING,
    notes=STRING,
)
QUESTION = _struct(
    question_id=STRING, paper_id=STRING, question=STRING, question_language=STRING,
    question_type=STRING, answerable=BOOL,
)
GOLD = _struct(
    question_id=STRING, paper_id=STRING, gold_answer=STRING, gold_evidence_text=STRING,
    gold_page=INT, gold_section=STRING, evidence_type=STRING, review_status=STRING,
)
MARKER = _struct(id=STRING, any_of=T.ArrayType(STRING))
CASE = _struct(
    case_id=STRING, meaning_id=STRING, paper_id=STRING, split=STRING, language=STRING,
    question_type=STRING, answerability=STRING, question=STRING, gold_pages=T.ArrayType(INT),
    reference_answer=STRING, author=STRING, independent_human_review=BOOL,
    required_markers=T.ArrayType(MARKER), required_facts=T.ArrayType(MARKER),
)
PAYLOAD = _struct(
    answer=STRING, evidence_ids=T.ArrayType(STRING), sufficiency=STRING, abstention_reason=STRING,
)
LOCATOR = _struct(page_label=STRING, section=STRING, chunk_id=STRING)
CITED = _struct(
    evidence_id=STRING, paper_id=STRING, page=INT, section=STRING, chunk_id=STRING, text=STRING,
    locator=LOCATOR,
)
RUNTIME = _struct(fallback_used=BOOL, abstention_source=STRING)
# Both the pipeline's own result and the service's answer fit this one union.
OUTPUT = _struct(
    paper_id=STRING, query=STRING, question=STRING, question_language=STRING, response=PAYLOAD,
    cited_evidence=T.ArrayType(CITED), pipeline=RUNTIME, answer=STRING, sufficiency=STRING,
    abstention_reason=STRING, evidence=T.ArrayType(CITED), runtime=RUNTIME,
)
PREDICTION = _struct(
    case_id=STRING, output=OUTPUT, execution_error=STRING, runtime_paper_id=STRING,
    wall_seconds=DOUBLE,
)
REVIEW = _struct(
    question_id=STRING, verdict=STRING, citation_support=STRING, language_match=BOOL,
    failure_types=T.ArrayType(STRING), notes=STRING,
)
JOB_EVENT = _struct(paper_id=STRING, job_id=STRING, status=STRING, at=T.TimestampType())
GLOSSARY_ENTRY = _struct(source=T.ArrayType(STRING), target=STRING)
