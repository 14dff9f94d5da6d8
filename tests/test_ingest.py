
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citegrain import schemas
from citegrain.operators import ingest, validate
from citegrain.operators.windows import carry_forward

WORDS = st.lists(
    st.text(alphabet="abé.!?", min_size=1, max_size=9), min_size=0, max_size=60
).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(WORDS, st.integers(8, 40))
def test_windows_without_overlap_lose_nothing(text, size):
    parts = [text[a:b] for a, b in ingest.spans(text, size, 0)]
    assert "".join("".join(parts).split()) == "".join(text.split())
    assert all(len(p) <= size for p in parts)


@settings(max_examples=150, deadline=None)
@given(WORDS, st.integers(10, 40), st.integers(1, 9))
def test_windows_advance_and_cover(text, size, overlap):
    found = list(ingest.spans(text, size, overlap))
    assert all(a < b for a, b in found)
    assert all(x[0] < y[0] <= x[1] for x, y in zip(found, found[1:]))
    assert not text or found[-1][1] == len(text)


def test_windows_prefer_sentence_ends():
    text = "One two three. Four five six seven eight nine."
    assert [text[a:b].strip() for a, b in ingest.spans(text, 20, 0)][0] == "One two three."
    with pytest.raises(ValueError):
        ingest.chunk_texts(10, 10)


def raw(spark, rows):
    return spark.createDataFrame(rows, schemas.RAW_PAGE)


def test_sections_carry_over_pages(spark):
    pages = raw(
        spark,
        [
            ("p", 1, "Title line\nAbstract\nWe study things.", None, None),
            ("p", 2, "still the abstract\n1 Model Design\nLayers here.", None, None),
            ("p", 3, "   ", None, None),
            ("p", 4, "more design", "a    b\n" * 6, None),
            ("p", 5, None, None, "ValueError: broken"),
            ("q", None, None, None, "OSError: unreadable"),
        ],
    )
    made = ingest.ingest(pages, 40, 5)
    sections = {
        r.page: [(s.section, s.text) for s in r.sections] for r in made.pages.collect()
    }
    assert sections[1] == [("Front Matter", "Title line"), ("Abstract", "Abstract We study things.")]
    assert sections[2] == [
        ("Abstract", "still the abstract"), ("1 Model Design", "1 Model Design Layers here."),
    ]
    assert sections[4] == [("1 Model Design", "more design")]
    codes = {(r.page, r.code) for r in made.warnings.collect()}
    assert codes == {
        (3, "empty_page"), (4, "two_column_suspected"), (5, "page_text_extraction_failed"),
    }
    chunks = {r.chunk_id: r for r in made.chunks.collect()}
    assert chunks["p-p002-c002"].section_index == 2 and chunks["p-p002-c002"].chunk_index == 1
    status = {r.paper_id: r.status for r in made.papers.collect()}
    assert status == {"p": "success", "q": "failed"}
    assert validate.traceability(made.chunks, made.pages).isEmpty()
    assert validate.chunk_rules(made.chunks, 40).isEmpty()
    summary = ingest.ingestion_summary(made.papers).first()
    assert (summary.papers_found, summary.papers_failed, summary.pages_extracted) == (2, 1, 3)
    overview = {r.paper_id: r for r in ingest.section_overview(made.pages).collect()}
    assert overview["p"].sections == ["Abstract", "1 Model Design"]
    assert overview["p"].abstract == "We study things. still the abstract"


def test_carry_forward_over_blocks(spark):
    rows = [("a", i, f"h{i}" if i in (2, 9) else None) for i in range(1, 20)]
    df = spark.createDataFrame(rows, "k string, n int, v string")
    out = {r.n: r.c for r in carry_forward(df, "k", "n", "v", "c", span=4).collect()}
    assert out == {
        i: None if i <= 2 else "h2" if i <= 9 else "h9" for i in range(1, 20)
    }


def test_violations_are_found(spark):
    pages = raw(spark, [("p", 1, "Some text here.", None, None)])
    made = ingest.ingest(pages)
    broken = made.chunks.withColumn("section", F.lit("Nowhere")).withColumn("char_count", F.lit(3))
    rules = {r.rule for r in validate.chunk_rules(broken, 1200).collect()}
    assert rules == {"char_count"}
    assert {r.rule for r in validate.traceability(broken, made.pages).collect()} == {"unknown_section"}
    orphan = made.chunks.withColumn("source_page_id", F.lit("p-p009"))
    assert {r.rule for r in validate.traceability(orphan, made.pages).collect()} == {"unknown_page"}


def test_line_ends_match_python(each):
    from citegrain.functions.headings import lines

    for text in ("a\nb\r\nc\rd\x0be\x0cf g", "x\n", "x\n\ny"):
        assert each(lines, [text])[0] == text.splitlines()
