"""Line rules for section headings, column layout and footnotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citegrain.functions.text import contains_any, let, squeeze

# --- fixed values ----------------------------------------------------------------------
DEFAULT_SECTION = "Front Matter"
KNOWN_HEADINGS = (
    "abstract", "introduction", "background", "related work", "method", "methods",
    "approach", "data", "dataset", "experiments", "experiment", "results", "discussion",
    "analysis", "limitations", "conclusion", "conclusions", "references",
    "acknowledgments", "appendix",
)
NUMBERED = r"(?U)^(\d{1,2}(?:\.\d{1,2})*)[.)]?\s+(.+)$"
NUMBERED_COMPACT = r"(?U)^(\d{1,2}(?:\.\d{1,2})*)\.([A-Z][A-Z\s-]{2,80})$"
ROMAN = r"(?U)^[IVXLCDM]+\.\s+([A-Z][A-Z\s-]{2,80})$"
ABSTRACT_LEAD = r"(?iuU)^abstract\s*(?:—|:|-)"
APPENDIX = r"(?U)^appendix(?:\s+[a-z])?$"
QUESTION_OR_MONTH = (
    r"^(?:How|What|Why|When|Which|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) "
)
NOT_A_TITLE = (
    "cutoff", "university", "department", "corporation", "institute", "school of",
    "email", "@",
)
LINE_BREAKS = "[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
LINE_BREAK = f"\r\n|{LINE_BREAKS}"
MULTI_GAP = r"(?U)\S {3,}\S"
FOOTNOTE = r"(?U)^(?:\d+|[*†‡])\s+"
# what every heading opens with, so that prose is told by its first word
_FIRST = r"(?:\d|[IVXLCDM]+\.|(?iu:%s))" % "|".join(KNOWN_HEADINGS)
OPENING = rf"(?U)^[\s:]*+{_FIRST}"
OPENING_LINE = rf"(?U)(?:\A|{LINE_BREAKS})[\s:&&[^{LINE_BREAKS[1:]}]*+{_FIRST}"
# ---------------------------------------------------------------------------------------


def lines(text: Column) -> Column:
    """Split at every kind of line end; a final line end opens no further line."""
    every = F.split(F.regexp_replace(text, f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK, -1)
    plain = F.split(F.regexp_replace(text, "\n\\z", ""), "\n", -1)
    return F.when(text.rlike(LINE_BREAKS.replace("\n", "")), every).otherwise(plain)


def headings(text: Column, line_array: Column) -> Column:
    """The headings by line; NULL where no line opens like one, as in most pages."""
    return F.when(text.rlike(OPENING_LINE), F.transform(line_array, heading))


def heading(raw: Column) -> Column:
    """The heading a line states, or NULL for an ordinary line."""
    length = F.length(raw)
    # an over-long line may still collapse to 100 characters, so only blanks are discounted
    line = F.regexp_replace(squeeze(raw), "^[ :\t]+|[ :\t]+$", "")
    return F.when((length >= 3) & raw.rlike(OPENING), let(line, _title))


def _title(line: Column) -> Column:
    return F.when(
        F.length(line).between(3, 100),
        F.when(line.rlike(ABSTRACT_LEAD), F.lit("Abstract")).when(
            line.rlike(ROMAN) | _titled(line), line
        ),
    )


def _titled(line: Column) -> Column:
    """Cheap tests first: a title has no sentence punctuation, so prose stops early."""
    numbered = line.rlike(NUMBERED) | line.rlike(NUMBERED_COMPACT)
    body = F.when(line.rlike(NUMBERED), F.regexp_extract(line, NUMBERED, 2)).otherwise(
        F.regexp_extract(line, NUMBERED_COMPACT, 2)
    )
    plain = F.rtrim(F.lower(line), F.lit("."))
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    dense = letters / F.length(line) >= 0.55
    unnumbered = (plain.isin(*KNOWN_HEADINGS) | plain.rlike(APPENDIX)) & ~line.rlike("[.,;?!]")

    def named(title: Column) -> Column:
        lowered = F.lower(title)
        return (
            title.rlike(r"^\p{Lu}")
            & ~title.rlike(r"[.,;?!:=/\p{Nd}¹²³⁰⁴-⁹₀-₉]")
            & ~title.rlike(QUESTION_OR_MONTH)
            & ~contains_any(lowered, NOT_A_TITLE)
            & (lowered.isin(*KNOWN_HEADINGS) | title.rlike(r"(?U)\S\s+\S"))
        )

    return F.when(
        numbered, (F.length(line) <= 90) & let(body, named) & dense
    ).otherwise(unnumbered & dense)


def two_columns(line_array: Column) -> Column:
    """At least six written lines, a quarter of which have a wide inner gap."""
    written = F.filter(line_array, lambda line: line.rlike(r"(?U)\S"))
    gaps = F.filter(written, lambda line: line.rlike(MULTI_GAP))
    return (F.size(written) >= 6) & (F.size(gaps) * 4 >= F.size(written))


def footnote_count(line_array: Column) -> Column:
    trimmed = F.transform(line_array, lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", ""))
    return F.size(
        F.filter(
            trimmed,
            lambda line: (F.length(line) <= 240) & line.rlike(FOOTNOTE) & heading(line).isNull(),
        )
    )
