"""Text primitives as Column expressions: tokens, shingles, facts, similarity.

Patterns start with ``(?U)`` so that word classes and boundaries follow Unicode, as the
text rules they state assume.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: patterns that define the tokens and facts -------------------------
TOKEN = r"[가-힣]+|[A-Za-z0-9]+(?:[-_./][A-Za-z0-9]+)*"
TOKEN_JOINER = r"[-_./]"
TOKEN_PART = r"[A-Za-z0-9]+"
COMPOUND = r"[A-Za-z0-9][-_./][A-Za-z0-9]"
PLAIN_TOKEN = r"[가-힣]+|[A-Za-z0-9]+"
QUANTITY = r"(?U)[-+]?\d+(?:[.,]\d+)*(?:%|[x×])?"
QUANTITY_WITH_UNIT = (
    r"(?U)[-+]?\d+(?:[.,]\d+)*\s*(?:ms|seconds?|secs?|minutes?|mins?|hours?|GB|MB|GiB|MiB"
    r"|Hz|GHz|MHz|밀리초|초|분)(?![A-Za-z])"
)
IDENTIFIER = (
    r"(?U)\b(?:[A-Z]{2,}[A-Za-z0-9_-]*|[A-Za-z]+[-_]\d+[A-Za-z0-9_-]*"
    r"|[A-Z][A-Za-z0-9]*[-_][A-Z0-9][A-Za-z0-9_-]*|[A-Z][a-z]+(?:[A-Z][A-Za-z0-9]*)+)\b"
)
# what every identifier holds somewhere, found without looking for words
IDENTIFIER_PART = r"[A-Z]{2}|[a-z][A-Z]|[A-Za-z0-9][-_][A-Z0-9\p{Nd}]"
QUALIFIER = (
    r"(?U)\b(?:not|never|only|except|without|higher|lower|increase\w*|decrease\w*"
    r"|improve\w*|worse|more|less|up to|at least|at most)\b"
)
SENTENCE_GAP = r"(?U)(?<=[.!?])\s+"
# a run of blanks that is not already a single one
LOOSE_BLANKS = r"(?U) \s+|[\s&&[^ ]]\s*"
SYMBOLS = ("=", "∈", "⊆", "∆", "∂", "†")
# -------------------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression and evaluate ``body`` on it."""
    return F.transform(F.array(value), body)[0]


def find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    return text.rlike("|".join(rf"\Q{needle}\E" for needle in needles))


def tokens(text: Column) -> Column:
    """Ordered tokens with duplicates; a compound is followed by its own parts."""

    def split(lowered: Column) -> Column:
        found = find_all(lowered, TOKEN)
        with_parts = F.flatten(
            F.transform(
                found,
                lambda token: F.when(
                    token.rlike(TOKEN_JOINER), F.concat(F.array(token), find_all(token, TOKEN_PART))
                ).otherwise(F.array(token)),
            )
        )
        return F.when(lowered.rlike(COMPOUND), with_parts).otherwise(found)

    return let(F.lower(text), split)


_TOKEN, _COMPOUND, _PART, _PLAIN = map(re.compile, (TOKEN, COMPOUND, TOKEN_PART, PLAIN_TOKEN))
_HANGUL = re.compile("[가-힣]")
_BLANKED = bytes(c if chr(c).isascii() and chr(c).isalnum() else 32 for c in range(256))


def token_list(text: str | None) -> list[str]:
    """The same tokens of one string, for passes over Arrow batches."""
    lowered = (text or "").lower()
    if not _COMPOUND.search(lowered):
        if _HANGUL.search(lowered):
            return _PLAIN.findall(lowered)
        return lowered.encode("ascii", "replace").translate(_BLANKED).decode("ascii").split()
    listed = []
    for token in _TOKEN.findall(lowered):
        listed.append(token)
        if _COMPOUND.search(token):
            listed += _PART.findall(token)
    return listed


def plain_tokens(text: Column) -> Column:
    return find_all(F.lower(text), PLAIN_TOKEN)


def normalized(text: Column) -> Column:
    return F.array_join(plain_tokens(text), " ")


def shingles(token_array: Column, size: int = 3) -> Column:
    """Distinct runs of ``size`` tokens; a shorter text is the set of its tokens."""
    runs = F.transform(
        F.sequence(F.lit(1), F.size(token_array) - F.lit(size - 1)),
        lambda start: F.array_join(F.slice(token_array, start, size), " "),
    )
    return F.array_distinct(F.when(F.size(token_array) < size, token_array).otherwise(runs))


def jaccard(left: Column, right: Column) -> Column:
    shared = F.size(F.array_intersect(left, right))
    total = F.size(left) + F.size(right) - shared
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / total)


def identifiers(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(~text.rlike(IDENTIFIER_PART), none).otherwise(F.array_distinct(find_all(text, IDENTIFIER)))


def fact_tokens(text: Column) -> Column:
    """Sorted set of quantities, quantities with units, identifiers and qualifiers, so
    that set equality is array equality."""
    with_unit = F.transform(
        find_all(text, QUANTITY_WITH_UNIT),
        lambda value: F.lower(F.regexp_replace(value, r"(?U)\s+", "")),
    )
    return F.sort_array(
        F.array_distinct(
            F.concat(
                find_all(text, QUANTITY),
                with_unit,
                find_all(text, IDENTIFIER),
                find_all(F.lower(text), QUALIFIER),
            )
        )
    )


def squeeze(text: Column) -> Column:
    """Collapse whitespace to single blanks and trim."""
    return F.trim(F.regexp_replace(text, LOOSE_BLANKS, " "))


def clean_text(text: Column) -> Column:
    """Drop soft hyphens, join words broken over a line end, collapse whitespace."""
    joined = F.regexp_replace(F.replace(text, F.lit("­"), F.lit("")), r"(?U)-\s*\n", "")
    return squeeze(joined)


def overlap_length(left: Column, right: Column, low: int = 20, high: int = 400) -> Column:
    """Longest suffix of ``left`` that starts ``right``, between ``low`` and ``high``
    characters; 0 when there is none."""
    ends = F.struct(F.right(left, F.lit(high)).alias("tail"), F.left(right, F.lit(high)).alias("head"))

    def longest(e: Column) -> Column:
        limit = F.least(F.length(e["tail"]), F.length(e["head"]))
        sizes = F.when(
            (limit >= low) & e["tail"].contains(F.left(e["head"], F.lit(low))),
            F.sequence(limit, F.lit(low), F.lit(-1)),
        ).otherwise(F.array().cast("array<int>"))
        fits = F.filter(sizes, lambda n: F.right(e["tail"], n) == F.left(e["head"], n))
        return F.coalesce(F.get(fits, F.lit(0)), F.lit(0))

    return let(ends, longest)


def merge_overlap(left: Column, right: Column) -> Column:
    """Join two texts on their overlap, or by a line break when they do not overlap."""
    return let(
        overlap_length(left, right),
        lambda n: F.when(n > 0, F.concat(left, F.substring(right, n + 1, F.length(right))))
        .otherwise(F.concat(left, F.lit("\n"), right)),
    )


def nfkc(text: Column) -> Column:
    """Unicode compatibility normalisation; Spark has no built-in for it."""
    return _nfkc_batch(text)


@F.pandas_udf(T.StringType())
def _nfkc_batch(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


def folded(text: Column) -> Column:
    """NFKC and case folding, which Spark has no built-in for."""
    return _folded_batch(text)


@F.pandas_udf(T.StringType())
def _folded_batch(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC").str.casefold()


def occurrences(text: Column, pattern: str | Column, before: int, after: int) -> Column:
    """Every match of ``pattern`` with the text around it, as an array of
    (before, match, after) structs."""
    wanted = pattern if isinstance(pattern, Column) else F.lit(pattern)
    found = F.regexp_extract_all(text, wanted, F.lit(0))
    gaps = F.split(text, wanted, -1)

    def windows(matches: Column, between: Column) -> Column:
        steps = F.zip_with(
            matches, F.slice(between, F.lit(1), F.size(matches)),
            lambda m, gap: F.length(gap) + F.length(m),
        )
        ends = F.aggregate(
            steps, F.array(F.lit(0)),
            lambda seen, step: F.concat(seen, F.array(F.element_at(seen, -1) + step)),
        )
        return let(
            ends,
            lambda end: F.transform(
                matches,
                lambda m, i: let(
                    F.get(end, i + 1),
                    lambda stop: F.struct(
                        F.right(F.left(text, stop - F.length(m)), F.lit(before)).alias("before"),
                        m.alias("match"),
                        F.substring(text, stop + 1, F.lit(after)).alias("after"),
                    ),
                ),
            ),
        )

    return let(found, lambda matches: let(gaps, lambda between: windows(matches, between)))
