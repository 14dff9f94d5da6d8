"""URL filters: rules indexed by their rarest literal token.

A rule is a regular expression over host and path with the literal tokens that any match must
hold as whole tokens (runs of letters and digits). How often each of these tokens occurs in all
URLs is counted first; a rule is filed under its rarest one. The tokens of a URL fetch the rules
filed under them, and only those run. The rule set is a parameter of fixed size.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.llm.common import arrow_pass, texts_of

TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class UrlRule:
    """`pattern` is searched in host, a line break, path. `name` is set for host rules only."""

    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    name: str | None = None


def host_rule(verdict: str, rule: str) -> UrlRule:
    """host/path: fits the host and its subdomains where the path starts with the rule's."""
    host, _, path = rule.partition("/")
    pattern = rf"\A(?:[^\n]*\.)?{re.escape(host)}\n/{re.escape(path)}"
    tokens = TOKEN.findall(host) + TOKEN.findall(path if path.endswith("/") else path.rpartition("/")[0])
    return UrlRule(pattern, tuple(tokens), verdict, rule)


def word_rule(word: str) -> UrlRule:
    """Blocks a word that stands as a token of the host, or of the first part of the path."""
    return UrlRule(rf"\A[^\n]*(?<![a-z0-9]){word}(?![a-z0-9])[^\n]*\n|\A[^\n]*\n/{word}(?![A-Za-z0-9])", (word,), "block")


# The host rules.
HOST_RULES = (
    host_rule("allow", "com/"),
    host_rule("block", "example.com/en/"),
    host_rule("allow", "www.example.com/en/"),
    host_rule("block", "net/es/"),
    host_rule("block", "net/fr/"),
)
BLOCKED_WORDS = ("adult", "casino", "porn", "poker", "betting", "xxx", "warez", "viagra")
RULES = HOST_RULES + tuple(map(word_rule, BLOCKED_WORDS))


def split_url(url: str) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty without `://`."""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def token_counts(pages: DataFrame, rules: tuple[UrlRule, ...]) -> dict[str, int]:
    """How many URLs hold each token of the rules; one row for each such token at most."""
    wanted = sorted({t for r in rules for t in r.tokens})
    spark = pages.sparkSession
    held = pages.select(F.explode(F.array_distinct(F.split(F.lower("url"), "[^a-z0-9]+"))).alias("token"))
    counted = (
        held.join(F.broadcast(spark.createDataFrame([(t,) for t in wanted], "token string")), "token")
        .groupBy("token").count()
    )
    return dict.fromkeys(wanted, 0) | {r["token"]: r["count"] for r in counted.collect()}


def index_rules(rules: tuple[UrlRule, ...], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rule numbers under the rarest token of each; rules without tokens under the empty one."""
    index: dict[str, list[int]] = defaultdict(list)
    for n, rule in enumerate(rules):
        rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")
        index[rarest].append(n)
    return dict(index)


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    The longest fitting host rule decides, of equals the first in order; without one, any fitting
    word rule blocks, and the rest is allowed. A null url has an empty host and path and is
    allowed. Repeated rows are judged each.
    """
    index = index_rules(rules, token_counts(pages, rules))
    state: dict = {}

    def judge(url: str) -> tuple[str, str, str | None, str]:
        if not state:
            state.update(enumerate(re.compile(r.pattern) for r in rules))
        host, path = split_url(url)
        place = f"{host}\n{path}"
        tried = {n for t in {"", *TOKEN.findall(place.lower())} for n in index.get(t, ())}
        fits = [rules[n] for n in sorted(tried) if state[n].search(place)]
        named = max((r for r in fits if r.name), key=lambda r: len(r.name), default=None)
        if named:
            return host, path, named.name, named.verdict
        return host, path, None, "block" if any(r.verdict == "block" for r in fits) else "allow"

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [judge(u) for u in texts_of(batch.column("url"))]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), *(pa.array([x[k] for x in found], pa.string()) for k in range(4))],
            ["page_id", "host", "path", "rule", "verdict"],
        )

    return arrow_pass(
        pages.select("page_id", "url"), step,
        f"page_id {dict(pages.dtypes)['page_id']}, host string, path string, rule string, verdict string",
    )


def oracle_sql() -> str:
    """The same judgement in SQL, rule by rule, without the index."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = "|".join(BLOCKED_WORDS)
    tests = []
    for rule in sorted((r for r in HOST_RULES), key=lambda r: -len(r.name or "")):
        host, _, path = (rule.name or "").partition("/")
        tests.append(
            f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{rule.name}'"
        )
    blocked = ", ".join(f"'{r.name}'" for r in HOST_RULES if r.verdict == "block")
    return f"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{upper}', '{upper.lower()}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE {' '.join(tests)} END AS rule FROM parts
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ({blocked}) THEN 'block'
       WHEN rule IS NOT NULL THEN 'allow'
       WHEN regexp_matches(host, '(^|[^a-z0-9])({words})([^a-z0-9]|$)')
         OR regexp_matches(path, '^/({words})([^A-Za-z0-9]|$)') THEN 'block'
       ELSE 'allow' END AS verdict
FROM ruled
"""
