"""Constraint checks. Each returns the violations it finds; a sound table gives none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.functions.questions import language
from citegrain.functions.text import folded, squeeze


def _tagged(df: DataFrame, rule: str, key: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("id"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def rule_violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Rows that break any rule, one output row per broken rule, in a single pass."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    )
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("id"))


def duplicates(df: DataFrame, *keys: str, rule: str = "duplicate_id") -> DataFrame:
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return repeated.select(
        F.lit(rule).alias("rule"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("id")
    )


def chunk_rules(chunks: DataFrame, size: int) -> DataFrame:
    written = lambda c: F.col(c).rlike(r"(?U)\S")
    rows = rule_violations(
        chunks,
        "chunk_id",
        {
            "blank_text": written("text"),
            "blank_section": written("section"),
            "char_count": F.col("char_count") == F.length("text"),
            "over_size": F.length("text") <= size,
        },
    )
    return rows.unionByName(duplicates(chunks, "chunk_id"))


def traceability(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Every chunk names an existing page of its paper and one of that page's sections;
    every page's counts agree with its text."""
    own = pages.select(
        F.col("page_id").alias("source_page_id"),
        F.col("paper_id").alias("page_paper"),
        F.col("page").alias("page_number"),
        F.transform("sections", lambda s: s["section"]).alias("names"),
    )
    joined = chunks.drop("text").join(own, "source_page_id", "left")
    found = F.col("page_paper").isNotNull()
    chunk_side = rule_violations(
        joined,
        "chunk_id",
        {
            "unknown_page": found,
            "page_mismatch": ~found
            | ((F.col("page_paper") == F.col("paper_id")) & (F.col("page_number") == F.col("page"))),
            "unknown_section": ~found | F.array_contains("names", F.col("section")),
        },
    )
    page_side = rule_violations(
        pages,
        "page_id",
        {
            "page_char_count": F.col("char_count") == F.length("text"),
            "section_char_count": F.forall(
                "sections", lambda s: s["char_count"] == F.length(s["text"])
            ),
        },
    )
    return _union([chunk_side, page_side, duplicates(pages, "page_id")])


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys present on one side only."""
    missing = left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")
    extra = right.select(key).distinct().join(left.select(key).distinct(), key, "left_anti")
    return _tagged(missing, "missing", key).unionByName(_tagged(extra, "extra", key))


def incomplete_keys(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that are not exactly once in every source: a set-equality join of any number of tables.

    One shuffle of narrow rows; counts are taken before it, so a key that is repeated without end is
    a few rows. Each key comes back with the sources that lack it and those that repeat it.
    """
    names = list(sources)
    counted = _union([
        df.select(F.col(key).alias(key), *[F.lit(int(n == name)).cast("long").alias(n) for n in names])
        for name, df in sources.items()
    ]).groupBy(key).agg(*[F.sum(n).alias(n) for n in names])
    told = lambda test: F.array_compact(F.array(*[F.when(test(F.col(n)), F.lit(n)) for n in names]))
    return counted.select(
        key, told(lambda c: c == 0).alias("missing"), told(lambda c: c > 1).alias("repeated")
    ).where((F.size("missing") > 0) | (F.size("repeated") > 0))


def map_violations(pairs: DataFrame, a: str, b: str, domain: DataFrame) -> DataFrame:
    """What keeps pairs from being a one-to-one map of exactly the domain's ``a`` values."""
    several = lambda x, y: pairs.groupBy(x).agg(F.count_distinct(y).alias("n")).where("n > 1")
    nothing = pairs.where(F.col(b).isNull() | ~F.coalesce(F.col(b).cast("string").rlike(r"(?U)\S"), F.lit(False)))
    return _union([
        _tagged(several(a, b), "several_targets", a), _tagged(several(b, a), "shared_target", b),
        _tagged(nothing.select(a).distinct(), "no_target", a), key_differences(domain, pairs, a),
    ])


def same_when_folded(rows: DataFrame, text: str, key: str) -> DataFrame:
    """Texts that are alike after NFKC, case folding and squeezing, told by their least key.

    duplicate_text: more than one row; leak_text: in more than one split. Only hashes of the folded
    texts are shuffled, with counts taken before.
    """
    known = rows.withColumn("_folded", F.sha2(squeeze(folded(F.col(text))), 256))
    seen = known.groupBy("_folded").agg(
        F.min(key).alias("id"), F.count("*").alias("rows"), F.min("split").alias("low"), F.max("split").alias("high")
    )
    broken = F.array_compact(F.array(
        F.when(F.col("rows") > 1, "duplicate_text"), F.when(F.col("low") != F.col("high"), "leak_text")
    ))
    return seen.select(F.explode(broken).alias("rule"), F.col("id").cast("string").alias("id"))


def alignment_violations(outputs: DataFrame, aligned: DataFrame, sources: DataFrame, cited: DataFrame) -> DataFrame:
    """What keeps published alignments from rebuilding their answers and sources; ids are case ids.

    ``outputs``: case_id, language, sufficiency, answer; ``aligned``: case_id, position, sentence_id,
    evidence_id, source_text, answer_text, page, section, answer_language; ``sources``: the usable
    sentences by (case_id, sentence_id, evidence_id) with text, page, section; ``cited``: page and
    section by (case_id, evidence_id). The answer is rebuilt from its pieces in their order; every
    piece must be a known sentence, with the text, page and section of it and of its evidence.
    """
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("position", "answer_text"))), lambda p: p["answer_text"])
    rebuilt = aligned.groupBy("case_id").agg(F.array_join(pieces, " ").alias("rebuilt"))
    answers = outputs.join(rebuilt, "case_id", "left")
    told = F.col("rebuilt").isNotNull()
    whole = rule_violations(
        answers, "case_id",
        {
            "aligned_refusal": ~told | (F.col("sufficiency") == "sufficient"),
            "rebuilt_answer": ~told | (F.col("rebuilt") == F.col("answer")),
        },
    )
    source = sources.select("case_id", "sentence_id", "evidence_id", *[F.col(c).alias(f"s_{c}") for c in ("text", "page", "section")])
    shown = cited.select("case_id", "evidence_id", *[F.col(c).alias(f"c_{c}") for c in ("page", "section")])
    rows = (
        aligned.join(source, ["case_id", "sentence_id", "evidence_id"], "left").join(shown, ["case_id", "evidence_id"], "left")
        .join(outputs.select("case_id", "language"), "case_id", "left")
    )
    known, resolved = F.col("s_text").isNotNull(), F.col("c_page").isNotNull()
    same = lambda c: F.col(c).eqNullSafe(F.col(f"s_{c}")) & F.col(c).eqNullSafe(F.col(f"c_{c}"))
    parts = rule_violations(
        rows, "case_id",
        {
            "unknown_sentence": known, "unresolved_evidence": resolved,
            "changed_source": ~known | (F.col("source_text") == F.col("s_text")),
            "changed_page": ~known | ~resolved | same("page"), "changed_section": ~known | ~resolved | same("section"),
            "changed_language": F.col("answer_language").eqNullSafe(F.col("language")),
        },
    )
    return whole.unionByName(parts.distinct())


def metric_differences(published: DataFrame, recomputed: DataFrame, keys: list[str], places: int = 6) -> DataFrame:
    """Published metrics that rows do not give again: (keys, metric, published, recomputed).

    Both reports meet on their keys and metrics; a row or a metric of one side only differs from NULL. Values
    are compared as text of ``places`` decimals, so counts and rates are told alike.
    """
    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = [
            F.struct(F.lit(c).alias("metric"), F.round(F.col(c).cast("double"), places).alias("value"))
            for c in df.columns if c not in keys
        ]
        rows = df.select(*keys, F.explode(F.array(*pairs)).alias("p"))
        return rows.select(*keys, "p.metric", F.col("p.value").alias(name))

    sides = [long(df, "value").withColumn("side", F.lit(name)) for name, df in (("published", published), ("recomputed", recomputed))]
    both = _union(sides).groupBy(*keys, "metric").agg(
        *[F.max(F.when(F.col("side") == name, F.col("value"))).alias(name) for name in ("published", "recomputed")]
    )
    return both.where(~F.col("published").eqNullSafe(F.col("recomputed")))


def changed_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Added, removed and changed keys between two versions of a table."""
    fields = [c for c in before.columns if c != key]
    packed = lambda df, name: df.select(key, F.struct(*fields).alias(name))
    both = packed(before, "old").join(packed(after, "new"), key, "full_outer")
    change = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    )
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def prediction_coverage(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """Cases must meet exactly one prediction each."""
    return key_differences(cases, predictions, "case_id").unionByName(
        duplicates(predictions, "case_id", rule="duplicate")
    )


def question_rules(questions: DataFrame, types: tuple[str, ...]) -> DataFrame:
    fields = ("question_id", "paper_id", "question", "question_language", "question_type")
    rules = {f"missing_{f}": F.col(f).rlike(r"(?U)\S") for f in fields}
    rules |= {
        "language": F.col("question_language").isin("en", "ko"),
        "language_mismatch": F.col("question_language") == language(F.col("question")),
        "type": F.col("question_type").isin(*types),
        "answerable": F.col("answerable").isNotNull(),
    }
    return rule_violations(questions, "question_id", rules).unionByName(
        duplicates(questions, "question_id")
    )


def gold_rules(gold: DataFrame, questions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Gold rows are complete, one per question, and lie inside their paper."""
    fields = (
        "question_id", "paper_id", "gold_answer", "gold_evidence_text", "gold_section",
        "evidence_type", "review_status",
    )
    bounded = gold.join(
        manifest.select("paper_id", F.col("page_count").cast("int").alias("pages")),
        "paper_id", "left",
    )
    rules = {f"missing_{f}": F.col(f).rlike(r"(?U)\S") for f in fields}
    rules["page_range"] = F.col("gold_page").between(1, F.col("pages"))
    return _union(
        [
            rule_violations(bounded, "question_id", rules),
            key_differences(questions, gold, "question_id"),
            duplicates(gold, "question_id"),
        ]
    )


def pairing(cases: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Each meaning has exactly one English and one Korean case with equal labels."""
    groups = cases.groupBy("meaning_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("language") == "en").alias("en"),
        F.count_if(F.col("language") == "ko").alias("ko"),
        *[F.count_distinct(F.to_json(F.struct(f))).alias(f"v_{f}") for f in fields],
    )
    rules = {"pair": (F.col("n") == 2) & (F.col("en") == 1) & (F.col("ko") == 1)}
    rules |= {f"differs_{f}": F.col(f"v_{f}") == 1 for f in fields}
    return rule_violations(groups, "meaning_id", rules)


def split_leakage(rows: DataFrame, key: str) -> DataFrame:
    """Keys (papers, source hashes, meanings) that occur in more than one split."""
    spread = rows.groupBy(key).agg(F.count_distinct("split").alias("n")).where("n > 1")
    return _tagged(spread, f"leak_{key}", key)


def case_rules(cases: DataFrame, papers: DataFrame, facts: str = "required_facts") -> DataFrame:
    """Label, page and fact rules of benchmark cases; pages must exist in the paper."""
    known = papers.select(
        "paper_id", F.col("split").alias("paper_split"),
        F.col("page_count").cast("int").alias("pages"),
    )
    joined = cases.join(known, "paper_id", "left")
    answerable = F.col("answerability") == "answerable"
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return _union(
        [
            rule_violations(
                joined,
                "case_id",
                {
                    "unknown_paper": F.col("pages").isNotNull(),
                    "split": F.col("split") == F.col("paper_split"),
                    "language": F.col("language") == language(F.col("question")),
                    "answerability": F.col("answerability").isin(
                        "answerable", "unsupported", "false_premise"
                    ),
                    "gold_page": F.forall("gold_pages", lambda p: p.between(1, F.col("pages"))),
                    "gold_unique": F.size("gold_pages") == F.size(F.array_distinct("gold_pages")),
                    "facts": has(facts) == answerable,
                },
            ),
            duplicates(cases, "case_id"),
            pairing(cases, ("paper_id", "split", "answerability", "gold_pages")),
            split_leakage(cases, "paper_id"),
            split_leakage(cases, "meaning_id"),
        ]
    )


def category_coverage(cases: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """Every split must contain every category."""
    known = F.when(F.col(column).isin(*domain), F.col(column))
    seen = cases.groupBy("split").agg(F.collect_set(known).alias("seen"))
    missing = F.array_except(F.array(*map(F.lit, domain)), F.col("seen"))
    return seen.select(
        F.lit(f"missing_{column}").alias("rule"),
        F.explode(F.transform(missing, lambda m: F.concat_ws("|", F.col("split"), m))).alias("id"),
    )


def manifest_rules(manifest: DataFrame, files: DataFrame, max_bytes: int = 20 * 1024 * 1024) -> DataFrame:
    """Papers exist as files of allowed size whose page count is the declared one."""
    joined = manifest.join(files, "pdf_filename", "left")
    return rule_violations(
        joined,
        "paper_id",
        {
            "missing_file": F.col("size_bytes").isNotNull(),
            "too_large": F.coalesce(F.col("size_bytes") <= max_bytes, F.lit(True)),
            "no_pages": F.coalesce(F.col("pages") > 0, F.lit(True)),
            "page_count": F.col("pages").isNull() | (F.col("pages") == F.col("page_count").cast("int")),
            "license": F.col("license_status").rlike(r"(?U)\S"),
        },
    ).unionByName(duplicates(manifest, "paper_id"))
