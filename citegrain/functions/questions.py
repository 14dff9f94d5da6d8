"""What a question asks for: language, answer shapes, named aspects, parts, hints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citegrain.functions.text import SENTENCE_GAP, SYMBOLS, contains_any, let, squeeze

HANGUL = "[가-힣]"

# --- fixed values: answer shapes, in the order of their names --------------------------
KIND_PATTERNS = {
    "causal": r"\b(?:why|reasons?|causes?|causal|explain\w* why|shortcuts?)\b"
    r"|왜|이유|원인|인과|지름길|편법",
    "comparison": r"\b(?:compar\w*|versus|vs|differ\w*|trade[- ]?offs?)\b|비교|차이|달라|다르|다른",
    "definition": r"\b(?:defin\w*|meaning|means?|mean by|refer\w* to)\b"
    r"|(?<![가-힣])정의|의\s*정의|의미|(?<![가-힣])뜻",
    "evaluation": r"\b(?:evaluat\w*|validat\w*)\b"
    r"|\b(?:what|which)\s+(?:\w+\s+){0,2}experiments?\b"
    r"|평가|검증|어떤\s*실험|무슨\s*실험|실험\s*(?:방법|방식|설계|절차)",
    "limitations": r"\b(?:limitation\w*|restrict\w*|caveat\w*|failure\w*|exceptions?|except"
    r"|when does|under what conditions)\b|한계|제약|주의|실패|예외|적용\s*조건",
    "list": r"\b(?:list|enumerate|enumeration|what are)\b"
    r"|\b(?:which|what)(?:\s+(?:all|the|one|two|three|four|five|six|seven|eight|nine|ten|\d+))?"
    r"\s+(?:datasets|benchmarks|methods|components|inputs|steps|features|models|conditions"
    r"|factors|augmentations|transformations)\b"
    r"|\b(?:which|what)\s+(?:default|standard)\s+(?:augmentations|transformations)\b"
    r"|목록|나열|열거|모두|각각|어떤\s*(?:데이터셋|벤치마크|요소|입력|단계|요인|증강|변환)|무엇들"
    r"|(?:[한두세네다섯여섯일곱여덟아홉열]+|\d+)\s*가지",
    "numeric": r"\b(?:how much|how many|percentage|percent|numerical|number of|speedup"
    r"|accuracy|throughput)\b|얼마|몇|수치|정확도|처리량|속도|학습률|%",
}
# name, pattern asked for in the question, pattern looked for in the source
ASPECTS = (
    ("projection", r"\bprojection\b|투영", r"\bprojection\b"),
    ("cropping", r"\bcrop\w*\b|자르기|크롭", r"\bcrop\w*\b"),
    ("flip", r"\bflip\w*\b|뒤집기|플립", r"\bflip\w*\b"),
    ("resize", r"\bresiz\w*\b|크기\s*조정|리사이즈", r"\bresiz\w*\b"),
    ("shortcut", r"\bshortcuts?\b|지름길|편법", r"\b(?:shortcuts?|exploit\w*|conjectur\w*)\b"),
    (
        "linear_classifier",
        r"\blinear classifier\w*\b|(?<!비)선형\s*분류",
        r"\blinear (?:classifier\w*|evaluation)\b",
    ),
    ("scalar_parameter", r"\bscalar parameters?\b|스칼라\s*매개변수", r"\bscalar parameters?\b"),
    (
        "predicted_labels",
        r"\b(?:predicted labels?|class predictions?)\b|예측\s*(?:레이블|라벨|클래스)",
        r"\b(?:class predictions?|predicted labels?)\b",
    ),
)
TASK_ASKED = r"\b(?:prediction|predictive|pretext) tasks?\b|예측\s*과제"
TASK_IN_SOURCE = (
    r"\b(?:prediction|predictive|pretext) tasks?\b.*\b(?:aims?|identify|uses?|consists?)\b"
    r"|\bmaximiz\w* agreement\b"
)
OPERATIONS_ASKED = r"\b(?:augmentations?|transformations?)\b|증강|변환"
OPERATIONS_IN_SOURCE = (
    r"(?=.*\b(?:augment\w*|transform\w*|crop\w*)\b)"
    r"(?=.*\b(?:flip\w*|resiz\w*|blur\w*|distortion\w*)\b)"
    r"(?=.*\b(?:appl\w*|sequential\w*|includes?|consists?)\b)"
)
# markers found in the question, kinds they add for sentence scoring, hints they add
MARKERS = (
    ("evaluation", ("평가", "evaluate", "evaluation"),
     ("evaluation protocol", "dataset", "baseline", "metric", "experiment")),
    ("assumption", ("가정", "assumption", "required"),
     ("assumption", "setting", "model", "construction", "condition")),
    ("comparison", ("비교", "차이", "달라", "trade-off", "tradeoff"),
     ("comparison", "versus", "trade-off", "result")),
    ("conclusion", ("결론", "결과", "conclusion", "result"),
     ("main conclusion", "main result", "we show", "we find")),
    ("method", ("어떻게", "how", "방법", "framework"),
     ("method", "framework", "procedure", "first", "then")),
    ("connection", ("연결", "connect"), ("connect", "framework", "hierarchy", "inference")),
    ("focus", ("중점", "focus"), ("focus", "review", "emphasis", "specifically")),
)
COMPARISON_EXTRA = ("compared", "comparison")
KIND_HINTS = (
    ("evaluation",
     ("evaluation protocol", "dataset", "baseline", "metric", "experiment", "validation")),
    ("list", ("following", "include", "first", "second", "third")),
    ("limitations", ("limitation", "only", "except", "fails", "restricted")),
    ("numeric", ("number", "percentage", "measurement", "reported result")),
    ("definition", ("definition", "meaning", "means", "refers to")),
    ("causal", ("reason", "because", "cause", "explanation")),
)
BILINGUAL_TERMS = {
    "학습률": ("learning rate",),
    "모델 폭": ("model width", "model widths", "base width"),
    "메모리": ("memory",),
    "추론": ("inference",),
    "데이터셋": ("dataset", "datasets"),
    "기준 모델": ("baseline", "baselines"),
    "평가 지표": ("metric", "metrics"),
    "매개변수": ("parameter", "parameters"),
    "한계": ("limitation", "limitations"),
    "신뢰도": ("confidence",),
    "보정": ("calibration",),
    "확률": ("probability",),
    "정확도": ("accuracy",),
    "요인": ("factors", "affect", "important"),
    "깊이": ("depth",),
    "가중치 감쇠": ("weight decay",),
    "배치 정규화": ("batch normalization",),
    "증강": ("augmentation", "augmentations"),
    "색상": ("color",),
    "크롭": ("crop", "cropping"),
    "자르기": ("crop", "cropping"),
    "지름길": ("shortcut", "spurious"),
    "예측 과제": ("prediction task", "predictive task", "pretext task"),
    "분류": ("classification",),
    "표현": ("representation", "representations"),
    "프레임워크": ("framework",),
    "제안": ("introduce", "propose"),
    "신뢰도 보정": ("confidence calibration",),
    "비선형": ("nonlinear", "non-linear"),
    "선형": ("linear",),
    "투영": ("projection",),
    "헤드": ("head",),
    "제거 실험": ("ablation",),
    "스칼라": ("scalar",),
    "레이블": ("label", "class prediction"),
    "크기 조정": ("resize",),
    "뒤집기": ("flip",),
}
COMPOUND_SPLIT = (
    r"(?iuU)\s+and\s+(?=(?:what|which|how|why|when|does|do|at|against)\b)"
    r"|[?？]\s*(?=\S)|\s*그리고\s*"
)
SIMPLE_SPLIT = r"(?iuU)\s+and\s+|\s*(?:및|이며|이고)\s*"
AUTHOR_ATTRIBUTION = (
    r"(?U)\b[A-Z][A-Za-z'-]+\s+(?:and (?:colleagues|coauthors)|et al\.?)\b"
    r"|\b[A-Z][A-Za-z'-]+(?:와|과)\s*동료(?:들)?(?:이|은|는)?"
    r"|\b[A-Z][A-Za-z'-]+\s*등의\s*(?:논문에서|연구에서)?"
)
# ---------------------------------------------------------------------------------------


def matches(text: Column, pattern: str) -> Column:
    """Case-blind Unicode search."""
    return text.rlike("(?iuU)" + pattern)


def labels(pairs: list[tuple[Column, str]]) -> Column:
    """Sorted-in-place array of the labels whose condition holds."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in pairs]))


def language(question: Column) -> Column:
    return F.when(question.rlike(HANGUL), F.lit("ko")).otherwise(F.lit("en"))


def kinds(question: Column) -> Column:
    lowered = F.lower(question)
    tests = [(lowered.rlike("(?U)" + p), name) for name, p in KIND_PATTERNS.items()]
    return F.coalesce(labels(tests), F.array().cast("array<string>"))


def aspects(question: Column) -> Column:
    """Named source aspects the question asks for, in vocabulary order."""
    tests = [(matches(question, asked), name) for name, asked, _ in ASPECTS]
    tests.append((matches(question, TASK_ASKED), "prediction_task"))
    operations = F.array_contains(kinds(question), "list") & matches(question, OPERATIONS_ASKED)
    tests.append((operations, "augmentation_operations"))
    return labels(tests)


def plain_prose(sentence: Column) -> Column:
    return ~contains_any(sentence, SYMBOLS) & sentence.rlike(r"(?U)[.!?]\s*$")


def aspects_in_source(asked: Column, text: Column) -> Column:
    """Those of the ``asked`` aspects that ``text`` states."""
    tests = [
        (F.array_contains(asked, name) & matches(text, source), name) for name, _, source in ASPECTS
    ]
    task = F.exists(
        F.split(text, SENTENCE_GAP, -1),
        lambda sentence: matches(sentence, TASK_IN_SOURCE) & plain_prose(sentence),
    )
    tests.append((F.array_contains(asked, "prediction_task") & task, "prediction_task"))
    operations = matches(text, OPERATIONS_IN_SOURCE)
    tests.append(
        (F.array_contains(asked, "augmentation_operations") & operations, "augmentation_operations")
    )
    return labels(tests)


def parts(question: Column) -> Column:
    """Split a compound request into at most three parts of six characters or more.

    A later part is prefixed by the first, which carries the subject.
    """
    text = squeeze(question)
    compound = F.split(text, COMPOUND_SPLIT, -1)
    pieces = F.when(F.size(compound) > 1, compound).otherwise(F.split(text, SIMPLE_SPLIT, -1))
    trimmed = F.filter(
        F.transform(pieces, lambda p: F.regexp_replace(p, "^[ ,?？]+|[ ,?？]+$", "")),
        lambda p: F.length(p) >= 6,
    )
    kept = F.slice(F.when(F.size(trimmed) > 0, trimmed).otherwise(F.array(text)), 1, 3)
    return F.transform(
        kept,
        lambda piece, i: F.struct(
            F.concat(F.lit("request-"), (i + 1).cast("string")).alias("facet_id"),
            piece.alias("request"),
            F.when(i == 0, piece).otherwise(F.concat(kept[0], F.lit("; "), piece)).alias("query"),
        ),
    )


def scoring_kinds(question: Column) -> Column:
    """Answer shapes plus the broader kinds used to weigh sentences, sorted."""
    lowered = F.lower(question)
    extra = [
        (contains_any(lowered, found + (COMPARISON_EXTRA if name == "comparison" else ())), name)
        for name, found, _ in MARKERS
    ]
    return F.sort_array(F.array_distinct(F.concat(kinds(question), labels(extra))))


def asked_terms(question: Column) -> Column:
    """English forms of the Korean terms a question names, one array per term."""
    compact = F.regexp_replace(F.lower(question), r"(?U)\s+", "")
    found = F.array_compact(
        F.array(
            *[
                F.when(compact.contains(korean.replace(" ", "")), F.array(*map(F.lit, forms)))
                for korean, forms in BILINGUAL_TERMS.items()
            ]
        )
    )
    none = F.array().cast("array<array<string>>")
    return F.when(question.rlike(HANGUL), found).otherwise(none)


def selector_query(focus: Column, kind_array: Column, terms: Column) -> Column:
    """The scoring form of ``focus``: no author attribution, intent hints appended.

    ``kind_array`` and ``terms`` are its ``kinds`` and ``asked_terms``.
    """
    lowered = F.lower(focus)
    tests = [(contains_any(lowered, found), hints) for _, found, hints in MARKERS]
    tests += [(F.array_contains(kind_array, name), hints) for name, hints in KIND_HINTS]
    groups = F.array(
        *[
            F.when(test, F.array(*map(F.lit, words))).otherwise(F.array().cast("array<string>"))
            for test, words in tests
        ]
    )
    text = squeeze(F.regexp_replace(focus, AUTHOR_ATTRIBUTION, ""))
    return let(
        F.array_distinct(F.flatten(F.concat(groups, terms))),
        lambda hints: F.when(
            F.size(hints) > 0,
            F.concat(text, F.lit(" [intent: "), F.array_join(hints, ", "), F.lit("]")),
        ).otherwise(text),
    )
