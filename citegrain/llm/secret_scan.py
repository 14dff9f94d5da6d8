"""Secret scans with one automaton for all rules.

The rules' regular expressions become one nondeterministic automaton over bytes; subset
construction makes it deterministic, minimisation merges equal states, and the result is a
transition array for each state. One pass over the bytes of a line runs every rule at once; a line
that holds a match of any rule ends in the one accepting state. Only such lines are measured by
the rules' own expressions, which give the exact spans. No rule reaches across a line break, which
compiling checks.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from citegrain.llm.common import arrow_pass, texts_of


@dataclass(frozen=True)
class Rule:
    """`scan` finds lines, `span` the leftmost matches in them; `group` must have `least` characters.

    Every match of `span` that is long enough holds a match of `scan`, which asks for fewer
    characters after a telling prefix, as counting keeps a state for each character.
    """

    kind: str
    scan: str
    span: str
    group: int = 0
    least: int = 0
    any_case: bool = False


# The base rules.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4}""",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 8, True,
    ),
    Rule("access", r"AKIA[A-Z0-9]{4}", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32}", r"[0-9a-f]+", 0, 32),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule(
        "jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ",
        r"eyJ[A-Za-z0-9_-]{4,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}",
    ),
)
RULES = BASE_RULES + MORE_RULES


class _Nfa:
    """States with byte arcs and empty arcs, built from parsed expressions."""

    def __init__(self) -> None:
        self.arcs: list[list[tuple[frozenset[int], int]]] = [[]]
        self.empty: list[list[int]] = [[]]

    def state(self) -> int:
        self.arcs.append([])
        self.empty.append([])
        return len(self.arcs) - 1

    def add(self, tree: list, at: int, any_case: bool) -> int:
        """Appends the expression after state `at`; returns its last state."""
        for kind, value in tree:
            if kind in (C.LITERAL, C.IN):
                last = self.state()
                self.arcs[at].append((self._bytes(kind, value, any_case), last))
                at = last
            elif kind is C.SUBPATTERN:
                at = self.add(value[3], at, any_case)
            elif kind is C.BRANCH:
                last = self.state()
                for branch in value[1]:
                    self.empty[self.add(branch, at, any_case)].append(last)
                at = last
            elif kind is C.MAX_REPEAT:
                least, most, body = value
                for _ in range(least):
                    at = self.add(body, at, any_case)
                if most is C.MAXREPEAT:
                    self.empty[at].append(loop := self.state())
                    self.empty[self.add(body, loop, any_case)].append(loop)
                    at = loop
                else:
                    last = self.state()
                    for _ in range(most - least):
                        self.empty[at].append(last)
                        at = self.add(body, at, any_case)
                    self.empty[at].append(last)
                    at = last
            else:
                raise ValueError(f"a scan rule can't hold {kind}")
        return at

    @staticmethod
    def _bytes(kind: object, value: object, any_case: bool) -> frozenset[int]:
        found: set[int] = set()
        for what, x in [(kind, value)] if kind is C.LITERAL else value:
            if what not in (C.LITERAL, C.RANGE):
                raise ValueError(f"a class can't hold {what}")
            found |= {x} if what is C.LITERAL else {*range(x[0], x[1] + 1)}
        if any_case:
            found |= {b ^ 32 for b in found if chr(b).isalpha()}
        return frozenset(found)

    def close(self, states: set[int]) -> frozenset[int]:
        todo = [*states]
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return frozenset(states)


def compile_rules(rules: tuple[Rule, ...]) -> np.ndarray:
    """Transitions [state, byte] of the smallest automaton; state 0 starts, the last one accepts."""
    nfa = _Nfa()
    ends = {nfa.add(_parser.parse(r.scan), 0, r.any_case) for r in rules}
    classes: dict[tuple[int, ...], list[int]] = {}
    sets = sorted({b for arcs in nfa.arcs for b, _ in arcs}, key=sorted)
    for byte in range(256):
        classes.setdefault(tuple(k for k, b in enumerate(sets) if byte in b), []).append(byte)
    first = nfa.close({0})
    names, rows, todo = {first: 0}, [], [first]
    accept = -1
    for states in todo:
        row = []
        for members in classes.values():
            byte = members[0]
            onward = nfa.close({t for s in states for b, t in nfa.arcs[s] if byte in b} | {0})
            if onward & ends:
                row.append(accept)
                continue
            if onward not in names:
                names[onward] = len(names)
                todo.append(onward)
            row.append(names[onward])
        rows.append(row)
    table = np.array([*rows, [accept] * len(classes)])
    table[table == accept] = len(rows)
    table = _minimise(table)
    full = np.empty((len(table), 256), np.int32)
    for k, members in enumerate(classes.values()):
        full[:, members] = table[:, [k]]
    if full[:-1, 10].any():
        raise ValueError("a rule reaches across a line break")
    return full


def _minimise(table: np.ndarray) -> np.ndarray:
    """Merges states that no input tells apart; keeps state 0 first and the accepting one last."""
    block = np.zeros(len(table), np.int64)
    block[-1] = 1
    while True:
        _, new = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        new = new.reshape(-1)
        if new.max() == block.max():
            break
        block = new
    _, keep = np.unique(block, return_index=True)
    keep = np.sort(keep)
    place = np.empty(len(keep), np.int64)
    place[block[keep]] = np.arange(len(keep))
    return place[block[table[keep]]]


class SecretScanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.table = compile_rules(rules)
        self._prepare()

    def _prepare(self) -> None:
        self.start = self.accept = None
        self.spans_of = [re.compile(r.span, re.ASCII | (re.IGNORECASE if r.any_case else 0)) for r in self.rules]

    def __getstate__(self) -> dict:
        return {"rules": self.rules, "table": self.table}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._prepare()

    def _rows(self) -> None:
        rows: list[list] = [[] for _ in self.table]
        for row, targets in zip(rows, self.table.tolist(), strict=True):
            row.extend([rows[t] for t in targets])
        self.start, self.accept = rows[0], rows[-1]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule number, end) of every secret, in code points, in order."""
        if self.start is None:
            self._rows()
        start, accept = self.start, self.accept
        hits = []
        for k, line in enumerate(text.encode().split(b"\n")):
            row = start
            for byte in line:
                row = row[byte]
            if row is accept:
                hits.append(k)
        if not hits:
            return []
        lines = text.split("\n")
        offsets = np.concatenate(([0], np.cumsum([len(line) + 1 for line in lines])))
        found = []
        for k in hits:
            at = int(offsets[k])
            for n, (rule, expression) in enumerate(zip(self.rules, self.spans_of, strict=True)):
                found += [
                    (at + m.start(), n, at + m.end())
                    for m in expression.finditer(lines[k]) if len(m[rule.group]) >= rule.least
                ]
        return sorted(found)


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, secrets): all secrets of each text, as an array of kind, start, end.

    A null text counts as empty and has none. Repeated rows are scanned each.
    """
    shared = df.sparkSession.sparkContext.broadcast(SecretScanner(rules))
    kind = "array<struct<kind:string,start:int,end:int>>"
    parts = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner = shared.value
        found = [
            [(scanner.rules[n].kind, a, b) for a, n, b in scanner.spans(t)]
            for t in texts_of(batch.column("text"))
        ]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"),
             pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in found], parts)],
            ["doc_id", "secrets"],
        )

    return arrow_pass(
        df.select("doc_id", "text"), step, f"doc_id {dict(df.dtypes)['doc_id']}, secrets {kind}"
    )


def digests(df: DataFrame) -> DataFrame:
    """doc_id, the base kinds' counts, base_sha256 and the spans, from the scanned secrets."""
    shared = df.sparkSession.sparkContext.broadcast(SecretScanner())
    kinds = [r.kind for r in BASE_RULES]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner = shared.value
        told = [
            [(scanner.rules[n].kind, f"{scanner.rules[n].kind}:{a}:{b}") for a, n, b in scanner.spans(t)]
            for t in texts_of(batch.column("text"))
        ]
        base = [",".join(x for k, x in row if k in kinds) for row in told]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"),
             *(pa.array([sum(k == kind for k, _ in row) for row in told], pa.int64()) for kind in kinds),
             pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()),
             pa.array([",".join(x for _, x in row) for row in told], pa.string())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )

    return arrow_pass(
        df.select("doc_id", "text"), step,
        f"doc_id {dict(df.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, "
        "base_sha256 string, spans string",
    )
