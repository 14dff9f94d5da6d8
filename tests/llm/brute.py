"""Plain versions of the operators for small inputs, written from their contracts."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate(LOWER))


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.root(a)] = self.root(b)


def jaccard_components(rows):
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    union, holders = Union(), defaultdict(set)
    for s in {s for s in sets if s}:
        met = defaultdict(int)
        for x in s:
            for other in holders[x]:
                met[other] += 1
            holders[x].add(s)
        for other, common in met.items():
            if 100 * common >= 80 * (len(s) + len(other) - common):
                union.join(s, other)
    least = {}
    for (doc_id, _), s in zip(rows, sets):
        if s and doc_id is not None:
            root = union.root(s)
            least[root] = min(least.get(root, doc_id), doc_id)
    return [
        (doc_id, len(s), least.get(union.root(s)) if s else doc_id) for (doc_id, _), s in zip(rows, sets)
    ]


def leaks(documents, items):
    """(doc_id, item_id) where 13 aligned words, or a whole shorter item, agree in four fifths."""
    found = set()
    for item_id, item in items:
        b = plain_words(item)
        n = min(13, len(b))
        for doc_id, text in documents:
            a = plain_words(text)
            for shift in range(-len(b) + 1, len(a)):
                same = [0 <= k + shift < len(a) and a[k + shift] == b[k] for k in range(len(b))]
                if any(sum(same[k : k + n]) >= 0.8 * n for k in range(len(b) - n + 1)):
                    found.add((doc_id, item_id))
                    break
    return found


def edit_distance(a, b):
    above = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        above = row
    return above[-1]


def secrets(text, rules):
    """(start, rule number, end) by each rule's own expression over the whole text."""
    found = []
    for n, rule in enumerate(rules):
        flags = re.ASCII | (re.IGNORECASE if rule.any_case else 0)
        found += [
            (m.start(), n, m.end())
            for m in re.finditer(rule.span, text, flags) if len(m[rule.group]) >= rule.least
        ]
    return sorted(found)
