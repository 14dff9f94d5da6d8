"""License scans: winnowed fingerprints find candidates, banded alignment reports the matches.

Templates and texts are words of letters and digits, case ignored. The hashes of all runs of four
words are winnowed: of every two neighbours the smaller is kept, so any five words in common share
a fingerprint. The fingerprints of all templates form an inverted index of fixed size; hits of a
text in it, grouped by template and diagonal, are the candidates. Each is aligned with its
template within a band around its diagonals; the best local alignment gives the matched coverage
of the template and the span in the text.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from citegrain.llm.common import PLAIN, arrow_pass, grams, joined, texts_of, word_hashes

RUN, WINDOW, BAND = 4, 2, 6

# Public license notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution."
    ),
}


def winnow(prints: np.ndarray) -> np.ndarray:
    """Places of the smallest hash of every window; a text of fewer hashes gives its smallest."""
    if len(prints) <= WINDOW:
        return np.array([prints.argmin()]) if len(prints) else np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(prints, WINDOW)
    return np.unique(windows.argmin(axis=1) + np.arange(len(windows)))


class LicenseIndex:
    """Fingerprint -> (template, word position), and the words of each template."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = [*templates]
        self.words = []
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, text in enumerate(templates.values()):
            words = word_hashes(text.encode().translate(PLAIN))[2]
            if len(words) < RUN + WINDOW - 1:
                raise ValueError(f"template {self.names[n]} has fewer than {RUN + WINDOW - 1} words")
            self.words.append(words.tolist())
            prints, _ = grams(words, np.zeros(len(words)), RUN)
            for at in winnow(prints):
                found[int(prints[at])].append((n, int(at)))
        self.prints = np.array(sorted(found), np.uint64)
        self.places = [found[int(p)] for p in self.prints]

    def candidates(self, words: np.ndarray, owner: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Owner -> sorted (template, diagonal, position) of its fingerprint hits."""
        prints, at = grams(words, owner, RUN)
        keep = winnow(prints)
        if not len(keep):
            return {}
        slot = np.minimum(np.searchsorted(self.prints, prints[keep]), len(self.prints) - 1)
        found: dict[int, list] = defaultdict(list)
        for k in np.flatnonzero(self.prints[slot] == prints[keep]):
            place = int(at[keep[k]])
            for n, position in self.places[slot[k]]:
                found[int(owner[place])].append((n, place - position, place))
        return {o: sorted(hits) for o, hits in found.items()}


def align(template: list[int], words: list[int], low: int, high: int) -> tuple[int, int, int, int]:
    """Best local alignment within diagonals low..high: score, matched words, first and last word.

    A match scores 1, a difference, an extra or a missing word costs 1. Of equal scores the one
    that ends nearest to the middle of the band counts.
    """
    none = (0, 0, -1, -1)
    best, off, above = none, 0.0, {}
    for i, word in enumerate(template):
        row: dict[int, tuple[int, int, int, int]] = {}
        for j in range(max(0, i + low), min(len(words), i + high + 1)):
            score, matched, start, _ = above.get(j - 1, none)
            if word == words[j]:
                cell = (score + 1, matched + 1, j if start < 0 else start, j)
            else:
                cell = max(
                    (score - 1, matched, start, above.get(j - 1, none)[3]),
                    _down(above.get(j, none)), _down(row.get(j - 1, none)),
                )
                if cell[0] <= 0:
                    continue
            row[j] = cell
            away = abs(j - i - (low + high) / 2)
            if cell[0] > best[0] or cell[0] == best[0] and away < off:
                best, off = cell, away
        above = row
    return best


def _down(cell: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    return (cell[0] - 1, *cell[1:])


def _matches(
    index: LicenseIndex, hits: list[tuple[int, int, int]], words: np.ndarray, low: int, high: int, least: float
) -> list[tuple[int, int, int, int]]:
    """(first word, last word, template, matched) of each candidate that covers enough.

    `low` and `high` bound the words of the text.
    """
    found = []
    for n, group in groupby(hits, key=lambda h: h[0]):
        template = index.words[n]
        for first, last in _runs([h[1:] for h in group], len(template)):
            start, end = max(low, first - BAND), min(high, last + BAND + len(template))
            part = words[start:end].tolist()
            _, matched, a, b = align(template, part, first - BAND - start, last + BAND - start)
            if matched >= least * len(template):
                found.append((start + a, start + b, n, matched))
    return sorted(set(found))


def _runs(hits: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Lowest and highest diagonal of each candidate copy of a template.

    In the order of the text, a hit continues a run if it is at most BAND diagonals away and later
    in the template; else it begins a run. Runs that the text has left behind are closed.
    """
    closed, running = [], []
    for diagonal, place in sorted(hits, key=lambda h: (h[1], h[0])):
        closed += [r for r in running if place - r[4] > size + BAND]
        running = [r for r in running if place - r[4] <= size + BAND]
        for run in running:
            if abs(diagonal - run[2]) <= BAND and place - diagonal > run[3]:
                run[:] = [min(run[0], diagonal), max(run[1], diagonal), diagonal, place - diagonal, place]
                break
        else:
            running.append([diagonal, diagonal, diagonal, place - diagonal, place])
    return sorted({(r[0], r[1]) for r in closed + running})


def scan(
    df: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8
) -> DataFrame:
    """One row for each match: doc_id, license, coverage, matched_words, start, end (code points).

    A template is matched where `least` of its words stand in the text in order. Texts that are
    null or hold none give no row; a text that repeats a notice gives a row for each place.
    """
    shared = df.sparkSession.sparkContext.broadcast(LicenseIndex(TEMPLATES if templates is None else templates))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = shared.value
        texts = [t.encode() for t in texts_of(batch.column("text"))]
        data, offsets = joined([t.translate(PLAIN) for t in texts])
        starts, ends, words = word_hashes(data)
        owner = np.searchsorted(offsets, starts, "right") - 1
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        rows: list[tuple] = []
        for o, hits in sorted(index.candidates(words, owner).items()):
            raw = np.frombuffer(texts[o], np.uint8)
            points = None
            for a, b, n, matched in _matches(index, hits, words, bounds[o], bounds[o + 1], least):
                if points is None:
                    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                rows.append((
                    o, index.names[n], matched / len(index.words[n]), matched,
                    int(points[starts[a] - offsets[o]]), int(points[ends[b] - offsets[o]]),
                ))
        columns = [*zip(*rows, strict=True)] or [()] * 6
        kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(columns[0], pa.int64())),
             *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))],
            ["doc_id", "license", "coverage", "matched_words", "start", "end"],
        )

    return arrow_pass(
        df.select("doc_id", "text"), step,
        f"doc_id {dict(df.dtypes)['doc_id']}, license string, coverage double, matched_words int, "
        "start int, end int",
    )
