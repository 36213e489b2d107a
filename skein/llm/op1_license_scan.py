"""License scan: winnowed template fingerprints pick candidates, banded alignment confirms them.

Templates are word sequences (A-Z in lower case, digits, letters). Hashes of GRAM consecutive words are
winnowed: of every WINNOW neighbouring hashes the smallest is a fingerprint, so any common stretch of
GRAM + WINNOW - 1 words shares one (texts are winnowed, of templates every gram is indexed). An inverted index leads from fingerprints to templates and
positions. Hits of one template that lie on nearly the same diagonal of text and template form a
candidate; a local alignment of that part of the text with the template, in a band around the
diagonal, yields the matched words, the coverage (matched words / words of the template) and the span
in the text. Candidates below MIN_COVERAGE are dropped; of overlapping matches the one with more
matched words stays (then larger coverage, then the smaller name).

The templates are a parameter whose total size is checked (MAX_TEMPLATE_WORDS), so they are broadcast;
texts are read whole, and each by itself. Null and empty texts have no match. Repeated rows each give
their rows. Other columns, of any name, are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffers
from .words import alphanumeric, rolled, word_hashes

GRAM, WINNOW = 3, 2
MIN_COVERAGE = 0.7
MAX_TEMPLATE_WORDS = 2_000_000
_WORD = alphanumeric()

#: fixed values: notices by which works name their license
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                   'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
                   "either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
            "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
}


class TemplateIndex:
    def __init__(self, templates: dict[str, list[str]]):
        self.names, self.words, postings = [], [], []
        for name in sorted(templates):
            for text in templates[name]:
                raw, offsets = text_buffers(pa.array([text]))
                h = word_hashes(raw, offsets, _WORD)[0]
                g = rolled(h, GRAM)
                t = len(self.names)
                self.names.append(name)
                self.words.append(h)
                # every gram is indexed, the texts' grams are winnowed: a text's fingerprint then meets
                # the template's gram whatever stands around it
                postings += [(int(x), t, p) for p, x in enumerate(g)]
        if sum(map(len, self.words)) > MAX_TEMPLATE_WORDS:
            raise ValueError("too many template words to broadcast")
        postings.sort()
        self.gram = np.array([p[0] for p in postings], np.uint64)
        self.template = np.array([p[1] for p in postings], np.int64)
        self.place = np.array([p[2] for p in postings], np.int64)


def align(text: list[int], template: list[int], shift: int, band: int) -> tuple[int, int, int]:
    """Matched words, first and end word of the best local alignment of ``template`` with ``text``, where
    template word j may only meet text words shift + j - band ... shift + j + band.

    Match 2, mismatch or gap -1."""
    width = 2 * band + 1
    best = (0, 0, 0, 0)  # score, matched, first, end
    above = [(0, 0, -1)] * (width + 1)  # score, matched, first text word of the path
    for j, w in enumerate(template):
        row, left = [], (0, 0, -1)
        for k in range(width):
            i = shift + j - band + k
            if not 0 <= i < len(text):
                row.append((0, 0, -1))
                left = (0, 0, -1)
                continue
            s, m, f = above[k]
            if text[i] == w:
                cell = (s + 2, m + 1, f if s > 0 else i)
            else:
                cell = (s - 1, m, f)
            up, side = above[k + 1], left
            if up[0] - 1 > cell[0]:
                cell = (up[0] - 1, up[1], up[2])
            if side[0] - 1 > cell[0]:
                cell = (side[0] - 1, side[1], side[2])
            if cell[0] <= 0:
                cell = (0, 0, -1)
            row.append(cell)
            left = cell
            if cell[0] > best[0]:
                best = (cell[0], cell[1], cell[2], i + 1)
        above = [*row, (0, 0, -1)]
    return best[1:]


def matches(h: np.ndarray, at: np.ndarray, index: TemplateIndex, min_coverage: float) -> list[tuple[int, int, int, int]]:
    """(template, matched, first word, end word) of a text, given its fingerprints' positions that hit."""
    g = rolled(h, GRAM)[at]
    low, high = np.searchsorted(index.gram, g, "left"), np.searchsorted(index.gram, g, "right")
    hits = defaultdict(list)
    for p, a, b in zip(at.tolist(), low.tolist(), high.tolist()):
        for k in range(a, b):
            hits[int(index.template[k])].append((p, p - int(index.place[k])))
    found = []
    for t, places in hits.items():
        n = len(index.words[t])
        band = 3 + n // 16
        groups: list[list[tuple[int, int]]] = []
        open_groups: dict[int, int] = {}  # diagonal // band -> newest group
        for p, d in places:
            own = next((g for key in (d // band, d // band - 1, d // band + 1)
                        if (g := open_groups.get(key)) is not None and p - groups[g][-1][0] <= n and abs(groups[g][0][1] - d) <= band), None)
            if own is None:
                own = len(groups)
                groups.append([])
                open_groups[d // band] = own
            groups[own].append((p, d))
        for group in groups:
            shift = sorted(d for _, d in group)[len(group) // 2]
            low = max(0, shift - band)
            text = h[low:shift + n + band + 1].tolist()
            matched, first, end = align(text, index.words[t].tolist(), shift - low, band)
            if matched >= min_coverage * n:
                found.append((t, matched, low + first, low + end))
    found.sort(key=lambda x: (-x[1], -x[1] / len(index.words[x[0]]), index.names[x[0]], x[2]))
    kept: list[tuple[int, int, int, int]] = []
    for x in found:
        if all(x[3] <= y[2] or x[2] >= y[3] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: x[2])


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text",
         min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """id, license, start, stop (byte range in the UTF-8 text), n_matched, n_template and coverage of every match."""
    index = TemplateIndex(templates or TEMPLATES)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    part = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    kind = part.schema.fields[0].dataType.simpleString()
    names = [id_col, "license", "start", "stop", "n_matched", "n_template", "coverage"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets):
                base = offsets[i:j + 1] - offsets[i]
                h, bounds, begin, stop = word_hashes(raw[offsets[i]:offsets[j]], base, _WORD)
                g = rolled(h, GRAM)
                # a gram is a fingerprint if it is the smallest of some WINNOW neighbours
                chosen = np.zeros(len(g), bool)
                if len(g) >= WINNOW:
                    view = np.lib.stride_tricks.sliding_window_view(g, WINNOW)
                    chosen[view.argmin(axis=1) + np.arange(len(view))] = True
                # at a text's ends fewer neighbours compete
                for edge in (bounds[:-1], bounds[1:] - GRAM):
                    chosen[edge[(edge >= 0) & (edge < len(g))]] = True
                place = np.searchsorted(index.gram, g).clip(max=max(0, len(index.gram) - 1))
                hit = np.flatnonzero(chosen & (index.gram[place] == g)) if len(index.gram) else np.zeros(0, np.int64)
                owner = np.searchsorted(bounds, hit, side="right") - 1
                ok = hit + GRAM <= bounds[owner + 1] if len(hit) else np.zeros(0, bool)
                hit, owner = hit[ok], owner[ok]
                rows = []
                for k in np.unique(owner).tolist():
                    a, b = bounds[k], bounds[k + 1]
                    for t, matched, first, end in matches(h[a:b], hit[owner == k] - a, index, min_coverage):
                        n = len(index.words[t])
                        rows.append((i + k, index.names[t], int(begin[a + first] - base[k]), int(stop[a + end - 1] - base[k]), matched, n, matched / n))
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()),
                                                      *(pa.array(c, pa.int64()) for c in cols[2:6]), pa.array(cols[6], pa.float64())], names=names)

    return part.mapInArrow(run, f"`{id_col}` {kind}, license string, start bigint, stop bigint, n_matched bigint, n_template bigint, coverage double")
