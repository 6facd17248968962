"""Find licence notices: winnowed fingerprints pick candidates, a banded alignment measures them.

The fingerprints of a template are hashes of its word pairs, winnowed and held in an
inverted index. How wide the winnowing windows are follows from template and coverage:
words may be changed, dropped and put in, but the matched words of any notice hold a
run of some length, and a window as long as that run's pairs is sure to choose a pair
of it on both sides. Where the run may be as short as two words, as with short
templates or loose coverage, the window is one and all pairs are kept. Stretches with
enough fingerprints are aligned from every start, inside the band of diagonals that
the allowed number of lacking and inserted words leaves. Of notices that overlap the
one that explains the words best is reported.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.text_arrays import TO_LOWER, Block, blocks, window_hashes

# Wording of public licence notices.
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met"
)
BSD_2 = (
    f"{BSD}: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"'
TEMPLATES = {
    "Apache-1.1": "Licensed under the Apache License, Version 1.1.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "BSD": BSD,  # the sentence that the BSD licences share
    "BSD-2-Clause": f"{BSD_2} {DISCLAIMER}",
    "BSD-3-Clause": (
        f"{BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        f"promote products derived from this software without specific prior written permission. {DISCLAIMER}"
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "MPL-1.1": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
for _name, _title, _versions in (
    ("GPL", "General Public", "123"), ("LGPL", "Lesser General Public", ("2.1", "3")),
    ("LGPL", "Library General Public", "2"), ("AGPL", "Affero General Public", "3"),
):
    for _v in _versions:
        _id = f"{_name}-{_v if '.' in _v else _v + '.0'}"
        TEMPLATES[_id] = f"This work is licensed under the GNU {_title} License, version {_v}."
        TEMPLATES[f"{_id}-header"] = (
            f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {_title} "
            f"License as published by the Free Software Foundation, either version {_v} of the License, or (at your option) any "
            "later version."
        )
for _name, _title in (
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
):
    for _v, _reach in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        TEMPLATES[f"CC-{_name}-{_v}"] = f"Licensed under CC {_name} {_v}."
        TEMPLATES[f"CC-{_name}-{_v}-title"] = f"This work is licensed under a Creative Commons {_title} {_v} {_reach} License."

COVERAGE = 0.8  # least share of matched words in a template and in its span
MAX_TEMPLATE_WORDS = 1_000_000  # of all templates together: the index goes to every task
CELLS = 1 << 20  # of the alignments made at once
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
FOUND = "doc_id long, license string, coverage double, n_matched long, start long, stop long"


def words_of(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and document of the words: runs of letters, digits and bytes beyond ASCII."""
    low = TO_LOWER[block.data]
    low = np.where(WORD[low], low, np.uint8(32))
    starts, ends, owner = block.words(low)
    return block.hasher(low)(starts, ends), starts, ends, owner


def widest(n_words: int, coverage: float) -> int:
    """Words of the longest span that can still be a notice of a template of ``n_words``."""
    return math.floor(n_words / coverage + 1e-9)


def sure_pairs(n_words: int, coverage: float) -> int:
    """Equal word pairs that every notice of a template of ``n_words`` shares with it at least.

    A span of L words with m matched has at most (n_words - m) + (L - m) breaks in
    the run of matched words, and a pair less than words in each run.
    """
    least = n_words
    for span in range(1, widest(n_words, coverage) + 1):
        m = math.ceil(coverage * max(n_words, span) - 1e-9)
        if m <= span:
            least = min(least, m - 1 - (n_words - m) - (span - m))
    return max(0, least)


def least_run(n_words: int, coverage: float) -> int:
    """Matched words in a row that every notice of a template of ``n_words`` holds at least."""
    least = n_words
    for span in range(1, widest(n_words, coverage) + 1):
        m = math.ceil(coverage * max(n_words, span) - 1e-9)
        if m <= min(span, n_words):
            least = min(least, -(-m // (n_words - m + span - m + 1)))
    return least


def winnow(at: np.ndarray, values: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Which fingerprints are the least of a window of consecutive ones of their document."""
    if window == 1 or len(values) < window:
        return np.arange(len(values)) if window == 1 else np.zeros(0, np.int64)
    inside = owner[at[: len(at) - window + 1]] == owner[at[window - 1 :]]
    least = np.lib.stride_tricks.sliding_window_view(values, window)[inside].argmin(1)
    return np.unique(np.flatnonzero(inside) + least)


class Index:
    """Fingerprints of the templates, by words in them and winnowing window, and which stand in which template."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.names, self.words, self.need = [], [], []
        grams: dict[tuple[int, int], list] = {}
        for name, text in templates.items():
            raw = np.frombuffer(text.encode(), np.uint8)
            hashes, _, _, owner = words_of(Block(raw, np.array([0, len(raw)]), 0))
            if not len(hashes):
                continue
            window = max(1, least_run(len(hashes), coverage) - 1)
            # One fingerprint is sure with wider windows; all pairs allow to ask for more of them.
            # Where a notice need not share a pair, it shares a word at least.
            need = 1 if window > 1 else sure_pairs(len(hashes), coverage)
            size = 2 if need else 1
            at, values = window_hashes(hashes, owner, size) if size == 2 else (np.arange(len(hashes)), hashes)
            chosen = np.unique(values[winnow(at, values, owner, window)])
            grams.setdefault((size, window), []).append((len(self.names), chosen))
            self.names.append(name)
            self.words.append(hashes)
            self.need.append(need or math.ceil(coverage * len(hashes) - 1e-9))
        if sum(map(len, self.words)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates hold over {MAX_TEMPLATE_WORDS} words; scan with parts of them")
        self.known, self.members = {}, {}
        for kind, some in grams.items():
            self.known[kind] = np.unique(np.concatenate([g for _, g in some]))
            self.members[kind] = [(t, np.isin(self.known[kind], g)) for t, g in some]

    def ranked(self, t: int, begin: int, span: int, m: int) -> tuple:
        """A notice as a tuple that sorts better ones first."""
        whole = max(len(self.words[t]), span)
        return whole - 2 * m, -m / whole, span, begin, self.names[t], m, t

    def candidates(self, hashes: np.ndarray, owner: np.ndarray, coverage: float) -> Iterator[tuple[int, int, int]]:
        """Template, first and past-last word of every stretch in which notices may begin; they reach no further than ``widest``."""
        for (kind, window), known in self.known.items():
            if not len(known) or len(hashes) < kind:
                continue
            at, values = window_hashes(hashes, owner, 2) if kind == 2 else (np.arange(len(hashes)), hashes)
            chosen = winnow(at, values, owner, window)
            at, values = at[chosen], values[chosen]
            spot = np.minimum(np.searchsorted(known, values), len(known) - 1)
            hit = known[spot] == values
            at, spot = at[hit], spot[hit]
            for t, member in self.members[kind, window]:
                own = at[member[spot]]
                need, reach = self.need[t], widest(len(self.words[t]), coverage)
                if len(own) < need:
                    continue
                # ``need`` hits that stand in one window of a document.
                first, last = own[: len(own) - need + 1], own[need - 1 :]
                near = (last - first <= reach - kind) & (owner[first] == owner[last])
                first, last = first[near], last[near]
                if not len(first):
                    continue
                begin = np.maximum(last + kind - reach, np.searchsorted(owner, owner[first]))
                cut = np.append(True, begin[1:] > first[:-1] + 1)
                cut[1:] |= owner[first[1:]] != owner[first[:-1]]
                heads = np.flatnonzero(cut)
                tails = np.append(heads[1:], len(first)) - 1
                # Begins grow with the hits, so the first of a stretch is its least.
                for a, b in zip(begin[heads].tolist(), first[tails].tolist()):
                    yield t, a, b + 1


def align(template: np.ndarray, text: np.ndarray, begins: np.ndarray, coverage: float) -> list[tuple[int, int, int]]:
    """Of each place in ``begins`` the best notice that begins there: place, words of the span, matched words.

    The matched words are a longest common subsequence of template and span. The
    best span has most matched words when those that it lacks or adds are taken off.
    A matched word stands at most ``lacking`` words earlier and ``added`` words later in
    the span than in the template, so only this band of the table is worked out.
    """
    n, width = len(template), widest(len(template), coverage)
    lacking = math.floor(n - coverage * n + 1e-9)
    added = math.floor(width - coverage * width + 1e-9)
    begins = begins[np.isin(text[begins], template)]
    spans = np.arange(1, width + 1)
    whole = np.maximum(n, spans)
    out = []
    chunk = max(1, CELLS // width)
    for i in range(0, len(begins), chunk):
        some = begins[i : i + chunk]
        places = some[:, None] + np.arange(width)
        inside = places < len(text)
        near = text[np.where(inside, places, 0)]
        # A span has as many matched words at most as words of the template: most stretches end here.
        possible = np.cumsum(inside & np.isin(near, template), 1)
        alive = (possible >= coverage * whole - 1e-9).any(1)
        some, near, inside = some[alive], near[alive], inside[alive]
        if not len(some):
            continue
        best = np.zeros((len(some), width + 1), np.int32)
        for i, word in enumerate(template):
            low, high = max(0, i - lacking), min(width, i + added + 1)
            row = best[:, low : high + 1].copy()
            np.maximum(row[:, 1:], row[:, :-1] + ((near[:, low:high] == word) & inside[:, low:high]), out=row[:, 1:])
            best[:, low : high + 1] = np.maximum.accumulate(row, axis=1)
        # Only spans that end in a matched word.
        fits = (best[:, 1:] > best[:, :-1]) & (best[:, 1:] >= coverage * whole - 1e-9)
        score = np.where(fits, 2 * best[:, 1:] - whole, -n - width)
        at = score.argmax(1)
        rows = np.flatnonzero(fits.any(1))
        out += zip(some[rows].tolist(), spans[at[rows]].tolist(), best[rows, at[rows] + 1].tolist())
    return out


def scan(templates: dict[str, str], coverage: float):
    index = Index(templates, coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for block in blocks(batch.column("text")):
                hashes, starts, ends, owner = words_of(block)
                found: dict[int, list[tuple]] = {}
                for t, a, b in index.candidates(hashes, owner, coverage):
                    doc = int(owner[a])
                    last = min(int(np.searchsorted(owner, doc, side="right")), b + widest(len(index.words[t]), coverage))
                    some = align(index.words[t], hashes[a:last], np.arange(b - a), coverage)
                    found.setdefault(doc, []).extend(index.ranked(t, a + begin, span, m) for begin, span, m in some)
                for doc, some in found.items():
                    rows += [(ids[block.first + doc], *r) for r in _notices(index, block, hashes, starts, ends, owner, doc, some, coverage)]
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            cells = zip(*rows) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(cells, kinds)],
                names=["doc_id", "license", "coverage", "n_matched", "start", "stop"],
            )

    return run


def _notices(index, block, hashes, starts, ends, owner, doc, found, coverage) -> Iterator[tuple]:
    """The best of the notices that share words, as rows."""
    first, last = np.searchsorted(owner, [doc, doc + 1])
    taken = np.zeros(last - first, bool)
    own = block.data[block.offsets[doc] : block.offsets[doc + 1]]
    points = np.append(0, np.cumsum((own & 0xC0) != 0x80))
    heapify(found)
    while found:
        _, less, span, begin, name, m, t = heappop(found)
        at, template = begin - first, index.words[t]
        if not taken[at : at + span].any():
            taken[at : at + span] = True
            a, b = starts[begin] - block.offsets[doc], ends[begin + span - 1] - block.offsets[doc]
            yield name, -less, m, int(points[a]), int(points[b])
            continue
        # A shorter span may still end before the notice that took some of its words.
        free = int(taken[at : at + span].argmax())
        if free >= coverage * len(template) - 1e-9:
            for _, span, m in align(template, hashes[begin : begin + free], np.arange(1), coverage):
                heappush(found, index.ranked(t, begin, span, m))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, license, coverage, n_matched, start, stop``: one row for each notice found.

    ``coverage`` is the number of matched words by the words of the template or of
    the span, whichever are more, so words that are put in count as much as words
    left out; every span that reaches the given one is a candidate. ``start`` and
    ``stop`` count code points of the whole text. Of notices that share words the
    one with most matched words less lacking or added ones counts, then the higher
    coverage, the shorter span, the earlier place and the name.

    Nulls: a null or empty text has no notices; a null doc_id stays null. Repeated
    rows are reported each. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scan(templates or TEMPLATES, coverage), FOUND)
