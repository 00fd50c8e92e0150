"""Licence scan: lines and paragraphs of documents compared with licence templates.

Both are normalised to lower-case words of letters, digits and non-ASCII characters. A unit of text (each line, and
each paragraph between blank lines) and a template are compared by the Dice coefficient of their sets of word
bigrams, 2 * common / (own + the template's). Only templates whose set size lets the threshold be reached are
compared; a unit without any bigram of a template of admissible size has no match. A unit of one word has none.

A notice counts only with the words that make it one licence's: of templates of fewer than ``SHORT`` bigrams (identifier
lines, headings) all bigrams must be there, of longer ones those of the name and version in ``NAMES``. So a phrase or
line about another licence, version or identifier is no match, however alike.

Besides, windows of words across lines and blank lines are compared with the templates and with whole licence texts
(``licence_texts``). The best window from each place of a template's bigrams on counts, up to the admissible size.
Of windows that overlap the one of the greater Dice counts; one that overlaps a matching unit doesn't, unless its
template is beyond the admissible sizes of the other's: then it replaces units and windows that it overlaps.

Cases: a null or empty text has no unit; of equally good templates the first by name counts; repeated rows are
scanned each by itself; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import ALNUM, Block, blocks, column, output, window_hashes, within, word_hashes, words

THRESHOLD = 0.8

#: Licence notices, by identifier and number.
TEMPLATES: dict[str, str] = {
    "Apache-2.0/1": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/2": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause/1": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause/1": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-3-Clause/2": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0/1": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0/1": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0/1": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0/1": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0/1": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0/2": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0/1": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/2": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0/3": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "ISC/1": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
    "LGPL-3.0/1": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0/2": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "MIT/1": "Released under the MIT License.",
    "MIT/2": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0/1": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense/1": "This is free and unencumbered software released into the public domain.",
}
#: The line that names a licence by its identifier, for each of those above.
TEMPLATES |= {f"{name}/spdx": f"SPDX-License-Identifier: {name}" for name in sorted({t.split("/")[0] for t in TEMPLATES})}


#: Bigrams below which a template must be there whole.
SHORT = 8
#: What must be there of a licence's name, version and date, if the template has it.
NAMES: dict[str, list[str]] = {
    "Apache-2.0": ["apache license", "version 2 0"],
    "GPL-2.0": ["gnu general public license", "version 2", "june 1991"],
    "GPL-3.0": ["gnu general public license", "version 3", "29 june 2007"],
    "LGPL-3.0": ["gnu lesser general public license", "version 3", "29 june 2007"],
    "MPL-2.0": ["mozilla public license", "v 2 0", "version 2 0"],
}


def needed_bigrams(name: str, text: str) -> list[str]:
    """The bigrams, as two words with a blank, that a unit or window must have to match a template."""
    pairs = lambda ws: [f"{a} {b}" for a, b in itertools.pairwise(ws)]
    own = list(dict.fromkeys(pairs(_word_list(text))))
    if len(own) < SHORT:
        return own
    named = {p for phrase in NAMES.get(name.split("/")[0], []) for p in pairs(phrase.split(" "))}
    return [p for p in own if p in named]


def _word_list(text: str) -> list[str]:
    block = next(blocks(pa.RecordBatch.from_arrays([pa.array([text])], ["text"])))
    starts, ends, _ = words(block, ALNUM)
    return [block.data[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _bigrams(text: str) -> np.ndarray:
    block = next(blocks(pa.RecordBatch.from_arrays([pa.array([text])], ["text"])))
    starts, ends, _ = words(block, ALNUM)
    return np.unique(window_hashes(word_hashes(block, starts, ends), 2))


def full_texts() -> dict[str, str]:
    """Whole licence texts, by identifier; compared with windows only."""
    return {f"{f.stem}/full": f.read_text() for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


SCHEMA = "doc_id long, n_units long, n_matches long, license_id string, dice double, licenses string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_matches", pa.int64()), ("license_id", pa.string()), ("dice", pa.float64()), ("licenses", pa.string())])


class Templates:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.sets = [_bigrams(templates[name]) for name in self.names]
        self.needed = [np.unique(np.concatenate([np.zeros(0, np.uint64), *map(_bigrams, needed_bigrams(name, templates[name]))])) for name in self.names]
        self.vocabulary = np.unique(np.concatenate([*self.sets, np.zeros(0, np.uint64)]))
        #: Which template (column) has which bigram of the vocabulary (row).
        self.member = np.zeros((len(self.vocabulary), len(self.sets)), np.int64)
        for i, own in enumerate(self.sets):
            self.member[np.searchsorted(self.vocabulary, own), i] = 1

    def has(self, bigrams: np.ndarray) -> np.ndarray:
        """Which bigrams are some template's."""
        if not len(self.vocabulary):
            return np.zeros(len(bigrams), bool)
        at = np.searchsorted(self.vocabulary, bigrams)
        at[at == len(self.vocabulary)] = 0
        return self.vocabulary[at] == bigrams

    def best(self, bigrams: np.ndarray, threshold: float) -> tuple[str, float] | None:
        """The best template for a unit's set of bigrams."""
        size, best = len(bigrams), None
        for name, own, needed in zip(self.names, self.sets, self.needed, strict=True):
            if 2 * min(size, len(own)) < threshold * (size + len(own)):
                continue
            dice = 2 * len(np.intersect1d(bigrams, own, assume_unique=True)) / (size + len(own))
            if dice >= threshold and (best is None or dice > best[1]) and np.isin(needed, bigrams).all():
                best = name, dice
        return best


def _distinct(previous: np.ndarray, marks: np.ndarray, start: int) -> np.ndarray:
    """For windows from ``start`` on that grow one by one: how many distinct marked bigrams they hold."""
    return np.cumsum(marks & (previous < start))


def windows(bigrams: np.ndarray, valid: np.ndarray, familiar: np.ndarray, known: Templates, threshold: float) -> list[tuple[str, float, int, int, int]]:
    """Template, Dice, first and end bigram and template size of the matching windows of one text. ``familiar``: the places
    of bigrams that some template has."""
    out: list[tuple[str, float, int, int, int]] = []
    own = np.unique(bigrams[familiar])
    shared = known.member[np.searchsorted(known.vocabulary, own)].sum(0)
    needed = [threshold * len(s) / (2 - threshold) - 1e-9 for s in known.sets]
    if not (shared >= needed).any():
        return out
    order = np.argsort(bigrams, kind="stable")
    previous = np.full(len(bigrams), -1)
    same = bigrams[order][1:] == bigrams[order][:-1]
    previous[order[1:][same]] = order[:-1][same]
    for name, template, must, common in zip(known.names, known.sets, known.needed, shared.tolist(), strict=True):
        size = len(template)
        need = threshold * size / (2 - threshold)
        if not size or common < need - 1e-9:
            continue
        if not np.isin(must, own).all():
            continue
        places = [familiar[bigrams[familiar] == b] for b in must]
        longest = int((2 - threshold) * size / threshold + 1e-9)
        hit = np.zeros(len(bigrams), bool)
        hit[familiar] = np.isin(bigrams[familiar], template, assume_unique=False)
        at = np.flatnonzero(hit)
        near = np.searchsorted(at, at + longest) - np.arange(len(at))
        for start in at[near >= need - 1e-9].tolist():
            end = min(start + longest, len(bigrams))
            # The windows from here that hold all needed bigrams are those up to the last one's next place or beyond.
            following = [np.searchsorted(x, start) for x in places]
            least = max((int(x[i]) + 1 if i < len(x) else end + 1 for x, i in zip(places, following, strict=True)), default=start + 1)
            if least > end:
                continue
            p = previous[start:end]
            common = _distinct(p, hit[start:end], start)
            dice = 2 * common / (_distinct(p, valid[start:end], start) + size)
            best = least - start - 1 + int(np.argmax(dice[least - start - 1 :]))
            if dice[best] >= threshold:
                out.append((name, float(dice[best]), start, start + best + 1, size))
    return out


def _chosen(units: list[tuple], found: list[tuple], threshold: float) -> list[tuple]:
    """The matches that count: units, and windows by their Dice that overlap none before. Spans count from the text's first word."""
    factor, end = (2 - threshold) / threshold, max(m[3] for m in [*units, *found])
    taken: dict[str, np.ndarray] = {}
    largest = np.zeros(end, np.int64)  # template of a window there
    ranked: list[tuple] = []
    for w in sorted(found, key=lambda m: (-m[1], m[0], m[2])):
        span = taken.setdefault(w[0], np.zeros(end, bool))[w[2] : w[3]]
        if not span.any():  # one window of a template in a place
            span[:] = True
            largest[w[2] : w[3]] = np.maximum(largest[w[2] : w[3]], w[4])
            ranked.append(w)
    beyond = lambda m: largest[m[2] : m[3]].max(initial=0) > factor * m[4]
    kept, full = [u for u in units if not beyond(u)], np.zeros(end, bool)
    for u in kept:
        full[u[2] : u[3]] = True
    for w in ranked:
        if not beyond(w) and not full[w[2] : w[3]].any():
            full[w[2] : w[3]] = True
            kept.append(w)
    return kept


def units(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the lines that aren't blank, and of the paragraphs of more than one such line."""
    space = np.isin(block.data, np.array([9, 10, 11, 12, 13, 32], np.uint8))
    new = np.flatnonzero(block.data == 10)
    bounds = np.union1d(np.concatenate([new, new + 1]), block.offsets)
    starts, ends = bounds[:-1], bounds[1:]
    filled = np.concatenate([[0], np.cumsum(~space)])
    full = filled[ends] > filled[starts]
    lines = np.searchsorted(block.offsets, starts[full], "right"), np.searchsorted(new, starts[full], "left")
    starts, ends = starts[full], ends[full]
    if not len(starts):
        return starts, ends
    # A paragraph goes on while the next line follows at once, in the same text.
    new_row = np.concatenate([[True], lines[0][1:] != lines[0][:-1]])
    gap = np.concatenate([[True], lines[1][1:] != lines[1][:-1] + 1])
    first = np.flatnonzero(new_row | gap)
    last = np.append(first[1:], len(starts)) - 1
    several = last > first
    return np.concatenate([starts, starts[first[several]]]), np.concatenate([ends, ends[last[several]]])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: its units, those that match a template, the best match and all identifiers found."""
    listed = dict(TEMPLATES if templates is None else templates)
    whole = listed | (full_texts() if templates is None else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wide = Templates(listed), Templates(whole)
        for batch in batches:
            for block in blocks(batch):
                yield _scan(block, known, wide, threshold)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def _scan(block: Block, known: Templates, wide: Templates, threshold: float) -> pa.RecordBatch:
    unit_starts, unit_ends = units(block)
    rows = block.row_of(unit_starts)
    starts, ends, counts = words(block, ALNUM)
    bigrams = window_hashes(word_hashes(block, starts, ends), 2)
    valid = within(counts, 2)[: len(bigrams)]
    familiar = np.concatenate([[0], np.cumsum(valid & known.has(bigrams))])
    # The bigrams of a unit: first word at or after its start, second word before its end.
    first = np.searchsorted(starts, unit_starts)
    last = np.maximum(first, np.searchsorted(starts, unit_ends) - 1)
    last = np.minimum(last, len(bigrams))
    first = np.minimum(first, len(bigrams))
    sizes = dict(zip(known.names, map(len, known.sets), strict=True))
    found: list[list[tuple]] = [[] for _ in range(block.rows)]
    for i in np.flatnonzero(familiar[last] > familiar[first]).tolist():
        best = known.best(np.unique(bigrams[first[i] : last[i]]), threshold)
        if best:
            found[rows[i]].append((*best, int(first[i]), int(last[i]), sizes[best[0]]))
    # The bigrams of a text, first and last word inside it.
    ends_at = np.cumsum(counts)
    wide_familiar = np.flatnonzero(valid & wide.has(bigrams))
    for i in np.flatnonzero(counts > 1).tolist():
        a, b = int(ends_at[i] - counts[i]), int(ends_at[i]) - 1
        places = wide_familiar[slice(*np.searchsorted(wide_familiar, [a, b]))] - a
        matching = windows(bigrams[a:b], valid[a:b], places, wide, threshold) if len(places) else []
        if matching:
            found[i] = _chosen([(n, d, s - a, e - a, m) for n, d, s, e, m in found[i]], matching, threshold)
    tops = [max(x, key=lambda m: (m[1], [-ord(c) for c in m[0]])) if x else None for x in found]
    return output(
        _ARROW,
        doc_id=column(block.batch, "doc_id"),
        n_units=np.bincount(rows, minlength=block.rows).astype(np.int64),
        n_matches=[len(x) for x in found],
        license_id=[t[0].split("/")[0] if t else None for t in tops],
        dice=[t[1] if t else None for t in tops],
        licenses=[",".join(sorted({name.split("/")[0] for name, *_ in x})) for x in found],
    )
