"""License notices in documents: winnowed fingerprints pick candidates, alignment confirms them.

Notices are compared as words in lower case. Every template's word triples are winnowed into an
inverted index of (template, place). A document's triples are winnowed alike, so that four
words in a row that it shares with a template always give a common entry. The diagonal of each
entry makes a candidate, whose surroundings are aligned with the template inside a band: equal
words count 1, others and gaps -1. What the band holds on both sides of the best alignment is
aligned again, as notices may follow each other. Of overlapping matches the one with the best
alignment stays. What tells one license from its relatives, its name and version, must be there
word for word and unbroken, whatever else of a notice differs.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histomesh.llm.words import BASE, mixed, pieces, utf8, word_hashes

TRIPLE, WINDOW, BAND = 3, 2, 8

# Notices of public licenses.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.",),
    "BSD-2-Clause OR BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
}

# The words that name a license and its version. Of these a notice must hold, unbroken,
# all that its template holds.
TELLING = {
    "Apache-2.0": ("Apache License, Version 2.0",),
    "MIT": ("MIT License", "sublicense, and/or sell copies of the Software"),
    "BSD-2-Clause": ("BSD 2-Clause",),
    "BSD-3-Clause": ("BSD 3-Clause",),
    "BSD-2-Clause OR BSD-3-Clause": ("Redistribution and use in source and binary forms",),
    "GPL-3.0": ("GNU General Public License", "version 3"),
    "GPL-2.0": ("GNU General Public License", "version 2"),
    "AGPL-3.0": ("GNU Affero General Public License", "version 3"),
    "ISC": ("ISC License", "with or without fee"),
    "LGPL-3.0": ("GNU Lesser General Public License", "version 3"),
    "MPL-2.0": ("Mozilla Public License, v. 2.0",),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"),
}

_INNER = np.zeros(256, bool)
_INNER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first word of each row) of runs of letters and digits."""
    inner = np.append(_INNER[data], False)
    begins, last = inner[:-1].copy(), inner[:-1].copy()
    begins[1:] &= ~inner[:-2]
    last &= ~inner[1:]
    filled = offsets[:-1] < offsets[1:]
    edge = offsets[:-1][filled]
    begins[edge] = inner[edge]
    edge = offsets[1:][filled] - 1
    last[edge] = inner[edge]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(last) + 1
    return word_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def winnowed(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the chosen word triples: the least of each two neighbours."""
    n = len(words) - TRIPLE + 1
    if n < 1:
        return words[:0], np.zeros(0, np.int64)
    triples = np.zeros(n, np.uint64)
    for k in range(TRIPLE):
        triples = triples * np.uint64(BASE) + words[k : k + n]
    triples = mixed(triples)
    if n == 1:
        return triples, np.zeros(1, np.int64)
    least = np.minimum(triples[1:], triples[:-1])
    chosen = np.append(triples[:-1] == least, False) | np.append(False, triples[1:] == least)
    at = np.flatnonzero(chosen)
    return triples[at], at


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return word_ids(raw, np.array([0, len(raw)]))[0]


def holds(words: np.ndarray, phrase: np.ndarray) -> bool:
    """Whether ``phrase`` stands somewhere in ``words``, unbroken."""
    n = len(words) - len(phrase) + 1
    return n > 0 and bool(np.logical_and.reduce([words[k : k + n] == w for k, w in enumerate(phrase)]).any())


class Index:
    """Templates as word hashes, their telling phrases, and their fingerprints in order with (template, place)."""

    def __init__(self, templates: dict[str, tuple[str, ...]], telling: dict[str, tuple[str, ...]] = TELLING):
        self.names, self.words, self.telling = [], [], []
        hashes, entries = [], []
        for name, texts in templates.items():
            for text in texts:
                words = _hashes(text)
                h, at = winnowed(words)
                hashes.append(h)
                entries += [(len(self.names), int(a)) for a in at]
                self.names.append(name)
                self.words.append(words)
                self.telling.append([p for p in map(_hashes, telling.get(name, ())) if holds(words, p)])
        order = np.argsort(np.concatenate(hashes), kind="stable")
        self.hashes = np.concatenate(hashes)[order]
        self.entries = [entries[k] for k in order]

    def candidates(self, words: np.ndarray) -> set[tuple[int, int]]:
        """(template, word at which it would begin), one for every diagonal with an entry."""
        h, at = winnowed(words)
        low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        return {(template, int(at[k]) - place) for k in np.flatnonzero(high > low) for template, place in self.entries[low[k] : high[k]]}


def align(template: np.ndarray, words: np.ndarray, begin: int, low: int = 0, high: int | None = None) -> tuple[int, int, int, int]:
    """(score, equal words, first word, word behind the last) of the best alignment in the band.

    Only words from ``low`` up to ``high`` take part.
    """
    high = len(words) if high is None else high
    best = (0, 0, 0, 0)
    above: dict[int, tuple[int, int, int]] = {}
    for i, word in enumerate(template.tolist()):
        here: dict[int, tuple[int, int, int]] = {}
        for j in range(max(low, begin + i - BAND), min(high, begin + i + BAND + 1)):
            score, equal, start = above.get(j - 1, (0, 0, j))
            same = int(words[j]) == word
            cell = (score + 1, equal + 1, start) if same else (score - 1, equal, start)
            for other in (above.get(j), here.get(j - 1)):
                if other and (other[0] - 1, other[1]) > cell[:2]:
                    cell = (other[0] - 1, *other[1:])
            if cell[0] > 0:
                here[j] = cell
                if cell[:2] > best[:2]:
                    best = (*cell, j + 1)
        above = here
    return best


@lru_cache(maxsize=4)
def _index(templates: tuple, telling: tuple) -> Index:
    return Index(dict(templates), dict(telling))


def notices(index: Index, words: np.ndarray, coverage: float) -> list[tuple[int, float, int, int, int]]:
    """(template, coverage, equal words, first word, word behind the last), by place."""
    found = set()
    for template, begin in index.candidates(words):
        size = len(index.words[template])
        open_ = [(max(0, begin - BAND), min(len(words), begin + size + BAND))]
        while open_:
            low, high = open_.pop()
            if high - low < coverage * size:
                continue
            score, equal, start, end = align(index.words[template], words, begin, low, high)
            if not score:
                continue
            share = equal / size
            if share >= coverage and all(holds(words[start:end], p) for p in index.telling[template]):
                found.add((-score, template, start, end, equal, share))
            open_ += [(low, start), (end, high)]
    kept: list[tuple] = []
    starts: list[int] = []
    for match in sorted(found):
        at = bisect(starts, match[2])
        if (not at or kept[at - 1][3] <= match[2]) and (at == len(kept) or match[3] <= starts[at]):
            kept.insert(at, match)
            starts.insert(at, match[2])
    return sorted((m[1], m[5], m[4], m[2], m[3]) for m in kept)


def _scan(templates: tuple, telling: tuple, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(templates, telling)
        for batch in batches:
            texts = batch.column(1)
            data, offsets = utf8(texts)
            rows, out = [], []
            for low, high in pieces(offsets):
                own = offsets[low : high + 1] - offsets[low]
                part = data[offsets[low] : offsets[high]]
                words, starts, ends, first = word_ids(part, own)
                h, at = winnowed(words)
                near = np.unique(np.searchsorted(first, at[np.isin(h, index.hashes)], "right") - 1)
                for row in near:
                    mine = slice(first[row], first[row + 1])
                    for template, share, equal, a, b in notices(index, words[mine], coverage):
                        raw = part[own[row] : own[row + 1]].tobytes()
                        start = len(raw[: starts[mine][a] - own[row]].decode("utf-8", "ignore"))
                        end = len(raw[: ends[mine][b - 1] - own[row]].decode("utf-8", "ignore"))
                        rows.append(low + int(row))
                        out.append((index.names[template], template, share, equal, start, end))
            kinds = (pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], ["id", "license", "template", "coverage", "matched_words", "start", "end"])

    return run


def find_licenses(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    templates: dict[str, tuple[str, ...]] | None = None,
    coverage: float = 0.8,
    telling: dict[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """One row per notice found: key, license, template, coverage, matched_words, start, end.

    ``coverage`` is the share of a template's words that the document holds in order, ``start`` and
    ``end`` are code points. Of the phrases that ``telling`` has under a license's name, a match holds
    all that its template holds; with own templates there are none unless given. Null and empty texts, and texts without a notice, give no row;
    copies give equal rows, a text with several notices one row for each. Of equally good
    overlapping matches the first template in order stays. An empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    telling = telling if telling is not None else {} if templates else TELLING
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, license string, template int, coverage double, matched_words long, start long, end long"
    return rows.mapInArrow(_scan(tuple((templates or TEMPLATES).items()), tuple(telling.items()), coverage), shape).withColumnRenamed("id", key)
