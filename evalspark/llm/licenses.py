"""License notices: which known wording makes a block of text most compressible.

The words around every cue of licensing, as many on both sides as a notice can have, make a block,
so line breaks and comment signs do not cut notices. A block's stretches are compressed alone and
with each template, of whose words they hold enough, as a raw zstandard dictionary. Templates are
ranked by the bytes they save; the first that the exact words confirm is the notice. Its words are
taken out and the rest on both sides is ranked again, so that a refused or lower template is not lost.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import map_columns, texts_of

# Names of licenses and the wording of their customary notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
    ),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license. Released under the BSD 3-Clause License."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
TEMPLATES += [
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version.",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public "
        "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ),
    *(
        (name, f"SPDX-License-Identifier: {name}")
        for name in (
            "MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0",
            "BSD-2-Clause", "BSD-3-Clause", "ISC", "CC0-1.0", "Unlicense",
        )
    ),
]
# Parts of words that notices have; every template holds one.
_CUE = re.compile(r"licen|lizenz|copyright|©|\(c\)|permission|public\W+domain|unencumbered|spdx|redistribut|warrant")

LEVEL = 9
# Share of a template's words that a block must hold, and the shortest run of them to begin from.
LEAST_WORDS, LEAST_RUN = 0.8, 2
# Words that tell one license from another: a template is refused if they differ.
_TELLING = frozenset(
    "mit apache gnu general lesser affero mozilla bsd isc cc by sa nc nd cc0 commons attribution sharealike "
    "noncommercial noderivatives unencumbered unlicense gpl lgpl agpl mpl epl eclipse".split()
)
_WORDS = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")
_CLOSING = re.compile(r"[^\w\s]*")


def _plain(text: str) -> bytes:
    return " ".join(text.lower().split()).encode()


def _lowered(text: str) -> str:
    """Lower case, every character in its place."""
    lowered = text.lower()
    if len(lowered) != len(text):
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return lowered


def _words(text: str) -> list[str]:
    return [w.removesuffix(".0") for w in _WORDS.findall(_lowered(text))]


def blocks(text: str, reach: int) -> Iterator[list[re.Match]]:
    """Words of the text that lie within ``reach`` words of a cue, run by run."""
    lowered = _lowered(text)
    cues = [m.start() for m in _CUE.finditer(lowered)]
    if not cues:
        return
    places = list(_WORDS.finditer(lowered))
    starts = [m.start() for m in places]
    low = high = 0
    for cue in cues:
        at = bisect_right(starts, cue)
        if at - reach > high:
            if high > low:
                yield places[low:high]
            low = at - reach
        high = min(at + reach, len(places))
    if high > low:
        yield places[low:high]


class Scanner:
    def __init__(self, templates: list[tuple[str, str]]):
        self.names = [n for n, _ in templates]
        self.words = [_words(t) for _, t in templates]
        self.counts = [Counter(w) for w in self.words]
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.given = [
            zstandard.ZstdCompressor(
                level=LEVEL,
                write_content_size=False,
                dict_data=zstandard.ZstdCompressionDict(_plain(t), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            )
            for _, t in templates
        ]
        self.cost = [len(self.alone.compress(_plain(t))) for _, t in templates]
        # Words of the longest notice: a template may lack a fifth of its words, and others come in between.
        self.reach = max((len(w) + len(w) // 2 + 3 for w in self.words), default=0)

    def possible(self, words: list[str]) -> list[int]:
        """Templates of whose words there are enough, in whatever order."""
        have = Counter(words)
        return [i for i in range(len(self.words)) if self._enough(i, have)]

    def _enough(self, template: int, have: Counter) -> bool:
        wanted = self.counts[template]
        return (wanted & have).total() >= LEAST_WORDS * wanted.total()

    def saved(self, text: str, templates: list[int]) -> list[int]:
        """Bytes that each of the templates saves when the text is compressed."""
        data = _plain(text)
        alone = len(self.alone.compress(data))
        return [alone - len(self.given[i].compress(data)) for i in templates]

    def differences(self, template: int, b: list[str]) -> tuple[int, list[str], int, int] | None:
        """Words of the template found in order, those that differ inside them, and where they lie.

        Nothing if too few are found, if more words differ, or if one that tells licenses apart does.
        """
        a = self.words[template]
        matches = [m for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
        found = sum(m.size for m in matches)
        if not matches or found < LEAST_WORDS * len(a):
            return None
        out, i, j = [], 0, matches[0].b
        for m in matches:
            out += [f"-{w}" for w in a[i : m.a]] + [f"+{w}" for w in b[j : m.b]]
            i, j = m.a + m.size, m.b + m.size
        out += [f"-{w}" for w in a[i:]]
        if len(out) > found or any(d[1:] in _TELLING or d[1].isdigit() for d in out):
            return None
        return found, out, matches[0].b, j

    def occurrence(self, template: int, words: list[str], low: int, high: int):
        """``differences`` at a place between ``low`` and ``high`` where the template is confirmed.

        Around the longest common run first the words that the template would cover are compared,
        then all; if neither confirms it, the parts on both sides of the run are searched.
        """
        n = len(self.words[template])
        todo = [(low, high)]
        while todo:
            low, high = todo.pop()
            if not self._enough(template, Counter(words[low:high])):
                continue
            run = SequenceMatcher(None, self.words[template], words[low:high], autojunk=False).find_longest_match()
            if run.size < min(LEAST_RUN, n):
                continue
            at, slack = low + run.b, n // 4 + 3
            near = max(low, at - run.a - slack), min(high, at - run.a + n + slack)
            for start, stop in (near, (low, high)):
                if got := self.differences(template, words[start:stop]):
                    found, differing, first, last = got
                    return found, differing, start + first, start + last
            todo += [(low, at), (at + run.size, high)]
        return None

    def winner(self, text: str, places: list[re.Match], words: list[str], low: int, high: int):
        """The confirmed template that saves most on the words from ``low`` to ``high``: it and its ``occurrence``."""
        candidates = self.possible(words[low:high])
        if not candidates:
            return None
        gains = self.saved(text[places[low].start() : places[high - 1].end()], candidates)
        for _, i in sorted(zip(gains, candidates), key=lambda c: (-c[0], c[1])):
            if got := self.occurrence(i, words, low, high):
                return i, got
        return None

    def notices(self, text: str, places: list[re.Match]) -> list[dict]:
        """Every notice of a block.

        The block is taken in stretches of four times ``reach`` words. One that begins in the first
        half of a stretch ends inside it; the next stretch begins behind it, at the middle at most.
        """
        words = [m.group().removesuffix(".0") for m in places]
        out, base = [], 0
        while base < len(words):
            middle, stop = base + 2 * self.reach, min(base + 4 * self.reach, len(words))
            todo, behind = [(base, stop)], middle if stop < len(words) else len(words)
            while todo:
                low, high = todo.pop()
                if not (best := self.winner(text, places, words, low, high)):
                    continue
                i, (_, differing, first, last) = best
                todo += [(low, first), (last, high)]
                if first < middle or stop == len(words):
                    behind = max(behind, last)
                    start, end = places[first].start(), places[last - 1].end()
                    end = _CLOSING.match(text, end).end()
                    share = self.saved(text[start:end], [i])[0] / self.cost[i]
                    out.append({
                        "license": self.names[i], "start": start, "end": end,
                        "saved": round(share, 4), "differences": differing,
                    })
            base = behind
        return sorted(out, key=lambda n: n["start"])

    def scan(self, text: str) -> list[dict]:
        """Confirmed licenses of the text's blocks."""
        return [notice for places in blocks(text, self.reach) for notice in self.notices(text, places)]


FOUND = "license string, start int, end int, saved double, differences array<string>"


def find_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """``doc_id`` and ``found``: license, start, end, bytes saved per byte of the template, differing words of
    every notice; start and end are those of its words.

    One row per input row, in one pass without a shuffle. A null or empty text has none.
    ``+word`` stands for a word of the text that the template lacks, ``-word`` for the reverse.
    Repeated rows give repeated results; a null ``doc_id`` is handed through.
    """
    chosen = TEMPLATES if templates is None else templates

    def build():
        scanner = Scanner(chosen)
        return lambda ids, texts: {"doc_id": ids, "found": [scanner.scan(t) for t in texts]}

    return map_columns(texts_of(docs), build, f"doc_id bigint, found array<struct<{FOUND}>>")


def license_report(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_notices``, ``licenses`` (names in order) and ``spans`` per input row."""
    spans = F.transform(
        "found", lambda f: F.concat_ws(":", f["license"], f["start"].cast("string"), f["end"].cast("string"))
    )
    return find_licenses(docs).select(
        "doc_id",
        F.size("found").cast("long").alias("n_notices"),
        F.array_sort(F.array_distinct(F.col("found.license"))).alias("licenses"),
        F.concat_ws(",", spans).alias("spans"),
    )
