"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Every template is a list of words. Hashes of `GRAM` consecutive words are
winnowed (the least hash of every `WINNOW` neighbours is kept) into an
inverted index hash -> (template, place). All word grams of a document are
looked up in it; hits of one template whose diagonals lie close together are a
candidate. The template is then aligned with the document inside a band around
that diagonal, and the alignment gives the matched words, the coverage of the
template and the span in the text. Parts of a template that follow each other
with other words between them, more than the band allows, count as one match.
A template below `SHORT` words has to match as a whole, as its words hardly
differ from those of another license; a longer one by `COVERAGE`. Of overlapping spans the one with the most
matched words stays, of equals that of the shorter template, then the tighter one, so a short notice inside a long one is not reported twice.

Words are runs of ASCII letters, digits and non-ASCII characters, ASCII lower
case; line breaks, comment signs and punctuation make no difference.

Defined cases: a null or empty text has no span; repeated rows are reported
again; a template found twice in a text gives two rows; rows without doc_id
are left out; an empty table gives an empty result; further columns are
ignored. Positions are code points, from 0, end exclusive.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickward.llm.common import LOWER, PolyHash, chunks, constants, mix, whole_text

GRAM = 3
WINNOW = 2
BAND = 8
COVERAGE = 0.6
# Templates of fewer words must match as a whole.
SHORT = 15
# Words that may lie between two parts of one template, and the least share of it in a part.
BETWEEN = 64
PART = 0.15
SEEN = 0.15

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software."""
_AS_IS_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED."""
_AS_IS_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""

# Names and wordings of licenses and of the notices that refer to them.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations
        under the License.""",
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT": _MIT,
    "MIT-warranty": _AS_IS_MIT,
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
    "BSD-warranty": _AS_IS_BSD,
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version.""",
    "LGPL": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License,
        or (at your option) any later version.""",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSD-named": "Released under the BSD License.",
    "Boost-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "Boost-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the
        software and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
        distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
        third-parties to whom the Software is furnished to do so""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
        be held liable for any damages arising from the use of this software. Permission is granted to anyone to use
        this software for any purpose, including commercial applications, and to alter it and redistribute it freely""",
    "EPL-2.0-notice": """This program and the accompanying materials are made available under the terms of the Eclipse
        Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0""",
    "CC0-1.0": """To the extent possible under law, the author has waived all copyright and related or neighboring rights
        to this work.""",
    "CC0-1.0-notice": "Dedicated to the public domain under CC0 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "All-rights-reserved-notice": "All rights reserved.",
    "All-rights-reserved": "All rights reserved. No part of this publication may be reproduced without permission.",
}

_WORDS = PolyHash(307)
_PLACE = constants(311, GRAM)
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def words(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word, and how many words the texts before text i have."""
    buffer = LOWER[buffer]
    solid = np.zeros(len(buffer) + 2, bool)
    solid[1:-1] = _IN_WORD[buffer]
    first = np.zeros(len(buffer) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(solid[1:] & (first | ~solid[:-1]))
    ends = np.flatnonzero(solid[:-1] & (first | ~solid[1:]))
    hashes = _WORDS.between(_WORDS.prefix(buffer), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray) -> np.ndarray:
    n = len(hashes) - GRAM + 1
    return mix(sum(hashes[j : n + j] * _PLACE[j] for j in range(GRAM))) if n > 0 else np.zeros(0, np.uint64)


def winnow(values: np.ndarray, width: int = WINNOW) -> list[int]:
    """Places of the kept hashes: the last least one of every `width` neighbours."""
    if len(values) <= width:
        return [int(np.argmin(values))] if len(values) else []
    windows = np.lib.stride_tricks.sliding_window_view(values[::-1], width)
    at = np.unique(np.argmin(windows, axis=1) + np.arange(len(windows)))
    return sorted(len(values) - 1 - int(i) for i in at)


@lru_cache(maxsize=1)
def index() -> tuple[list[tuple[str, np.ndarray, int]], np.ndarray, dict[int, list[tuple[int, int]]]]:
    """Templates as (name, word hashes, fingerprints), the sorted fingerprints, and their postings."""
    templates, postings = [], defaultdict(list)
    for number, (name, text) in enumerate(TEMPLATES.items()):
        raw = np.frombuffer(text.encode(), np.uint8)
        hashes = words(raw, np.asarray([0, len(raw)]))[0]
        values = grams(hashes)
        kept = winnow(values)
        for place in kept:
            postings[int(values[place])].append((number, place))
        templates.append((name, hashes, len(kept)))
    return templates, np.asarray(sorted(postings), np.uint64), dict(postings)


def align(template: np.ndarray, text: np.ndarray, start: int, band: int) -> tuple[int, int, int]:
    """(matched words, first, end) of the best local alignment within `band` of the diagonal at `start`.

    A match earns 1, a substitution or a gap costs a half.
    """
    width = 2 * band + 1
    # A cell is (score, matches, -first place, place after the last match).
    empty = (0.0, 0, 0, 0)
    above: list[tuple] = [empty] * width
    best = empty
    for i, word in enumerate(template.tolist()):
        here: list[tuple] = []
        for k in range(width):
            j = start + i + k - band
            if not 0 <= j < len(text):
                here.append(empty)
                continue
            before = above[k]
            if text[j] == word:
                cell = (before[0] + 1, before[1] + 1, before[2] if before[1] else -j, j + 1)
            else:
                cell = (before[0] - 0.5, *before[1:])
            if k + 1 < width and above[k + 1][0] - 0.5 > cell[0]:
                cell = (above[k + 1][0] - 0.5, *above[k + 1][1:])
            if k and here[-1][0] - 0.5 > cell[0]:
                cell = (here[-1][0] - 0.5, *here[-1][1:])
            if cell[0] <= 0:
                cell = empty
            here.append(cell)
            if cell[:3] > best[:3]:
                best = cell
        above = here
    return best[1], -best[2], best[3]


def _joined(parts: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """Parts of one template in text order, those that complete each other as one."""
    out: list[tuple[int, int, int]] = []
    for matched, first, end in sorted((p for p in parts if p[0] >= PART * size), key=lambda p: (p[1], p[2])):
        if out and 0 <= first - out[-1][2] <= BETWEEN and out[-1][0] + matched <= size:
            out[-1] = out[-1][0] + matched, out[-1][1], end
        elif not out or first >= out[-1][2] or matched > out[-1][0]:
            out.append((matched, first, end))
    return out


def scan(hashes: np.ndarray, found: np.ndarray, values: np.ndarray) -> list[tuple[str, int, int, int, int]]:
    """(template, words, matched, first word, end word) in one text; `found` are the places of its indexed grams."""
    templates, _, postings = index()
    diagonals: dict[int, list[int]] = defaultdict(list)
    for at in found.tolist():
        for number, place in postings[int(values[at])]:
            diagonals[number].append(at - place)
    spans = []
    for number, starts in diagonals.items():
        name, template, fingerprints = templates[number]
        band = min(BAND, len(template) // 3)
        starts.sort()
        group: list[int] = []
        parts: list[tuple[int, int, int]] = []
        for start in [*starts, None]:
            if group and (start is None or start - group[-1] > band):
                if len(group) >= SEEN * fingerprints:
                    parts.append(align(template, hashes, group[len(group) // 2], band))
                group = []
            group.append(start)
        for matched, first, end in _joined(parts, len(template)):
            if matched >= (COVERAGE if len(template) >= SHORT else 1) * len(template):
                spans.append((matched, -len(template), first - end, -first, end, name))
    spans.sort(reverse=True)
    taken: list[tuple[int, int]] = []
    kept = []
    for matched, size, _, first, end, name in spans:
        if all(end <= a or -first >= b for a, b in taken):
            taken.append((-first, end))
            kept.append((name, -size, matched, -first, end))
    return sorted(kept, key=lambda s: s[3])


def license_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, license, coverage, n_matched, span_start, span_end): a row per license text found."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("n_matched", pa.int64()),
         ("span_start", pa.int64()), ("span_end", pa.int64())]
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, known, _ = index()
        for part, buffer, offsets in chunks(batches):
            hashes, starts, ends, first = words(buffer, offsets)
            values = grams(hashes)
            at = np.minimum(np.searchsorted(known, values), len(known) - 1)
            hits = np.flatnonzero(known[at] == values)
            rows: list[tuple] = []
            ids = part.column("doc_id")
            for i in np.unique(np.searchsorted(first, hits, side="right") - 1).tolist():
                a, b = int(first[i]), int(first[i + 1])
                own = hits[(hits >= a) & (hits <= b - GRAM)]
                if not len(own):
                    continue
                points = None
                for name, size, matched, begin, end in scan(hashes[a:b], own - a, values[a : max(a, b - GRAM + 1)]):
                    if points is None:
                        text = buffer[offsets[i] : offsets[i + 1]]
                        points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
                    span = points[starts[a + begin] - offsets[i]], points[ends[a + end - 1] - offsets[i]]
                    rows.append((ids[i].as_py(), name, matched / size, matched, int(span[0]), int(span[1])))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    texts = whole_text(docs).where(F.col("doc_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("long"))
    return texts.mapInArrow(
        find, "doc_id long, license string, coverage double, n_matched long, span_start long, span_end long"
    )
