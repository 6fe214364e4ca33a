"""License scans by conditional compression.

Word pairs that a template has and prose has not (not both words are COMMON) are looked for; places near each other are gathered
to a block. Templates of which a block has too few pairs to be confirmed leave the race: every differing word breaks two pairs at
most. The block is compressed alone and with each template that is left as zstandard raw dictionary, and templates are ranked by
how much smaller the dictionary makes it. The first of the ranked list whose wording holds is the find: the template is aligned word by
word at every place that shares a stretch long enough, and at most MOST_DIFFERENT of its words may differ; among templates within
NEAR bytes of it the differences in wording decide. What is left of the
block on either side is scanned again.

Defined results: a null or empty text has no finds; spans are in code points, end exclusive, from the first to the last word that the
template shares; several licenses of a document come in order; repeated rows are scanned each; other columns do not matter; an
empty table gives an empty one. A block of more than WINDOW words is scanned in windows that overlap by the longest template.
"""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneldrift.llm.tokens import batches

# Wording of public licenses and of their usual notices.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                   'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
                   "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
            "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
            "the Software.",
            'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
            "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
                     "are met:",
                     "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
                     "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.",
                     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
                     "software without specific prior written permission."),
    "ISC": ("Licensed under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies."),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0.",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                "file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",
                 "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
                 "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",
                 "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
                 "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
                "This work is marked with CC0 1.0 Universal."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",
                  "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
                  "for any purpose, commercial or non-commercial, and by any means."),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
             "from the use of this software.",
             "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
             "subject to the following restrictions:"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",
                "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered "
                "by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
}
#: Words of prose: a pair of two of these tells nothing.
COMMON = frozenset(
    "a all and any are as at be but by can for form free from if in into is it its law may name no not of on one or other out such that the "
    "their these this to under use used was which with work you your".split()
)

#: The largest share of different words.
MOST_DIFFERENT = 0.2
#: Bytes of compressed size that do not tell templates apart: one changed figure costs no more.
NEAR = 6
#: Words of a block before the first and behind the last pair.
AROUND = 3
WINDOW = 2000

_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
FINDS = "doc_id bigint, finds array<struct<license: string, start: bigint, end: bigint, reduction: double, missing: array<string>, added: array<string>>>"


class Templates:
    def __init__(self):
        import zstandard

        self.alone = zstandard.ZstdCompressor(level=19)
        self.each = []  # license, words, compressor, different words at most, pairs at least
        self.of_pair: dict[tuple[str, str], list[int]] = {}
        for name, texts in TEMPLATES.items():
            for text in (*texts, f"SPDX-License-Identifier: {name}"):
                words = _words(text)
                dictionary = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                pairs = {p for p in zip(words, words[1:]) if not (p[0] in COMMON and p[1] in COMMON)}
                most = int(MOST_DIFFERENT * len(words))
                for p in pairs:
                    self.of_pair.setdefault(p, []).append(len(self.each))
                self.each.append((name, words, zstandard.ZstdCompressor(level=19, dict_data=dictionary), most, len(pairs) - 2 * most))
        self.longest = max(len(e[1]) for e in self.each)

    def places(self, words: list[str]) -> list[int]:
        """Where a pair of any template begins."""
        known = self.of_pair
        return [k for k, p in enumerate(zip(words, words[1:])) if p in known]

    def ranked(self, words: list[str]) -> list[tuple[int, float, int]]:
        """Compressed size, share by which the dictionary makes the words smaller, and number of the templates that may hold, best first."""
        shared = Counter(t for p in set(zip(words, words[1:])) for t in self.of_pair.get(p, ()))
        able = [t for t, n in shared.items() if n >= self.each[t][4]]
        if not able:
            return []
        data = " ".join(words).encode()
        size = len(self.alone.compress(data))
        made = ((len(self.each[t][2].compress(data)), t) for t in able)
        return sorted(((n, 1 - n / size, t) for n, t in made), key=lambda x: (x[0], -len(self.each[x[2]][1]), x[2]))

    def confirmed(self, words: list[str], own: list[str], most: int):
        """(first word, last word + 1, missing, added) of the place where the words differ least enough from a template, or None."""
        work = [(0, len(words))]
        matcher = SequenceMatcher(None, words, own, autojunk=False)
        while work:
            begin, end = work.pop()
            core = matcher.find_longest_match(begin, end, 0, len(own))
            if not core.size or core.size * (most + 1) < len(own) - most:
                continue  # so few different words leave a longer stretch
            # The longest common stretch fixes the place; the template's other words are looked for around it.
            low, high = max(core.a - 2 * core.b - 2, 0), core.a + core.size + 2 * (len(own) - core.b - core.size) + 2
            same = [m for m in SequenceMatcher(None, words[low:high], own, autojunk=False).get_matching_blocks() if m.size]
            a, b = low + same[0].a, low + same[-1].a + same[-1].size
            kept_a = {low + k for m in same for k in range(m.a, m.a + m.size)}
            kept_b = {k for m in same for k in range(m.b, m.b + m.size)}
            missing = [w for k, w in enumerate(own) if k not in kept_b]
            added = [words[k] for k in range(a, b) if k not in kept_a]
            if len(missing) + len(added) <= MOST_DIFFERENT * len(own):
                return a, b, missing, added
            work += [(begin, core.a), (core.a + core.size, end)]
        return None

    def best(self, words: list[str]):
        """(first word, last word + 1, name, reduction, missing, added) of the first template of the ranked list that holds, or None.

        Of templates that the compressor cannot tell apart from it, NEAR bytes, the one with the least share of different words.
        """
        found, upto = [], None
        for size, reduction, t in self.ranked(words):
            if upto is not None and size > upto:
                break
            name, own, _, most, _ = self.each[t]
            if got := self.confirmed(words, own, most):
                upto = size + NEAR if upto is None else upto
                found.append(((len(got[2]) + len(got[3])) / len(own), (*got[:2], name, reduction, *got[2:])))
        return min(found, key=lambda x: x[0])[1] if found else None


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def find(text: str, templates: Templates) -> list[dict]:
    words = _words(text)
    blocks: list[list[int]] = []
    gap = int(MOST_DIFFERENT * templates.longest) + 2
    for k in templates.places(words):
        if blocks and k - gap <= blocks[-1][1]:
            blocks[-1][1] = k + 2
        else:
            blocks.append([k, k + 2])
    work = []
    for a, b in blocks:
        a, b = max(a - AROUND, 0), min(b + AROUND, len(words))
        work += [(k, min(k + WINDOW, b)) for k in range(a, max(b - templates.longest, a + 1), WINDOW - templates.longest)]
    out, taken, places = [], [], None
    while work:
        a, b = work.pop()
        if b - a < 2 or not (got := templates.best(words[a:b])):
            continue
        first, last = a + got[0], a + got[1]
        work += [(a, first), (last, b)]
        if any(first < y and x < last for x, y in taken):
            continue  # seen in the window before
        taken.append((first, last))
        places = places or [m.span() for m in _WORD.finditer(text)]
        out.append({"license": got[2], "start": places[first][0], "end": places[last - 1][1], "reduction": got[3], "missing": got[4], "added": got[5]})
    return sorted(out, key=lambda x: x["start"])


def find_licenses(docs: DataFrame) -> DataFrame:
    """doc_id and finds (license, span, reduction of the compressed size, differing words) for every row."""

    def found(frames):
        import pyarrow as pa

        templates = Templates()
        kind = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reduction", pa.float64()),
                          ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))])
        for frame in frames:
            for piece in batches(frame):
                finds = [find(t or "", templates) for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(finds, pa.list_(kind))], ["doc_id", "finds"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(found, FINDS)


def digests(finds: DataFrame) -> DataFrame:
    """doc_id, number of licenses, their names and spans, and the number of differing words."""
    told = F.transform("finds", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"]))
    different = F.aggregate("finds", F.lit(0), lambda s, x: s + F.size(x["missing"]) + F.size(x["added"]))
    return finds.select("doc_id", F.size("finds").cast("bigint").alias("n_licenses"), F.array_join("finds.license", ",").alias("licenses"),
                        F.array_join(told, ",").alias("spans"), different.cast("bigint").alias("n_different"))
