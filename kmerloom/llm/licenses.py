"""License scan by patience alignment of each text with notice templates."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Generator

from pyspark.sql import DataFrame

from kmerloom.llm.common import arrow_map

#: Short forms, file headers and texts of public licences (of the Unlicense and BSL-1.0 the first paragraphs). More can be passed as ``templates``.
TEMPLATES = {
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
        IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
        IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSL-1.0-text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software,
        and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
        The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software,
        unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution.""",
}

WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that rises in both places (patience piles with back pointers); ``pairs`` rise in the first."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        back[i] = last[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(b)
            last.append(i)
        else:
            tops[pile], last[pile] = b, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


Pairs = list[tuple[int, int]]


def common(template: list[str], where: dict[str, list[int]], a: int, b: int, c: int, d: int) -> Pairs:
    """The longest common sequence of two ranges whose words all repeat: the longest rising run of all pairs of equal words, which ends as early as it can and is then drawn together towards its end."""
    places = {w: p[bisect_left(p, c) : bisect_left(p, d)] for w in set(template[a:b]) if (p := where.get(w))}
    run = rising([(i, j) for i in range(a, b) for j in reversed(places.get(template[i], ()))])
    out, behind = [], run[-1][1] + 1 if run else d
    for i, _ in reversed(run):
        p = places[template[i]]
        behind = p[bisect_left(p, behind) - 1]
        out.append((i, behind))
    return out[::-1]


def align(text: list[str], template: list[str], where: dict[str, list[int]], a: int, b: int, c: int, d: int) -> Pairs:
    """Matched (template place, text place) of template[a:b] and text[c:d]. Ranges within ranges wait on a list, so templates of any length are aligned."""
    waiting: list[Generator[tuple, Pairs, Pairs]] = [_align(text, template, where, a, b, c, d)]
    answer: Pairs | None = None
    while waiting:
        try:
            waiting.append(_align(text, template, where, *waiting[-1].send(answer)))
            answer = None
        except StopIteration as done:
            waiting.pop()
            answer = done.value
    return answer or []


def _align(text: list[str], template: list[str], where: dict[str, list[int]], a: int, b: int, c: int, d: int, after: bool = False, before: bool = False) -> Generator[tuple, Pairs, Pairs]:
    """The same; asks for the matches of a range within by its bounds.

    A range that begins right ``after`` a match, or ends right ``before`` one, first goes on from it word by word; a range that
    begins or ends elsewhere doesn't, since a stray word there would take the place of the notice's own. Then, anchors are words that occur once in both ranges; the longest rising run of them splits the ranges and each gap is aligned
    in turn. Where no word is unique in the text range, the template word with the fewest places there is tried at each of them
    within the stretch up to its neighbours' places, and the stretch with the most words close together counts (a notice may be
    repeated). Where no template word is unique either, the longest common sequence of both ranges is taken. So a notice that stands in the text word for word is always matched in full.
    """
    found: list[tuple[int, int]] = []
    while after and a < b and c < d and template[a] == text[c]:
        found.append((a, c))
        a, c = a + 1, c + 1
    closing: list[tuple[int, int]] = []
    while before and a < b and c < d and template[b - 1] == text[d - 1]:
        b, d = b - 1, d - 1
        closing.append((b, d))
    if a < b and c < d:
        seen: dict[str, int] = {}
        for w in template[a:b]:
            seen[w] = seen.get(w, 0) + 1
        spots = []
        for i in range(a, b):
            w = template[i]
            if seen[w] == 1 and w in where:
                p = where[w]
                lo, hi = bisect_left(p, c), bisect_left(p, d)
                if hi > lo:
                    spots.append((i, lo, hi, p))
        anchors = rising([(i, p[lo]) for i, lo, hi, p in spots if hi - lo == 1])
        if anchors:
            at = (a, c)
            for i, j in [*anchors, (b, d)]:
                found += yield at[0], i, at[1], j, after or at[0] > a, before or i < b
                if i < b:
                    found.append((i, j))
                at = (i + 1, j + 1)
        elif spots:
            i, lo, hi, p = min(spots, key=lambda s: s[2] - s[1])
            best, most = [], 0
            for k in range(lo, hi):
                left, right = (p[k - 1] + 1 if k > lo else c), (p[k + 1] if k + 1 < hi else d)
                one = [*(yield a, i, left, p[k], after and left == c, True), (i, p[k]), *(yield i + 1, b, p[k] + 1, right, True, before and right == d)]
                close = len(dense(one, b - a))
                if close > most:
                    best, most = one, close
            found += best
        else:
            found += common(template, where, a, b, c, d)
    return found + closing[::-1]


def possible(template: list[str], where: dict[str, list[int]], c: int, d: int) -> int:
    """The most words of the template that text[c:d] can match in any order: a bound on every alignment."""
    total = 0
    for w, n in Counter(template).items():
        p = where.get(w)
        if p:
            total += min(n, bisect_left(p, d) - bisect_left(p, c))
    return total


def scan_text(text: str, templates: dict[str, list[str]], vocabulary: frozenset[str], least: float = 0.8) -> list[tuple[str, float, int, int, int]]:
    """(name, coverage, matched words, begin, end) of every place where a template's coverage is ``least`` or more; begin and end are characters of the tightest span.

    A text that can't hold enough of a template's words in any order isn't aligned with it. Where a match is found, what stands before and
    after it is searched in turn, so a notice that is repeated is found at each of its places.
    """
    found = [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text)]
    words = [w for w, _, _ in found]
    where: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        if w in vocabulary:
            where.setdefault(w, []).append(i)
    out = []
    for name, template in templates.items() if where else ():
        ranges = [(0, len(words))]
        while ranges:
            c, d = ranges.pop()
            if possible(template, where, c, d) < least * len(template):
                continue
            pairs = dense(align(words, template, where, 0, len(template), c, d), len(template))
            if pairs and len(pairs) >= least * len(template):
                out.append((name, len(pairs) / len(template), len(pairs), found[pairs[0][1]][1], found[pairs[-1][1]][2]))
                ranges += [(c, pairs[0][1]), (pairs[-1][1] + 1, d)]
    return out


def outermost(found: list[tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int, int]]:
    """The matches without those that overlap a longer one (a short notice within a header, a text within one with more clauses), by place."""
    kept: list[tuple[str, float, int, int, int]] = []
    for m in sorted(found, key=lambda m: (-m[2], -m[1], m[0], m[3])):
        i = bisect_left(kept, m[3], key=lambda k: k[4] - 1)  # the first kept one that ends behind this one's begin
        if i == len(kept) or kept[i][3] >= m[4]:
            kept.insert(i, m)
    return kept


def dense(pairs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """The largest part of the alignment within a stretch of twice the template's words: far-off single words don't count."""
    best: list[tuple[int, int]] = []
    places = [j for _, j in pairs]
    for i, (_, j) in enumerate(pairs):
        k = bisect_right(places, j + 2 * length - 1)
        if k - i > len(best):
            best = pairs[i:k]
    return best


SCHEMA = "doc_id long, license string, coverage double, matched_words int, begin int, end int, n_licenses int, matches array<struct<license:string,coverage:double,matched_words:int,begin:int,end:int>>"
FIELDS = ("license", "coverage", "matched_words", "begin", "end")


def license_scan(docs: DataFrame, least: float = 0.8, templates: dict[str, str] | None = None) -> DataFrame:
    """One row a document: ``matches`` holds every notice of coverage ``least`` or more with its span, by place (of overlapping ones the longest);
    the columns beside it are those of the longest match, ``n_licenses`` counts the different names.

    Whole texts are read; ties go to the better covered, then the first template by name. Null and empty texts, and those without a match, have
    coverage 0 and no name. Row by row, without a shuffle; null and repeated ids keep their rows; other columns are ignored.
    """
    cut = {k: [m.group().lower() for m in WORD.finditer(v)] for k, v in sorted((templates or TEMPLATES).items())}
    vocabulary = frozenset(w for t in cut.values() for w in t)

    def rows(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc_id", *FIELDS, "n_licenses", "matches")}
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            found = outermost(scan_text(text or "", cut, vocabulary, least))
            best = max(found, key=lambda m: (m[2], m[1]), default=(None, 0.0, 0, None, None))
            for column, v in zip(out.values(), (doc_id, *best, len({m[0] for m in found}), [dict(zip(FIELDS, m)) for m in found])):
                column.append(v)
        return out

    return arrow_map(docs.selectExpr("cast(doc_id as long) doc_id", "text"), rows, SCHEMA)
