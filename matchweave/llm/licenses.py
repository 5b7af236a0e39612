"""License scan by conditional compression.

A block of text that may be a license notice is compressed once plainly and once
with each license's wordings as a raw zstandard dictionary. The licenses that save
most are held against the block's wording first; of the others those are held too
whose words the block has, so that the order of savings hides no license. A wording is
confirmed if all its words stand in a row, with words of the holder's only where it
has a slot. What a longer confirmed wording covers is part of that one, and a wording
that is denied ("not released under...") isn't confirmed.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.llm.common import map_batches

_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_NOTICE = ", subject to the following conditions: The above copyright notice and this permission notice <4> shall be included in all copies or substantial portions of the Software"
_AS_IS = (
    ". THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL <12> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
    "OTHER DEALINGS IN THE SOFTWARE."
)
_X11 = " Except as contained in this notice, the name <12> shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization"
_TWO_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "<1> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "<1> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_THIRD = " <1> Neither the name of <12> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_FEE = "Permission to use, copy, modify, and <1> distribute this software for any purpose with or without fee is hereby granted"


def _gnu(kind: str, short: str, version: str) -> list[str]:
    forms = [version] if "." in version else [version, f"{version}.0"]
    name = f"GNU {kind}General Public License"
    return [
        f"{name} as published by the Free Software Foundation <1> either version {version} of the License", f"{name} version {version} as published by the Free Software Foundation",
        *[f"under <4> {name}, version {v}" for v in forms], *[f"under <4> {name} v{v}" for v in forms], *[f"under <4> GNU {short} version {v}" for v in forms],
        *[f"under <2> {text}" for v in forms for text in (f"{short}v{v}", f"{short} v{v}", f"{short} {v}", f"{short}-{v}")],
    ]


#: Identifying notices and license texts, public wordings; <n> stands for at most n words, of a holder or a list mark.
TEMPLATES = {
    "Apache-2.0": [
        "under <4> Apache License, Version 2.0", "under <4> Apache License 2.0", "under <2> Apache 2.0", "under <2> Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ],
    "MIT": ["under <4> MIT License", _GRANT + _NOTICE + _AS_IS], "MIT-0": ["under <4> MIT No Attribution License", _GRANT + _AS_IS], "X11": ["under <4> X11 License", _GRANT + _NOTICE + _AS_IS + _X11],
    "GPL-2.0": _gnu("", "GPL", "2"), "GPL-3.0": _gnu("", "GPL", "3"),
    "LGPL-2.0": [*_gnu("Library ", "LGPL", "2"), *_gnu("Lesser ", "LGPL", "2")[:2]], "LGPL-2.1": _gnu("Lesser ", "LGPL", "2.1"), "LGPL-3.0": _gnu("Lesser ", "LGPL", "3"), "AGPL-3.0": _gnu("Affero ", "AGPL", "3"),
    "MPL-2.0": [
        "under <4> Mozilla Public License, version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ],
    "BSD-2-Clause": ["under <4> BSD 2-Clause License", "under <4> 2-Clause BSD License", "under <4> Simplified BSD License", _TWO_CLAUSES],
    "BSD-3-Clause": ["under <4> BSD 3-Clause License", "under <4> 3-Clause BSD License", "under <4> New BSD License", _TWO_CLAUSES + _THIRD],
    "ISC": ["under <4> ISC License", _FEE + ", provided that the above copyright notice and this permission notice appear in all copies."],
    "0BSD": ["under <4> Zero-Clause BSD License", _FEE + ". THE SOFTWARE IS PROVIDED"],
    "BSL-1.0": [
        "Boost Software License - Version 1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, "
        "display, distribute, execute, and transmit the Software",
    ],
    "Zlib": [
        "under <4> zlib License", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"
    ],
    **{
        f"CC-{k}-4.0": [f"under <4> CC {k} 4.0", f"under <4> CC-{k}-4.0", f"under <4> Creative Commons {name} 4.0 International"]
        for k, name in {
            "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
            "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
        }.items()
    },
    "CC0-1.0": ["To the extent possible under law, <8> has waived all copyright and related or neighboring rights to", "under <4> CC0 1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved."],
}
#: A block with another confirmed license isn't this one: reserved rights stand above many a license.
_REST = "proprietary"
#: Words that deny the notice after them, within so many words.
_DENIALS, _DENIED_WITHIN = frozenset("not never neither nor cannot isn aren wasn weren".split()), 4
_TAG, _BETWEEN = "spdx-license-identifier", frozenset({"or", "and", "with"})
#: A block without any of these holds no notice.
ANCHORS = re.compile(r"licen[cs]|copyright|rights[\W_]+reserved|permission|redistribution|public[\W_]+domain|mozilla[\W_]+public|cc[\W_]by|cc0|[al]?gpl|spdx|apache[\W_]+2|creative[\W_]+commons", re.I)
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_WORKER: dict[tuple, Scanner] = {}


class Wording:
    """A template's words in segments, with a slot of at most so many words before each."""

    def __init__(self, text: str):
        parts = re.split(r"<(\d+)>", text)
        self.segments = [(int(parts[k - 1]) if k else 0, _words(parts[k])) for k in range(0, len(parts), 2)]
        self.words = [w for _, segment in self.segments for w in segment]
        self.first = self.words[0]

    def stand(self, words: list[str], i: int, k: int = 0) -> tuple[int, int]:
        """(words of the wording, place after the last) that stand in ``words`` from place ``i`` on, from segment ``k``.

        Of the ways to fill the slots, the first that reaches the end, else the one that goes furthest.
        """
        slot, segment = self.segments[k]
        best = (0, i)
        for skip in range(min(slot, len(words) - i) + 1):
            n, at = 0, i + skip
            while n < len(segment) and at + n < len(words) and words[at + n] == segment[n]:
                n += 1
            got = (n, at + n)
            if n == len(segment) and k + 1 < len(self.segments):
                more, end = self.stand(words, at + n, k + 1)
                got = (n + more, end if more else at + n)
            if got[0] > best[0]:
                best = got
                if got[0] == sum(len(x) for _, x in self.segments[k:]):
                    break
        return best


class Scanner:
    """``remember`` bounds the memo of blocks already judged, ``held`` the licenses that savings alone bring before the wording."""

    def __init__(self, templates: dict[str, list[str]], level: int = 3, remember: int = 20_000, held: int = 4):
        import zstandard

        self.plain, self.held = zstandard.ZstdCompressor(level=level), held
        self.known: list[tuple[str, list[Wording]]] = [(name, [Wording(t) for t in texts]) for name, texts in templates.items()]
        self.number = {name: k for k, name in enumerate(templates)}
        raw = [" ".join(re.sub(r"<\d+> ?", "", t) for t in texts).encode() for texts in templates.values()]
        self.packers = [zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(r, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for r in raw]
        self.begins: dict[str, list[Wording]] = {}
        for _, wordings in self.known:
            for w in wordings:
                self.begins.setdefault(w.first, []).append(w)
        self.tags = {f"{name}{end}".lower(): name for name in templates for end in ("", "-only", "-or-later")}
        self.reach = max(len(w.words) + sum(slot for slot, _ in w.segments) for _, wordings in self.known for w in wordings)
        self.memo: OrderedDict[str, list[tuple]] = OrderedDict()
        self.remember = remember

    def blocks(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of each candidate block, a range of whole lines.

        A block is a run of lines that hold an anchor word, with all lines of
        the templates, or beginnings of at least half a template, that stand in
        part in the run. Such wordings are sought as far around the run as the
        longest template has words. Blocks that share lines, or have only
        lines without a word between them, are one.
        """
        if not ANCHORS.search(text):
            return
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        ends = [*(at - 1 for at in starts[1:]), len(text)]
        runs: list[list[int]] = []
        for m in ANCHORS.finditer(text):
            first, last = bisect_right(starts, m.start()) - 1, bisect_right(starts, m.end() - 1) - 1
            if runs and first <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], last)
            else:
                runs.append([first, last])
        count = functools.cache(lambda line: sum(1 for _ in _WORD.finditer(text, starts[line], ends[line])))
        found: list[list[int]] = []
        for first, last in runs:
            top, bottom, above, below = first, last, 0, 0
            while top > 0 and above < self.reach:
                top -= 1
                above += count(top)
            while bottom < len(starts) - 1 and below < self.reach:
                bottom += 1
                below += count(bottom)
            low, high = first, last
            for a, b in self._wordings(text, starts[top], ends[bottom]):
                a, b = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
                if a <= last and b >= first:
                    low, high = min(low, a), max(high, b)
            while found and (found[-1][1] >= low or not any(count(line) for line in range(found[-1][1] + 1, low))):
                low, high = min(low, found[-1][0]), max(high, found.pop()[1])
            found.append([low, high])
        for first, last in found:
            yield starts[first], ends[last]

    def _wordings(self, text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        """(start, end) of each wording, or beginning of at least half of one, within ``text[lo:hi]``."""
        at = [m.span() for m in _WORD.finditer(text, lo, hi)]
        words = [text[a:b].lower() for a, b in at]
        for i, word in enumerate(words):
            for wanted in self.begins.get(word, ()):
                n, end = wanted.stand(words, i)
                if 2 * n >= len(wanted.words):
                    yield at[i][0], at[end - 1][1]

    def _spans(self, words: list[str], wording: Wording) -> list[tuple[int, int]]:
        """Where the whole wording stands and isn't denied."""
        out = []
        for i, word in enumerate(words):
            if word == wording.first:
                n, end = wording.stand(words, i)
                if n == len(wording.words) and not _DENIALS & set(words[max(0, i - _DENIED_WITHIN) : i]):
                    out.append((i, end))
        return out

    def _tagged(self, words: list[str]) -> Iterator[tuple[str, int, int]]:
        """(license, start, end) of the identifiers of machine-readable lines, which may name several."""
        for i, word in enumerate(words):
            if word == _TAG:
                at = i + 1
                while at < len(words) and (words[at] in self.tags or words[at] in _BETWEEN):
                    if words[at] in self.tags:
                        yield self.tags[words[at]], i, at + 1
                    at += 1

    def judge(self, block: str) -> list[tuple[str, float, int, int, bool]]:
        """(license, size reduction, wording's words missing, other words, confirmed) of a block.

        All confirmed licenses, those that save most first; with none confirmed, the
        best saver, with the differences from its closest wording, word by word.
        """
        if block in self.memo:
            self.memo.move_to_end(block)
            return self.memo[block]
        data, words = block.encode(), _words(block)
        base, has = len(self.plain.compress(data)), set(words)
        saved = [1 - len(p.compress(data)) / base for p in self.packers]
        order = sorted(range(len(saved)), key=lambda k: (-saved[k], k))
        spans: list[tuple[int, int, int]] = [(a, b, self.number[name]) for name, a, b in self._tagged(words)]
        for place, k in enumerate(order):
            for wording in self.known[k][1]:
                if place < self.held or has.issuperset(wording.words):
                    spans += [(a, b, k) for a, b in self._spans(words, wording)]
        # A span inside a longer one is part of that; of equal ones all count.
        own = [x for x in spans if not any(y[0] <= x[0] and x[1] <= y[1] and y[1] - y[0] > x[1] - x[0] and words[x[0]] != _TAG for y in spans)]
        if any(self.known[k][0] != _REST for _, _, k in own):
            own = [x for x in own if self.known[x[2]][0] != _REST]
        length: dict[int, int] = {}
        for a, b, k in own:
            length[k] = max(length.get(k, 0), b - a)
        out = [(self.known[k][0], saved[k], 0, len(words) - length[k], True) for k in order if k in length]
        if not out and order:
            name, wordings = self.known[order[0]]
            missing, extra = min(differences(words, w.words) for w in wordings)
            out = [(name, saved[order[0]], missing, extra, False)]
        if len(block) <= 4096:
            self.memo[block] = out
            if len(self.memo) > self.remember:
                self.memo.popitem(last=False)
        return out


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def differences(words: list[str], wanted: list[str]) -> tuple[int, int]:
    """(words of ``wanted`` that are missing, words beyond it) outside a longest common sequence.

    The row of the usual table is one long number, so a block takes time in proportion
    to its words.
    """
    places: dict[str, int] = {}
    for k, w in enumerate(wanted):
        places[w] = places.get(w, 0) | 1 << k
    full = row = (1 << len(wanted)) - 1
    for w in words:
        if hit := row & places.get(w, 0):
            row = ((row + hit) | (row - hit)) & full
    common = len(wanted) - row.bit_count()
    return len(wanted) - common, len(words) - common


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate block and confirmed license of every whole text.

    A block without a confirmed license gives one row of the one that saves most.

    doc_id, start and end (code points, end exclusive), block, license, reduction
    (share of the compressed size that its dictionary saves), missing and extra (words
    of the wording that the block lacks, and words beyond it) and confirmed. A
    wording counts only if all its words stand in a row, slots filled; reserved rights
    count as proprietary only in a block without another license. Texts without an anchor word, null and empty
    texts give no rows; repeated rows are scanned each for itself; other columns
    are ignored.
    """
    templates = templates or TEMPLATES

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tuple((k, tuple(v)) for k, v in templates.items())
        scanner = _WORKER.setdefault(key, None) or Scanner(templates)
        _WORKER[key] = scanner
        names = ["doc_id", "start", "end", "block", "license", "reduction", "missing", "extra", "confirmed"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_()]
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for a, b in scanner.blocks(text or ""):
                    out += [(doc_id, a, b, text[a:b], *judged) for judged in scanner.judge(text[a:b])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = "doc_id long, start long, end long, block string, license string, reduction double, missing int, extra int, confirmed boolean"
    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, schema)
