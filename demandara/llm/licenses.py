"""License scans: fingerprints in an inverted index, then banded alignment.

Word three-grams of every template are winnowed (the smallest hash of each window of two stays)
into an inverted index. A document's three-grams are winnowed the same way; what it shares with the
index names candidate templates and where they may start. A template too short for every alignment
that counts to share a winnowed three-gram is indexed by single words instead: one more of its rarer
words than an alignment may leave out. Around each such diagonal a banded
alignment of words finds how much of the template is really there, and from where to where.

Contract: words are runs of letters and digits, lower-cased. One row per found span; of
overlapping spans the one that covers most words of its template stays (ties: larger share,
earlier, template order). A span whose words name another license or version than its template
(``Index.agrees``) is none of that template. Null text is empty; documents without a license give no row. Repeated
rows and null ids give rows of their own. Templates of fewer than three words are one fingerprint;
templates without words match nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .arrow import map_arrow, slices, text_rows
from .decontamination import BLOCK_WORDS, _blocks, words_of
from .sketches import hashes_of

GRAM = 3
WINDOW = 2
SHARE = 0.8
#: Words left to others when a short template is indexed by single words.
COMMON = frozenset("a an and are as at by for from in is it of on or that the this to under with "
                   "work".split())
LONG = 64  # words from which a template is aligned in numpy
WORD = regex.compile(r"[\p{L}\p{N}]+")

#: Words that tell licenses apart. A line (at most ``LINE`` words) must show all its naming words; no
#: span but that of a body text (over ``NOTICE`` words) may show a variant word that its template lacks.
LINE = 16
NOTICE = 100
VARIANTS = frozenset("lesser library affero nd nc sa noncommercial noderivatives noderivs "
                     "sharealike".split())
NAMING = VARIANTS | frozenset("apache mit mozilla general bsd isc zlib unlicense cc cc0 creative gpl "
                              "lgpl agpl mpl only later".split())


def _lines() -> list[tuple[str, str]]:
    """One-sentence notices by family and version, and without a version."""
    found = []
    for name, title, versions in (
            ("Apache", "Apache License", ("2.0", "1.1", "1.0")),
            ("GPL", "GNU General Public License", ("3", "2", "1")),
            ("LGPL", "GNU Lesser General Public License", ("3", "2.1")),
            ("LGPL", "GNU Library General Public License", ("2",)),
            ("AGPL", "GNU Affero General Public License", ("3",)),
            ("MPL", "Mozilla Public License", ("2.0", "1.1", "1.0"))):
        for start in ("Licensed under the", "This work is licensed under the"):
            found += [(f"{name}-{v if '.' in v else v + '.0'}-line", f"{start} {title}, version {v}.")
                      for v in versions]
            found.append((f"{name}-line", f"{start} {title}."))
    found += [(f"{name}-line", f"Released under the {title} License.") for name, title in (
        ("BSD-4", "BSD 4-Clause"), ("BSD-0", "BSD 0-Clause"), ("BSD", "BSD"), ("zlib", "zlib"))]
    found.append(("Unlicense-line", "Released under the Unlicense."))
    found.append(("CC0-1.0-line", "Licensed under CC0 1.0."))
    for kind, title in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"),
                        ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
                        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                        ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
        found.append((f"CC-{kind}-line", f"Licensed under CC {kind}."))
        for v, port in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"),
                        ("2.0", "Generic"), ("1.0", "Generic")):
            long = title if v == "4.0" else title.replace("NoDerivatives", "NoDerivs")
            found += [(f"CC-{kind}-{v}-line", f"Licensed under CC {kind} {v}."),
                      (f"CC-{kind}-{v}", f"This work is licensed under a Creative Commons {long} {v} "
                                         f"{port} License.")]
    found += [(f"{key}-spdx", f"SPDX-License-Identifier: {key}") for key in (
        "Apache-2.0", "MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "Unlicense",
        "Zlib", "CC0-1.0", "MPL-1.1", "MPL-2.0",
        *(f"{g}{end}" for g in ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0",
                                "AGPL-3.0") for end in ("", "-only", "-or-later")),
        *(f"CC-{k}-{v}" for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
          for v in ("4.0", "3.0", "2.5", "2.0", "1.0")))]
    return found


def _gnu() -> list[tuple[str, str]]:
    """The first paragraph of the notices that the GNU licenses ask for."""
    found = []
    for name, what, title, v in (
            ("GPL-1.0", "program", "General", "1"), ("GPL-2.0", "program", "General", "2"),
            ("GPL-3.0", "program", "General", "3"), ("LGPL-2.0", "library", "Library General", "2"),
            ("LGPL-2.1", "library", "Lesser General", "2.1"),
            ("LGPL-3.0", "library", "Lesser General", "3"),
            ("AGPL-3.0", "program", "Affero General", "3")):
        start = (f"This {what} is free software: you can redistribute it and/or modify it under the "
                 f"terms of the GNU {title} Public License")
        found += [(name, f"{start} as published by the Free Software Foundation, either version {v} "
                         "of the License, or (at your option) any later version."),
                  (f"{name}-only", f"{start} version {v} as published by the Free Software "
                                   "Foundation.")]
    return found


def _bodies() -> list[tuple[str, str]]:
    """The license texts themselves."""
    return [(f"{path.stem}-body", path.read_text(encoding="utf-8"))
            for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


#: Names and texts of license notices, as their authors publish them.
NOTICES = (
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("MIT-line", "Released under the MIT License."),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-line", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-line", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-line", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0-line", "Licensed under the Mozilla Public License, version 2.0."),
    ("BSD-3-line", "Released under the BSD 3-Clause License."),
    ("BSD-2-line", "Released under the BSD 2-Clause License."),
    ("ISC-line", "Released under the ISC License."),
    ("CC-BY-4.0-line", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0-line", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 "
                  "International License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not "
                   "use this file except in compliance with the License. You may obtain a copy of "
                   "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
                   "applicable law or agreed to in writing, software distributed under the "
                   "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the "
                   "specific language governing permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files (the \"Software\"), to deal in the "
            "Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
            "and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under "
                "the terms of the GNU General Public License as published by the Free Software "
                "Foundation, either version 3 of the License, or (at your option) any later "
                "version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, "
                "v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain "
                "one at http://mozilla.org/MPL/2.0/."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose "
            "with or without fee is hereby granted, provided that the above copyright notice and "
            "this permission notice appear in all copies."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or "
                "neighboring rights to this work."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event "
             "will the authors be held liable for any damages arising from the use of this software. "
             "Permission is granted to anyone to use this software for any purpose, including "
             "commercial applications, and to alter it and redistribute it freely, subject to the "
             "following restrictions:"),
    *_lines(), *_gnu(), *_bodies(),
)


def templates(spark: SparkSession) -> DataFrame:
    """The notices above as a table (name, text)."""
    return spark.createDataFrame(list(NOTICES), "name string, text string")


def winnow(offsets: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the smallest hash of every window; all of a text with fewer hashes.

    A window over the border of two texts only adds places.
    """
    if len(h) < WINDOW:
        return np.arange(len(h))
    least = np.minimum(h[:-1], h[1:])
    keep = np.zeros(len(h), dtype=bool)
    keep[:-1] |= h[:-1] == least
    keep[1:] |= h[1:] == least
    short = np.flatnonzero(np.diff(offsets) == 1)
    keep[offsets[short]] = True
    return np.flatnonzero(keep)


def align(template: list[str], words: list[str], start: int) -> tuple[int, int, int]:
    """Longest common word sequence of the template and ``words`` within a band around the
    diagonal that starts at ``start``: (matched, first word, last word + 1)."""
    m = len(template)
    band = max(2, m // 5)
    if m >= LONG:
        return _align_long(template, words, start, band)
    width = 2 * band + 1
    # Per place of the band: (matched words, minus first place); a pair compares as a tuple.
    row = [(0, 0)] * width
    last = [-1] * width
    best = (0, 0, 0)
    for i in range(m):
        new, new_last = [(0, 0)] * width, [-1] * width
        for k in range(width):
            j = start + i + k - band  # the word met here
            old, end = row[k], last[k]  # diagonal: word before, template word before
            if 0 <= j < len(words) and words[j] == template[i]:
                old, end = (old[0] + 1, old[1] if old[0] else -j), j
            if k + 1 < width and row[k + 1] > old:  # template word left out
                old, end = row[k + 1], last[k + 1]
            if k and new[k - 1] > old:  # word of the document left out
                old, end = new[k - 1], new_last[k - 1]
            new[k], new_last[k] = old, end
            if old[0] > best[0]:
                best = (old[0], -old[1], end + 1)
        row, last = new, new_last
    return best


def _align_long(template: list[str], words: list[str], start: int, band: int
                ) -> tuple[int, int, int]:
    """The same row by row in numpy; a pair is matched * 2^32 - first place, which orders alike."""
    m, one = len(template), 1 << 32
    code: dict[str, int] = {}
    own = [code.setdefault(w, len(code)) for w in template]
    padded = np.full(m + 2 * band + 1, -1)
    a, b = max(0, start - band), min(len(words), start + m + band + 1)
    if b > a:
        padded[a - start + band:b - start + band] = [code.get(w, -1) for w in words[a:b]]
    width = 2 * band + 1
    row = np.zeros(width, np.int64)
    places = np.arange(start - band, start + m + band + 1)
    most, best, end = 0, 0, 0
    for i in range(m):
        # A word that matches adds one to the diagonal; the first one sets the place.
        new = np.where(padded[i:i + width] == own[i],
                       row + one - np.where(row == 0, places[i:i + width], 0), row)
        np.maximum(new[:-1], row[1:], out=new[:-1])  # template word left out
        np.maximum.accumulate(new, out=new)  # word of the document left out
        row = new
        top = -(-int(row[-1]) // one)
        if top > most:
            k = int(np.searchsorted(row, (top - 1) * one, side="right"))
            most, best, end = top, int(row[k]), int(places[i + k]) + 1
    return most, most * one - best, end


def common_words(masks: dict[str, int], m: int, words: list[str]) -> int:
    """Words of the longest common sequence of ``words`` and a template of ``m`` words without a band,
    a bit per template word: no less than an alignment can match."""
    full = (1 << m) - 1
    left = full
    for w in words:
        mask = masks.get(w)
        if mask:
            both = left & mask
            left = ((left + both) | (left - both)) & full
    return m - left.bit_count()


class Index:
    """Winnowed fingerprints of one block of templates."""

    def __init__(self, names: list[str], texts: list[str], share: float, first: int = 0):
        self.names, self.share, self.first = names, share, first
        offsets, codes, distinct = words_of(pa.array(texts, pa.string()))
        self.words = [[distinct[c] for c in codes[a:b]] for a, b in zip(offsets, offsets[1:])]
        self.counts = [Counter(w) for w in self.words]
        self.masks: dict[int, dict[str, int]] = {}
        self.least = [math.ceil(share * len(w) - 1e-9) for w in self.words]
        self.parts = []  # (gram width, sorted hashes, template, place in it)
        n = np.diff(offsets)
        # Words an alignment may leave out. Runs of four words that are left always share a winnowed
        # three-gram, and there is one where n > 4 * free + 3.
        free = n - np.array(self.least, dtype=np.int64)
        single = (n >= GRAM) & (n <= 4 * free + 3)
        whole = (n >= GRAM) & ~single
        for width in range(1, GRAM + 1):
            at, h = hashes_of(offsets, codes, distinct, width)
            place = winnow(at, h)
            owner = np.searchsorted(at, place, side="right") - 1
            mine = whole[owner] if width == GRAM else n[owner] == width
            place, owner = place[mine], owner[mine]
            if len(place):
                order = np.argsort(h[place], kind="stable")
                self.parts.append((width, h[place][order], owner[order],
                                   (place - at[owner])[order]))
        # Any free + 1 words of a short template hold one that an alignment matches.
        chosen = [(t, k) for t in np.flatnonzero(single).tolist()
                  for k in sorted(range(int(n[t])), key=lambda k: (
                      self.words[t][k] in COMMON, self.words[t][k].isdigit(),
                      -len(self.words[t][k]), k))[:int(free[t]) + 1]]
        if chosen:
            at, h = hashes_of(offsets, codes, distinct, 1)
            owner, place = np.array(chosen).T
            keys = h[at[owner] + place]
            order = np.argsort(keys, kind="stable")
            self.parts.append((1, keys[order], owner[order], place[order]))

    def hits(self, offsets, codes, distinct) -> dict[int, set[tuple[int, int]]]:
        """Per text: (template, word of the text where the template would start)."""
        found: dict[int, set[tuple[int, int]]] = {}
        for width, keys, owner, place in self.parts:
            at, h = hashes_of(offsets, codes, distinct, width)
            chosen = winnow(at, h) if width == GRAM else np.arange(len(h))
            a = np.searchsorted(keys, h[chosen], side="left")
            b = np.searchsorted(keys, h[chosen], side="right")
            some = b > a
            text = np.searchsorted(at, chosen[some], side="right") - 1
            for t, w, x, y in zip(text.tolist(), (chosen[some] - at[text]).tolist(),
                                  a[some].tolist(), b[some].tolist()):
                found.setdefault(t, set()).update(
                    (int(owner[k]), w - int(place[k])) for k in range(x, y))
        return found

    def agrees(self, t: int, span: list[str]) -> bool:
        """Whether the words of a span name no other license or version than template ``t``.

        Zero after a version's point may be missing. Only what a template names is compared.
        """
        own, met, line = self.counts[t], Counter(span), len(self.words[t]) <= LINE
        if len(self.words[t]) > NOTICE:
            return True
        if any(w in met and w not in own for w in VARIANTS):
            return False
        lost = [w for w, n in own.items()
                if w.isdigit() and w != "0" and met[w] < (n if line else 1)]
        if line:
            return not lost and all(w in met for w in own if w in NAMING)
        return all(w in met for w in own if w in VARIANTS) and not (
            lost and any(w.isdigit() and w not in own for w in met))

    def reaches(self, t: int, words: list[str], start: int) -> bool:
        """Whether an alignment that starts about ``start`` can match enough words."""
        m = len(self.words[t])
        if m < LONG:
            return True
        if t not in self.masks:
            places: dict[str, int] = {}
            for k, w in enumerate(self.words[t]):
                places[w] = places.get(w, 0) | 1 << k
            self.masks[t] = places
        band = max(2, m // 5)
        part = words[max(0, start - band):max(0, start + m + band)]
        return len(part) >= self.least[t] and common_words(self.masks[t], m, part) >= self.least[t]

    def spans(self, text: str, starts: set[tuple[int, int]]) -> list[tuple]:
        """(rank of the template, name, matched, share, start, end) of one text, overlaps included."""
        met = list(WORD.finditer(text))
        words = [m.group().lower() for m in met]
        found, done, there, possible = [], {}, Counter(words), {}
        for t, start in sorted(starts):
            template = self.words[t]
            if t not in possible:  # enough of the template's words stand anywhere in the text
                possible[t] = len(words) >= self.least[t] and sum(
                    min(n, there[w]) for w, n in self.counts[t].items()) >= self.least[t]
            if not possible[t]:
                continue
            # Starts within half a band of one that was aligned give the same alignment.
            if t in done and start - done[t] <= max(1, len(template) // 10):
                continue
            done[t] = start
            if not self.reaches(t, words, start):
                continue
            matched, a, b = align(template, words, start)
            if matched >= self.least[t] and self.agrees(t, words[a:b]):
                found.append((matched, matched / len(template), a, b, t))
        return [(self.first + t, self.names[t], matched, share, met[a].start(), met[b - 1].end())
                for matched, share, a, b, t in found]


def resolved(found: list[tuple]) -> list[tuple]:
    """Of the spans (rank of the template, name, matched, share, start, end) of one text, those that no
    better one overlaps, in text order. More matched words are better, then the larger share."""
    kept: list[tuple] = []
    for f in sorted(found, key=lambda f: (-f[2], -f[3], f[4], f[0])):
        if all(f[5] <= k[4] or k[5] <= f[4] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f[4])


def license_spans(docs: DataFrame, notices: DataFrame | None = None, share: float = SHARE,
                  id_col: str = "doc_id", text_col: str = "text", name_col: str = "name",
                  template_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc id, license, n_matched, coverage and the span (code points, end exclusive).

    Templates are worked on in blocks of about ``block_words`` words, one pass each. Overlaps are
    resolved over all blocks: with more than one the rows are written once with a number, and the
    spans of a row (no more than its text gives) meet again by it. Repeated rows and null ids stay
    rows of their own; no document or no template gives no rows. Other columns are ignored.
    """
    rows = text_rows(docs, id_col, text_col)
    kind = rows.schema["_id"].dataType.simpleString()
    shape = ("_id {}, license string, n_matched long, coverage double, span_start long, "
             "span_end long").format(kind)
    types = (pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    source = templates(docs.sparkSession) if notices is None else notices
    blocks = list(_blocks(source, name_col, template_col, block_words))
    if not blocks:
        return docs.sparkSession.createDataFrame([], shape).withColumnRenamed("_id", id_col)

    def search(texts_of: tuple[list, list], first: int, alone: bool):
        names, texts = texts_of

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index([str(n) for n in names], texts, share, first)
            for part in slices(batches):
                found = []
                hits = index.hits(*words_of(part["_text"]))
                for t in sorted(hits):
                    spans = index.spans(part["_text"][t].as_py(), hits[t])
                    found += [(t, *s) for s in (resolved(spans) if alone else spans)]
                columns = list(zip(*found)) or [()] * 7
                at = pa.array(columns[0], pa.int64())
                arrays = [pa.array(c, k) for c, k in zip(columns[2:], types)]
                if not alone:
                    arrays = [part["_row"].take(at), pa.array(columns[1], pa.int64()), *arrays]
                yield pa.RecordBatch.from_arrays(
                    [part["_id"].take(at), *arrays],
                    ["_id", *([] if alone else ["_row", "_rank"]), "license", "n_matched", "coverage",
                     "span_start", "span_end"])
        return work

    if len(blocks) == 1:
        return map_arrow(rows, search(blocks[0], 0, True), shape).withColumnRenamed("_id", id_col)

    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()))
    met, first = [], 0
    for block in blocks:
        met.append(map_arrow(rows, search(block, first, False), shape.replace(
            ", license", ", _row long, _rank long, license")))
        first += len(block[0])
    spans = F.struct("_rank", "license", "n_matched", "coverage", "span_start", "span_end")
    grouped = reduce(DataFrame.union, met).groupBy("_row").agg(
        F.first("_id").alias("_id"), F.collect_list(spans).alias("_spans"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = [(t, *s[1:]) for t, of_row in enumerate(part["_spans"].to_pylist())
                     for s in resolved([tuple(x.values()) for x in of_row])]
            columns = list(zip(*found)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [part["_id"].take(pa.array(columns[0], pa.int64())),
                 *[pa.array(c, k) for c, k in zip(columns[1:], types)]],
                ["_id", "license", "n_matched", "coverage", "span_start", "span_end"])

    return map_arrow(grouped.drop("_row"), choose, shape).withColumnRenamed("_id", id_col)
