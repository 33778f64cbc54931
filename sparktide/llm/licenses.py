"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures them.

Templates are cut into 3-word grams, winnowed (of each 2 neighbours the lesser hash stays), and kept in an
inverted index gram -> (template, place). A document's grams are looked up, all of them, so a template
shows wherever 4 of its words stand in a row. Hits of one template close to each other
make a candidate, and a local alignment in a band around their diagonal gives the words that match, the share of the
template they cover, and the span. One scan, no shuffle; the index is a few kilobytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick
from .textkernel import Words, chunks

GRAM = 3
WINNOW = 2
MIN_COVERAGE = 0.8

TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This program is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "Licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "Licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "All-rights-reserved": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def winnow(h: np.ndarray, w: int = WINNOW) -> np.ndarray:
    """Places of the (rightmost) least hash of each w neighbours; all of fewer than w."""
    if len(h) <= w:
        return np.arange(len(h))
    views = np.lib.stride_tricks.sliding_window_view(h, w)[:, ::-1]
    return np.unique(np.arange(len(views)) + w - 1 - views.argmin(axis=1))


class Index:
    """Sorted fingerprints of all templates, and the (template, place) of each."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, w: int = WINNOW):
        self.names, self.gram = sorted(templates), gram
        self.words = []
        hs, ts, ps = [], [], []
        for i, name in enumerate(self.names):
            words = Words([templates[name]])
            if len(words.hash) < gram:
                raise ValueError(f"template {name!r} has fewer than {gram} words")
            g, valid = words.ngrams(gram)
            at = winnow(g[valid], w)
            hs.append(g[at])
            ts.append(np.full(len(at), i))
            ps.append(at)
            self.words.append(words.hash.tolist())
        h, t, p = (np.concatenate(x) for x in (hs, ts, ps))
        order = np.argsort(h, kind="stable")
        self.hash, self.template, self.place = h[order], t[order], p[order]
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.hash >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place among g, template and place in it, for each meeting."""
        at = np.flatnonzero(self.maybe[(g >> np.uint64(48)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hash, g[at]), np.searchsorted(self.hash, g[at], side="right")
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(at, n), self.template[entry], self.place[entry]


def align(a: list[int], b: list[int], lo: int, hi: int) -> tuple[int, int, int]:
    """Best local alignment of a and b with places j - i of b against a between lo and hi.

    A match counts 1, a mismatch or gap -1. Returns the number of matched words and the span of b they
    cover (end exclusive); of equal scores more matches, then the earlier end.
    """
    best = (0, 0, 0, 0)
    # cell: score, matches, where in b it started
    above: dict[int, tuple[int, int, int]] = {}
    for i, x in enumerate(a):
        row: dict[int, tuple[int, int, int]] = {}
        left = None
        for j in range(max(0, i + lo), min(len(b), i + hi + 1)):
            cell = None
            s, m, start = above.get(j - 1, (0, 0, j))
            if x == b[j]:
                cell = (s + 1, m + 1, start if m else j)
            elif s > 1:
                cell = (s - 1, m, start)
            for other in (above.get(j), left):
                if other and other[0] > 1 and (cell is None or other[0] - 1 > cell[0]):
                    cell = (other[0] - 1, other[1], other[2])
            left = cell
            if cell:
                row[j] = cell
                if x == b[j] and (cell[0], cell[1]) > best[:2]:
                    best = (cell[0], cell[1], cell[2], j + 1)
        above = row
    return best[1], best[2], best[3]


def scan(index: Index, texts: list[str], min_coverage: float) -> list[tuple[int, int, float, int, int, int]]:
    """(text, template, coverage, matched words, start, end) of each match, in order."""
    w = Words(texts)
    g, valid = w.ngrams(index.gram)
    p, t, q = index.hits(g)
    ok = valid[p]
    p, t, q = p[ok], t[ok], q[ok]
    order = np.lexsort((p, t, w.doc[p]))
    p, t, q = p[order], t[order], q[order]
    out = []
    i = 0
    while i < len(p):
        name, doc = int(t[i]), int(w.doc[p[i]])
        template = index.words[name]
        band = max(4, len(template) // 5)
        j = i + 1
        # hits that could belong to one copy: the next begins where the copy that starts here must have ended
        while j < len(p) and t[j] == name and w.doc[p[j]] == doc and p[j] - q[j] <= p[j - 1] - q[j - 1] + band and p[j] <= p[i] + len(template) + band and q[j] > q[j - 1] - band:
            j += 1
        shift = p[i:j] - q[i:j]
        lo_w, hi_w = int(w.off[doc]), int(w.off[doc + 1])
        start = max(lo_w, int(shift.min()) - band)
        stop = min(hi_w, int(shift.max()) + len(template) + band)
        words = w.hash[start:stop].tolist()
        matched, a, b = align(template, words, int(shift.min()) - start - band, int(shift.max()) - start + band)
        coverage = matched / len(template)
        if coverage >= min_coverage:
            out.append((doc, name, coverage, matched, int(w.start[start + a]), int(w.end[start + b - 1])))
        i = j
    return widest(out)


def widest(found: list[tuple[int, int, float, int, int, int]]) -> list[tuple[int, int, float, int, int, int]]:
    """Without matches that lie in another template's match of the same text, of more words and no less coverage."""
    by: dict[int, list] = {}
    for m in found:
        by.setdefault(m[0], []).append(m)
    return [m for m in found if not any(o[1] != m[1] and o[3] > m[3] and o[2] >= m[2] and o[4] <= m[4] and m[5] <= o[5] for o in by[m[0]])]


def _scan(index: Index, min_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column("text").to_pylist()):
                found = list(dict.fromkeys(scan(index, texts, min_coverage)))
                if found:
                    doc, name, coverage, matched, start, end = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array([first + d for d in doc])), pa.array([index.names[n] for n in name]), pa.array(coverage), pa.array(matched, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["doc_id", "license", "coverage", "matched_words", "start_char", "end_char"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, license, coverage, matched_words, start_char, end_char: every place where a template is covered enough.

    coverage is matched words over the template's words. A document can have several matches, also of several
    templates, and of one template at several places; a match within that of another template which matches more words and
    is covered no less isn't reported ("CC BY 4.0" fits a notice of "CC BY-NC 4.0" but for one word). Offsets count code points. NULL and
    empty texts have none; texts of any length are read whole; repeated rows are reported each. Ids of any type, NULL too, are given as they are.
    Of alignments that score alike the one that ends first is reported. Other columns don't matter; an empty table gives no rows.
    A template needs 3 words or more.
    """
    index = Index(templates or TEMPLATES)
    d = pick(docs, id=id_col, text=text_col).select("id", F.col("text").cast("string").alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    return d.mapInArrow(_scan(index, min_coverage), f"doc_id {kind}, license string, coverage double, matched_words int, start_char int, end_char int")


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
