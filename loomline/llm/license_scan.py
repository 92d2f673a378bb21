"""License scans by patience alignment.

Texts and templates are words (runs of ASCII letters and digits, or non-ASCII characters; A-Z lower-cased). A template is
aligned with a text by the words that are unique in both: the longest increasing subsequence of these anchors is kept,
and the gaps between them are aligned in the same way. Coverage is the share of the template's words that are matched.

Where a text repeats a notice, its words aren't unique in the whole text; then windows around occurrences of the
template's locally rarest words are aligned instead (so many of them that a coverage over the threshold can't avoid
them all). A bound that can't lose a match comes first: no alignment covers more than the multiset of common words.

An alignment counts where it stands: one whose words are spread over ``SPREAD`` times its template's length or more is
no license notice but common words of a long text, and is left out, whatever it covers; so a notice that is cut up by
as much other text as that isn't found. Windows of templates of ``LONG`` words and more are widened to a grid of an eighth of the
template, so that near ones are tried once; a widened window holds all of the exact one, but words that occur again in what is
added are unique no more, which ``cover``'s recursion into gaps makes up for except at the seams.

Templates are of two kinds. Lines, grants and headers are notices: their coverage is of the notice, not of the license it
names. Those named ``-text`` are whole licenses, from ``license_texts``. The words in ``REQUIRED`` tell a template from
its relatives (name and version): only an alignment counts that has them side by side. Of whole texts and grants found
at one place, which share most of their words, the one with most matched words stays; the others are looked for again
in the rest of the document.

Defined cases: null, empty and wordless texts have no license and coverage 0; very long texts are scanned whole; of
templates that tie on coverage the longest wins, then the first name; repeated rows are reported each; an empty table
gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.shared import ASCII_LOWER, slices, text_bytes, word_hashes, word_spans

THRESHOLD = 0.8
#: Times its template's length from which on an alignment is spread too far to be a notice.
SPREAD = 2
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

# Notices of public licenses.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-line": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "all-rights-reserved": "All rights reserved.",
    "agpl-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-line": "Released under the BSD License.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-nd-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-sa-4.0-line": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nd-4.0-line": "Licensed under CC BY-ND 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-nd-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nd-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0-line": "Released under CC0 1.0.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "isc-line": "Released under the ISC License.",
    "lgpl-2.1-line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0-line": "Licensed under the Mozilla Public License, Version 2.0.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

# Licenses whose whole text is at hand.
TEXTS = "0bsd apache-2.0 bsd-2-clause bsd-3-clause cc-by-sa-4.0 cc0-1.0 gpl-2.0 gpl-3.0 isc lgpl-2.1 lgpl-3.0 mit mit-0 mpl-2.0".split()
TEMPLATES |= {f"{name}-text": (resources.files(__package__) / "license_texts" / f"{name}.txt").read_text("utf-8") for name in TEXTS}

#: Words that must stand side by side, in the template's first place that has them, for an alignment to count.
REQUIRED = {
    "agpl-3.0-line": ("gnu affero general", "version 3"),
    "agpl-3.0-header": ("gnu affero general", "version 3"),
    "apache-2.0-line": ("apache", "2 0"),
    "apache-2.0-header": ("apache", "2 0"),
    "apache-2.0-text": ("apache license version 2 0",),
    "bsd-line": ("bsd",),
    "cc-by-4.0-line": ("cc by 4 0",),
    "cc-by-nc-4.0-line": ("cc by nc 4 0",),
    "cc-by-nc-nd-4.0-line": ("cc by nc nd 4 0",),
    "cc-by-nc-sa-4.0-line": ("cc by nc sa 4 0",),
    "cc-by-nd-4.0-line": ("cc by nd 4 0",),
    "cc-by-sa-4.0-line": ("cc by sa 4 0",),
    "cc-by-4.0-notice": ("attribution 4 0",),
    "cc-by-nc-4.0-notice": ("attribution noncommercial 4 0",),
    "cc-by-nc-nd-4.0-notice": ("attribution noncommercial noderivatives 4 0",),
    "cc-by-nc-sa-4.0-notice": ("attribution noncommercial sharealike 4 0",),
    "cc-by-nd-4.0-notice": ("attribution noderivatives 4 0",),
    "cc-by-sa-4.0-notice": ("attribution sharealike 4 0",),
    "cc-by-sa-4.0-text": ("attribution sharealike 4 0",),
    "cc0-1.0-line": ("cc0 1 0",),
    "cc0-1.0-text": ("cc0 1 0",),
    "gpl-2.0-line": ("gnu general", "version 2"),
    "gpl-2.0-header": ("gnu general", "version 2"),
    "gpl-2.0-text": ("gnu general public license version 2",),
    "gpl-3.0-line": ("gnu general", "version 3"),
    "gpl-3.0-header": ("gnu general", "version 3"),
    "gpl-3.0-text": ("gnu general public license version 3",),
    "isc-line": ("isc",),
    "lgpl-2.1-line": ("gnu lesser general", "version 2 1"),
    "lgpl-2.1-header": ("gnu lesser general", "version 2 1"),
    "lgpl-2.1-text": ("gnu lesser general public license version 2 1",),
    "lgpl-3.0-line": ("gnu lesser general", "version 3"),
    "lgpl-3.0-header": ("gnu lesser general", "version 3"),
    "lgpl-3.0-text": ("gnu lesser general public license version 3",),
    "mit-line": ("mit",),
    "mpl-2.0-line": ("mozilla", "2 0"),
    "mpl-2.0-header": ("mozilla public license v 2 0",),
    "mpl-2.0-text": ("mozilla public license version 2 0",),
}

#: From this many words on, windows begin and end on a grid of an eighth of the template, so that few differ.
LONG = 256


def words_of(text: str) -> list[str]:
    data = ASCII_LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), BETWEEN)
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _increasing(values: Sequence[int]) -> list[int]:
    """Indexes of a longest increasing subsequence (patience sorting with back pointers)."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[pile], piles[pile] = v, i
        back[i] = piles[pile - 1] if pile else -1
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Matched positions of ``a`` and ``b``, increasing in both."""
    matched: list[tuple[int, int]] = []
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        anchors = [(i, where[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in where]
        kept = [anchors[k] for k in _increasing([j for _, j in anchors])]
        for (i, j), (i2, j2) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)], strict=True):
            if kept:
                open_.append((i + 1, i2, j + 1, j2))
        matched += kept
    return sorted(matched)


def find_words(words: Sequence, wanted: Sequence) -> range:
    """Positions of the first place where ``wanted`` stands side by side."""
    at = next(i for i in range(len(words)) if list(words[i : i + len(wanted)]) == list(wanted))
    return range(at, at + len(wanted))


def cover(template: Sequence, text: Sequence, places: Sequence[int], threshold: float = THRESHOLD, required: Sequence[range] = ()) -> tuple[int, int, int]:
    """Most matched words of the template and the places of the first and last of them in the document.

    ``text`` holds the document's words that occur in any template, ``places`` where they stand in the document. Only
    an alignment counts that lies within twice the template's length and has the ``required`` positions side by side.
    """
    best, size = (0, -1, -1), len(template)
    tried: set[tuple[int, int]] = set()
    step = size // 8 if size >= LONG else 1

    def beside(found: Sequence[tuple[int, int]], lo: int) -> bool:
        at = {i: places[lo + j] for i, j in found} if required else {}
        return all(i in at and at[i] - at.get(r[0], -1) == i - r[0] for r in required for i in r)

    def consider(lo: int, hi: int) -> None:
        nonlocal best
        if (lo, hi) in tried:
            return
        tried.add((lo, hi))
        found = patience(template, text[lo:hi])
        if found and beside(found, lo):
            first, last = places[lo + found[0][1]], places[lo + found[-1][1]]
            if last - first < SPREAD * size and (len(found), -first) > (best[0], -best[1]):
                best = (len(found), first, last)

    consider(0, len(text))
    if best[0] < size:
        counts = Counter(text)
        rarest = sorted(range(size), key=lambda i: (counts[template[i]], i))[: size - int(np.ceil(threshold * size)) + 1]
        at_word: dict = {}
        for k, w in enumerate(text):
            at_word.setdefault(w, []).append(k)
        for i in rarest:
            for k in at_word.get(template[i], ()):
                lo, hi = places[k] - i - size // 2, places[k] - i + size + size // 2 + 1
                consider(bisect_left(places, lo // step * step), bisect_left(places, -(-hi // step) * step))
                if best[0] == size:
                    return best
    return best


def whole_texts(at: Sequence[int], ids: Sequence[Sequence[int]], need: np.ndarray, text: list[int], places: list[int], threshold: float, required: Sequence[Sequence[range]]) -> dict[int, tuple[int, int, int]]:
    """Covers of the templates ``at`` that share most of their words: one at a place, that with most matched words."""
    kept: dict[int, tuple[int, int, int]] = {}
    known: dict[int, tuple[int, int, int]] = {}
    while True:
        bound = np.minimum(np.bincount(text, minlength=need.shape[1]), need[list(at)]).sum(axis=1)
        at = [t for t, b in zip(at, bound.tolist(), strict=True) if b >= np.ceil(threshold * len(ids[t]))]
        for t in at:
            if t not in known:
                known[t] = cover(ids[t], text, places, threshold, required[t])
        at = [t for t in at if known[t][0] >= np.ceil(threshold * len(ids[t]))]
        if not at:
            return kept
        win = max(at, key=lambda t: (known[t][0], known[t][0] / len(ids[t]), -t))
        _, lo, hi = known[win]
        if win not in kept or known[win][0] > kept[win][0]:
            kept[win] = known[win]
        a, b = bisect_left(places, lo), bisect_left(places, hi + 1)
        text, places = text[:a] + text[b:], places[:a] + places[b:]
        known = {t: c for t, c in known.items() if c[2] < lo or c[1] > hi}


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD, required: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """doc_id, n_words, license (null if none), coverage, matched, first_word, last_word and licenses (all found, sorted, by comma).

    ``required`` is ``REQUIRED`` for the templates of this module, else nothing.
    """
    if required is None:
        required = REQUIRED if templates is TEMPLATES else {}
    texts = {name: words_of(t) for name, t in templates.items()}
    vocabulary = {w: k for k, w in enumerate(sorted({w for t in texts.values() for w in t}))}
    names = sorted(texts, key=lambda n: (-len(texts[n]), n))
    ids = [[vocabulary[w] for w in texts[n]] for n in names]
    beside = [[find_words(texts[n], words_of(r)) for r in required.get(n, ())] for n in names]
    whole = {t for t, n in enumerate(names) if n.endswith(("-text", "-grant"))}
    need = np.array([np.bincount(t, minlength=len(vocabulary)) for t in ids])
    least = np.array([np.ceil(threshold * len(t)) for t in ids])
    joined = " ".join(vocabulary)
    data = np.frombuffer(joined.encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), BETWEEN)
    hashes = word_hashes(data, starts, ends)
    order = np.argsort(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hashes[order]
        for all_rows in batches:
            for batch in slices(all_rows, 1):
                raw, rows = text_bytes(batch.column(1))
                raw = ASCII_LOWER[raw]
                begin, end, first = word_spans(raw, rows, BETWEEN)
                own = word_hashes(raw, begin, end)
                k = np.minimum(np.searchsorted(known, own), len(known) - 1)
                hits = np.flatnonzero(known[k] == own)
                word, cuts = order[k[hits]], np.searchsorted(hits, first)
                out = []
                for row in range(batch.num_rows):
                    mine = word[cuts[row] : cuts[row + 1]]
                    found = []
                    if len(mine):
                        bound = np.minimum(np.bincount(mine, minlength=len(vocabulary)), need).sum(axis=1)
                        places = (hits[cuts[row] : cuts[row + 1]] - first[row]).tolist()
                        able = np.flatnonzero(bound >= least).tolist()
                        covers = {t: cover(ids[t], mine.tolist(), places, threshold, beside[t]) for t in able if t not in whole}
                        if any(t in whole for t in able):
                            covers |= whole_texts([t for t in able if t in whole], ids, need, mine.tolist(), places, threshold, beside)
                        for t, (matched, lo, hi) in covers.items():
                            if matched >= least[t]:
                                found.append((matched / len(ids[t]), -t, matched, lo, hi))
                    top = max(found, default=None)
                    named = ",".join(sorted(names[-f[1]] for f in found))
                    out.append((int(first[row + 1] - first[row]), *((names[-top[1]], top[0], *top[2:]) if top else (None, 0.0, 0, None, None)), named))
                kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                columns = list(zip(*out, strict=True)) if out else [[]] * 7
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "license", "coverage", "matched", "first_word", "last_word", "licenses"])

    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return frame.mapInArrow(run, "doc_id long, n_words long, license string, coverage double, matched long, first_word long, last_word long, licenses string")
