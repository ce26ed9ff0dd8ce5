"""License scans: MinHash bands over text windows find license templates, exact containment decides.

A text's words (lower case) make five-word shingles. For each template of m shingles, a window of m
shingles starts at every word of the whole text; each window's MinHash signature is cut into bands,
and a window that shares a band with the template is a candidate. The bands are as many as it takes
for a window at the least Jaccard similarity of an occurrence to share one with probability
GUARANTEE. A candidate is a match if the words around the window hold at least CONTAINMENT of the
template's shingles, compared as words. Of matches of several licenses at one place (they share at least
half of the shorter one) the one that holds most distinct shingles stays, then the one of the largest
share; where both are equal, all stay. So a relative's name is not given to a license that is known.

Work is by document and in tasks alone; templates are a small fixed table. Defined results: null,
empty and short texts match nothing; repeated rows are scanned separately; a text that repeats a
license has one row with the number of separate occurrences; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import json
import math
import pkgutil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import joined, map_texts
from .wordhash import mix, words

# License notices as their licenses word them, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                         "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
                         "License, or (at your option) any later version"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
_GNU = ("This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by "
        "the Free Software Foundation, either version {2} of the License, or (at your option) any later version")
_GNU_2 = _GNU.replace("software:", "software;").replace(", either", "; either")
#: Notices of relatives of the above.
RELATIVES = (
    ("AGPL-3.0-or-later", _GNU.format("program", "Affero General Public License", "3")),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring "
                "rights to this software to the public domain worldwide"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0-or-later", _GNU_2.format("program", "General Public License", "2")),
    ("LGPL-2.0-or-later", _GNU_2.format("library", "Library General Public License", "2")),
    ("LGPL-2.1-or-later", _GNU_2.format("library", "Lesser General Public License", "2.1")),
    ("LGPL-3.0-or-later", _GNU.format("program", "Lesser General Public License", "3")),
    ("LGPL-3.0-or-later", _GNU.format("library", "Lesser General Public License", "3")),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Whole texts; that of AGPL-3.0 is its terms only, composed of GPL-3.0's and its own section 13.
WHOLE = tuple(tuple(x) for x in json.loads(pkgutil.get_data(__package__, "license_texts.json")))
SHINGLE = 5
#: Windows of templates of more shingles are verified one for each eighth of the template's length.
LONG = 64
CONTAINMENT = 0.8
GUARANTEE = 0.999
ROWS = 2

#: Letters in lower case, digits and everything outside ASCII make words; the rest is blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
class Words:
    """Words of folded texts laid end to end: places, owner and a 64-bit hash of each."""

    def __init__(self, texts: list[bytes]):
        self.data, at = joined([t.translate(_FOLD) + b" " for t in texts])
        self.start, self.end, self.hash = words(self.data, self.data != 32)
        self.owner = np.searchsorted(at, self.start, "right") - 1
        self.first = np.searchsorted(self.owner, np.arange(len(texts) + 1))  # first word of each text

    def shingles(self, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they lie in one text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + self.hash[k:k + m]
        return mix(h), self.owner[:m] == self.owner[n - 1:]

    def words(self, lo: int, hi: int) -> list[bytes]:
        return [bytes(self.data[a:b]) for a, b in zip(self.start[lo:hi], self.end[lo:hi])]


def least_jaccard(m: int, containment: float = CONTAINMENT) -> float:
    """Least similarity of a template of m shingles and the window over an occurrence of it."""
    shared = math.ceil(containment * m - 1e-9)
    return shared / (2 * m - shared)


def band_settings(m: int) -> tuple[int, int]:
    """(rows of a band, bands) for templates of m shingles."""
    j = least_jaccard(m)
    return (1, 1) if j >= 1 else (ROWS, math.ceil(math.log(1 - GUARANTEE) / math.log(1 - j ** ROWS)))


class _Template:
    def __init__(self, name: str, text: str):
        w = Words([text.encode()])
        own = w.words(0, len(w.hash))
        self.name = name
        self.shingles = {tuple(own[i:i + SHINGLE]) for i in range(len(own) - SHINGLE + 1)}
        if not self.shingles:
            raise ValueError(f"a template needs {SHINGLE} words: {text!r}")
        self.m = len(own) - SHINGLE + 1
        self.short = (w.shingles()[0] >> np.uint64(32)).astype(np.uint32)


_NONE = np.uint32(0xFFFFFFFF)
_SEEDS = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _ladder(values: np.ndarray, longest: int) -> list[np.ndarray]:
    """Least of the 1, 2, 4, ... values from each place on."""
    out = [values]
    while 2 << len(out) - 1 <= longest:
        half = 1 << len(out) - 1
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def _window_min(ladder: list[np.ndarray], m: int) -> np.ndarray:
    """Least of the m values from each place on."""
    top = m.bit_length() - 1
    rest = m - (1 << top)
    return np.minimum(ladder[top][:len(ladder[top]) - rest], ladder[top][rest:]) if rest else ladder[top]


def _shortest(kinds: list[tuple], places: list[int]) -> tuple[int, int]:
    """First and last place of the shortest stretch that holds all kinds."""
    wanted, have, lo, best = len(set(kinds)), {}, 0, (places[0], places[-1])
    for hi, kind in enumerate(kinds):
        have[kind] = have.get(kind, 0) + 1
        while have[kinds[lo]] > 1:
            have[kinds[lo]] -= 1
            lo += 1
        if len(have) == wanted and places[hi] - places[lo] < best[1] - best[0]:
            best = places[lo], places[hi]
    return best


def _without_relatives(matches: list) -> list:
    """The matches (shingles, share, ..., name, stretch) without those of which a better one of another name
    lies at the same place."""
    kept: list = []
    for x in sorted(set(matches), key=lambda m: (-m[0], -m[1], m[2:])):
        a, b = x[-1]
        if not any(k[-2] != x[-2] and k[:2] > x[:2] and 2 * (min(b, k[-1][1]) - max(a, k[-1][0])) >= min(b - a, k[-1][1] - k[-1][0])
                   for k in kept):
            kept.append(x)
    return kept


class Scanner:
    def __init__(self, templates=TEMPLATES + RELATIVES + WHOLE):
        self.templates = [_Template(*t) for t in templates]
        self.longest = max(t.m for t in self.templates)

    def candidates(self, laid: Words):
        """(template, first shingle of a window that shares a band with it)."""
        hashes, within = laid.shingles()
        if not within.any():
            return
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        places = len(short)
        hits = [np.zeros(places, bool) for _ in self.templates]
        same: list = [None] * len(self.templates)
        values = np.full(places + self.longest, _NONE)  # what lies behind the last shingle is never least
        settings = [band_settings(t.m) for t in self.templates]
        for n in range(max(rows * bands for rows, bands in settings)):
            values[:places] = np.where(within, short * _SEEDS[n % 256], _NONE)
            ladder = _ladder(values, self.longest)
            for k, (t, (rows, bands)) in enumerate(zip(self.templates, settings)):
                if n >= rows * bands:
                    continue
                equal = _window_min(ladder, t.m)[:places] == (t.short * _SEEDS[n % 256]).min()
                same[k] = equal if n % rows == 0 else same[k] & equal
                if n % rows == rows - 1:
                    hits[k] |= same[k]
        for t, h in zip(self.templates, hits):
            last = None
            for at in np.flatnonzero(h).tolist():
                if t.m > LONG and last is not None and at - last < t.m // 8 and laid.owner[at] == laid.owner[last]:
                    continue  # the last one's surroundings hold this one's
                last = at
                yield t, at

    def scan(self, texts: list[bytes]) -> list[list[tuple[str, float, int, int]]]:
        """Of each text, sorted: (license, best containment, first word of that place, occurrences)."""
        laid = Words(texts)
        found: list[list[tuple[int, float, int, int, str, tuple[int, int]]]] = [[] for _ in texts]
        for t, at in self.candidates(laid):
            for doc in np.unique(laid.owner[at:at + t.m + SHINGLE]).tolist():  # a window may reach into the next text
                first = int(laid.first[doc])
                reach = t.m // 2 + (t.m // 8 if t.m > LONG else 0)
                lo, hi = max(first, at - reach - 1), min(int(laid.first[doc + 1]), at + t.m + SHINGLE + reach)
                around = laid.words(lo, hi)
                held = [i for i in range(len(around) - SHINGLE + 1) if tuple(around[i:i + SHINGLE]) in t.shingles]
                kinds = [tuple(around[i:i + SHINGLE]) for i in held]
                count = len(set(kinds))
                share = count / len(t.shingles)
                if share >= CONTAINMENT:
                    a, b = _shortest(kinds, held)
                    found[doc].append((count, share, lo + held[0] - first, lo + held[-1] + SHINGLE - first, t.name,
                                       (lo + a - first, lo + b + SHINGLE - first)))
        out = []
        for own in found:
            rows, by_name = [], {}
            for _, share, a, b, name, _ in _without_relatives(own):
                by_name.setdefault(name, []).append((share, a, b))
            for name, spans in sorted(by_name.items()):
                best = min(spans, key=lambda s: (-s[0], s[1]))
                count, end = 0, -1
                for _, a, b in sorted(spans, key=lambda s: s[1:]):
                    count, end = (count + 1, b) if a >= end else (count, max(end, b))
                rows.append((name, best[0], best[1], count))
            out.append(rows)
        return out


_FOUND = "array<struct<license:string,containment:double,first_word:bigint,occurrences:bigint>>"


def scan_licenses(docs: DataFrame, templates=TEMPLATES + RELATIVES + WHOLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, containment, first_word, occurrences: a row per document and license found in it."""
    scanner = Scanner(templates)
    kind = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64()), ("occurrences", pa.int64())]))

    def run(texts):
        got = scanner.scan([t or b"" for t in texts])
        names = ("license", "containment", "first_word", "occurrences")
        return [pa.array([[dict(zip(names, x)) for x in rows] for rows in got], kind)]

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = map_texts(rows, "text", run, f"found {_FOUND}")
    return (found.select("doc_id", F.explode("found").alias("f"))
            .select("doc_id", "f.license", "f.containment", "f.first_word", "f.occurrences"))
