"""License scans: winnowed fingerprints of templates in an inverted index pick candidates, banded alignment measures them.

Templates are of three kinds: `text`, the whole licenses in license_texts; `notice`, the headers that licenses ask for; and
`name`, short lines such as "Licensed under CC BY 4.0", made by rule from names, versions and frames.

A template is cut into grams of words, of which winnowing keeps the least of each window: five words and windows of eight in a
text, three and three in a notice, so that thirteen words in a row of a text, or six of a notice, share a fingerprint with it.
A name has as fingerprints all its two-word grams that hold a telling word. The inverted index fingerprint -> (template,
position) is small and is broadcast. All grams of a whole text are looked up in it; hits of a template on nearby diagonals make
a candidate, which a banded local alignment on words scores. A match is reported when at least MIN_COVERAGE of the template's
words are matched and its telling words agree:

  Telling words are the family names (GNU, Lesser, Affero, BSD, MIT, NC, SA, ...) and the numbers but 0. Of a name the telling
  words of the stretch, and those that follow it directly, must be the template's, in its order. A notice's stretch, and the
  stretch of a text's first HEAD words, may hold no telling word that the template lacks.

Of overlapping matches the one with more matched less unmatched words stays, so BSD-2 and BSD-3, or a name within a text, are
told apart. coverage is the matched share of the template's words, start and end the matched span.

Defined results: null and empty texts have no match; ties go to the earlier template in the list; a text without a match
has no row; repeated rows get their rows each; a null doc_id comes back null; an empty table gives no rows; columns of docs
other than doc_id and text are not read, whatever their names. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import product
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from .common import WORD, gram_codes, known_words, member, per_text

BAND, MIN_COVERAGE, HEAD = 8, 0.8, 40
#: Words of a gram and grams of a window, by kind.
GRAMS = {"text": (5, 8), "notice": (3, 3), "name": (2, 1)}
FAMILY = frozenset("cc cc0 commons attribution noncommercial sharealike noderivatives noderivs gnu lesser library affero general gpl lgpl agpl mit bsd clause apache isc mozilla mpl artistic unlicense zlib boost eclipse".split())
#: Telling only beside `cc` or `commons`.
MARKS = frozenset("by nc nd sa non commercial share alike derivatives derivs no".split())
TEXTS = Path(__file__).with_name("license_texts")

NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means",
}
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
GNU_VERSIONS = {"": ("gpl", ("2", "3")), "Lesser ": ("lgpl", ("2.1", "3")), "Affero ": ("agpl", ("3",))}
NAMES = {
    "mit": ["MIT License"], "isc": ["ISC License"], "zlib": ["zlib License"], "unlicense": ["Unlicense"], "bsd": ["BSD License"],
    "bsd-2-clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"], "bsd-3-clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"], "mpl-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"], "cc0-1.0": ["CC0 1.0", "CC0"],
}
FRAMES = ("Licensed under the", "Released under the", "Distributed under the terms of the")
CC_KINDS, CC_VERSIONS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"), ("1.0", "2.0", "2.5", "3.0", "4.0")
CC_WORDS = {"by": "Attribution", "nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}


def templates() -> list[tuple[str, str, str]]:
    """(license, kind, text) of all templates."""
    out = [(p.stem, "text", p.read_text("utf-8")) for p in sorted(TEXTS.glob("*.txt"))]
    out += [(k, "notice", t) for k, t in NOTICES.items()]
    names = {k: list(v) for k, v in NAMES.items()}
    for word, (family, versions) in GNU_VERSIONS.items():
        for v in versions:
            out.append((f"{family}-{v if '.' in v else v + '.0'}", "notice", GNU.format(word, v)))
            names[out[-1][0]] = [f"GNU {word}General Public License, version {v}", f"GNU {word}General Public License v{v}", f"{family.upper()} version {v}", f"{family.upper()}-{v}"]
        names[family] = [f"GNU {word}General Public License"]
    out += [(k, "name", f"{frame} {n}") for k, v in names.items() for n, frame in product(v, FRAMES)]
    for kind, v in product(CC_KINDS, CC_VERSIONS):
        long = "-".join(CC_WORDS[x] for x in kind.split("-"))
        for n, frame in product((f"CC {kind.upper()} {v}", f"Creative Commons {long} {v}"), FRAMES):
            out.append((f"cc-{kind}-{v}", "name", f"{frame.removesuffix(' the') if n.startswith('CC') else frame + ' '}{' ' if n.startswith('CC') else ''}{n}"))
    return out


def telling(words: list[str]) -> list[str]:
    """The telling words of a stretch, in order."""
    cc = any(w in ("cc", "commons") for w in words)
    out = []
    for w in words:
        number = re.fullmatch(r"v?(\d+)", w)
        if number and int(number[1]):
            out.append(number[1])
        elif w in FAMILY or (cc and w in MARKS):
            out.append(w)
    return out


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        self.names, self.kinds = [n for n, _, _ in rows], [k for _, k, _ in rows]
        words = [WORD.findall(t.lower()) for _, _, t in rows]
        if any(len(w) < GRAMS[k][0] for w, k in zip(words, self.kinds, strict=True)):
            raise ValueError("a template has less words than its grams")
        self.vocab: dict[str, int] = {}
        for w in words:
            for x in w:
                self.vocab.setdefault(x, len(self.vocab) + 1)
        self.ids = [np.array([self.vocab[x] for x in w], np.int64) for w in words]
        # narrower than a short template, so that copies in a row stay apart; wider for long texts
        self.bands = [max(min(BAND, len(w) // 3), 1, len(w) // 40) for w in words]
        self.told = [telling(w[:HEAD] if k == "text" else w) for w, k in zip(words, self.kinds, strict=True)]
        self.bags = [np.unique(ids, return_counts=True) for ids in self.ids]
        self.where: dict[str, dict[int, list[tuple[int, int]]]] = {k: {} for k in GRAMS}
        for t, (ids, kind) in enumerate(zip(self.ids, self.kinds, strict=True)):
            n, window = GRAMS[kind]
            codes = gram_codes(ids, tuple(range(n))).tolist()
            for p in winnow(codes, window):
                if kind != "name" or any(w in FAMILY for w in words[t][p:p + n]):
                    self.where[kind].setdefault(codes[p], []).append((t, p))
        self.keys = {k: np.array(sorted(at), dtype=np.int64) for k, at in self.where.items()}

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, str]]:
        """(place, code, kind) of every fingerprint in a row of word ids, by place."""
        out = []
        for kind, (n, _) in GRAMS.items():
            codes = gram_codes(ids, tuple(range(n)))
            out += [(p, int(codes[p]), kind) for p in member(codes, self.keys[kind]).tolist()]
        return sorted(out)

    def candidates(self, ids: np.ndarray) -> dict[int, list[list[int]]]:
        """template -> [least diagonal, greatest, last place, first place, hits] of each run of hits, most hits first."""
        open_: dict[int, list[list[int]]] = {}
        for p, code, kind in self.hits(ids):
            for t, q in self.where[kind][code]:
                d, band = p - q, self.bands[t]
                for c in reversed(open_.setdefault(t, [])):
                    if c[2] < p - len(self.ids[t]) - band:
                        open_[t].append([d, d, p, p, 1])
                        break
                    if abs(d - c[0]) <= band and abs(d - c[1]) <= band:
                        c[0], c[1], c[2], c[4] = min(d, c[0]), max(d, c[1]), p, c[4] + 1
                        break
                else:
                    open_[t].append([d, d, p, p, 1])
        return {t: sorted(runs, key=lambda c: -c[4]) for t, runs in open_.items()}

    def may_match(self, t: int, b: np.ndarray) -> bool:
        """Whether b has enough of the template's words, in any order."""
        words, n = self.bags[t]
        return np.minimum(n, np.bincount(b, minlength=len(self.vocab) + 1)[words]).sum() >= MIN_COVERAGE * len(self.ids[t])

    def agrees(self, t: int, pairs: list[tuple[int, int]], at: list[tuple[str, int, int]], text: str) -> bool:
        """Whether the telling words of a stretch are those of the template."""
        a, b = pairs[0][1], pairs[-1][1] + 1
        if self.kinds[t] == "name":
            while b < len(at) and re.fullmatch(r"[ \t_,/().-]*", gap := text[at[b - 1][2]:at[b][1]]) and not re.search(r"[.] ", gap) and telling(["cc", at[b][0]])[1:]:
                b += 1
            own = telling([w for w, _, _ in at[a:b]])
            return own == self.told[t]
        if self.kinds[t] == "text":
            head = [j for i, j in pairs if i < HEAD]
            if not head:
                return True
            a, b = head[0], head[-1] + 1
        return set(telling([w for w, _, _ in at[a:b]])) <= set(self.told[t])

    def matches(self, text: str) -> list[tuple[str, str, float, int, int]]:
        """(license, kind, coverage, start, end) of each match in a text."""
        at = [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]
        ids = np.array([self.vocab.get(w, 0) for w, _, _ in at], np.int64)
        found = []
        for t, runs in self.candidates(ids).items():
            size = len(self.ids[t])
            spans: list[tuple[int, int]] = []
            for lo, hi, last, first, _ in runs:
                if any(a <= first and last < b for a, b in spans[:4]) or not self.may_match(t, ids[max(0, lo - self.bands[t]):hi + self.bands[t] + size]):
                    continue  # hits within a span of the same template can only give a match that overlaps it
                pairs = banded(self.ids[t], ids, lo - self.bands[t], hi + self.bands[t])
                if len(pairs) >= MIN_COVERAGE * size and self.agrees(t, pairs, at, text):
                    spans.append((pairs[0][1], pairs[-1][1] + 1))
                    found.append((size - 2 * len(pairs), t, *spans[-1], len(pairs)))
        kept: list[tuple[int, int, int, int]] = []  # by place, without overlaps
        for _, t, a, b, n in sorted(set(found)):
            i = bisect_left(kept, (a,))
            if not (i and kept[i - 1][1] > a) and not (i < len(kept) and kept[i][0] < b):
                kept.insert(i, (a, b, t, n))
        return [(self.names[t], self.kinds[t], n / len(self.ids[t]), at[a][1], at[b - 1][2]) for a, b, t, n in kept]


def winnow(codes: list[int], window: int) -> list[int]:
    """Positions of the least code (the last of equals) of every window."""
    out: list[int] = []
    for i in range(max(1, len(codes) - window + 1)):
        p = min(range(i, min(i + window, len(codes))), key=lambda j: (codes[j], -j))
        if not out or out[-1] != p:
            out.append(p)
    return out


def banded(a: np.ndarray, b: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
    """Matched places (in a, in b) of the best local alignment whose diagonals place b - place a are in lo..hi.

    Match 2, mismatch and gap -1; the table has a row a word of a and a column a diagonal. Ids of 0 match nothing."""
    m, width = len(a), hi - lo + 1
    padded = np.zeros(m + width, np.int64)  # padded[x] is b[x + lo]
    x0, x1 = max(0, -lo), min(len(padded), len(b) - lo)
    if x1 > x0:
        padded[x0:x1] = b[x0 + lo:x1 + lo]
    steps = np.arange(width, dtype=np.int32)
    h = np.zeros((m + 1, width + 1), np.int32)
    for i in range(m):
        same = (padded[i:i + width] == a[i]) & (padded[i:i + width] != 0)
        row = np.maximum(np.maximum(h[i, :-1] + np.where(same, 2, -1), h[i, 1:] - 1), 0)
        h[i + 1, :-1] = np.maximum.accumulate(row + steps) - steps
    i, k = divmod(int(h.argmax()), width + 1)
    pairs = []
    while i and h[i, k] > 0:
        j = i - 1 + k + lo  # the cell of a[i - 1] and b[j]
        same = 0 <= j < len(b) and a[i - 1] == b[j] != 0
        if h[i, k] == h[i - 1, k] + (2 if same else -1):
            if same:
                pairs.append((i - 1, j))
            i -= 1
        elif h[i, k] == h[i - 1, k + 1] - 1:
            i, k = i - 1, k + 1
        else:
            k -= 1
    return pairs[::-1]


def scan(docs: DataFrame, rows: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """docs(doc_id, text) to (doc_id, license, coverage, start, end, kind), a row for each match."""
    held = docs.sparkSession.sparkContext.broadcast(Index(templates() if rows is None else rows))

    def make():
        index = held.value

        def run(texts: list[str | None]):
            texts = [t or "" for t in texts]
            ids, starts = known_words(texts, index.vocab)
            hits = np.concatenate([member(gram_codes(ids, tuple(range(n))), index.keys[k]) for k, (n, _) in GRAMS.items()])
            some = np.unique(np.searchsorted(starts, hits, side="right") - 1)
            rows = [(r, *m) for r in some.tolist() for m in index.matches(texts[r])]
            return [r[0] for r in rows], [[r[k] for r in rows] for k in (1, 3, 4, 5, 2)]

        return run

    return per_text(docs, ["doc_id"], make, "license string, coverage double, start long, end long, kind string")
