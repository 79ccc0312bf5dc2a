"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

1. Seeds are three words of a test item within four: in a row, or with the second or third of four words skipped, so that an
   edit every third word still leaves some. One pass over the whole texts looks them all up. One such seed is common, two of
   an item on diagonals at most DRIFT apart are rare (four words in a row are two seeds): where these occur, the stretch of
   words that the item would cover there is cut out: a passage. Passages are few and short; they are written.
2. A passage is joined to each item of its rare seeds, however many passages have them. Copies that keep no two seeds are not
   found.
3. Each such pair of passage and item is aligned word by word (Smith-Waterman: match 2, mismatch and gap -1). The score is
   the alignment's divided by 2 * words of the item; from MIN_SCORE on the pair is reported, so edited and reordered copies
   are found too. A pair whose common words can't reach MIN_SCORE, even if all of them matched, isn't aligned. The words
   read around a seed hold every alignment through it that reaches MIN_SCORE, so the score is that of the whole text.
   What lies left and right of a reported span is aligned again, so each of several copies in a row gives a row. Alignment
   takes memory linear in the words of both sides.

No step groups documents, so a passage that a third of them share costs no task more than its rows. Items are taken to the
workers in blocks of at most BLOCK_ITEMS items and about BLOCK_CHARS characters (a longer item is a block's only large one),
so the broadcast index has a bound at any number of items.

Defined results: null and empty texts and items give no row, nor do items with less than four words; repeated documents
give a row each; repeated items with the same id and text count once; of alignments with equal scores the one with more
matched words counts; null ids come back null; an empty table on either side gives no rows; other columns of docs and items
are not read by find and stay as they are in clean, whatever their names. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, gram_codes, known_words, member, packed, per_text, written

SEEDS, MIN_SCORE = ((0, 1, 2), (0, 1, 3), (0, 2, 3)), 0.5
LEAST_WORDS = 4
#: How far apart the diagonals of two seeds may be.
DRIFT = 8
#: Test items, and their characters, whose index is broadcast at once; more items take more passes.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000
#: One of score in an alignment's packed cells; the bits below count matched words.
ONE = 1 << 20


class Items:
    """Seeds of a block of test items, as arrays."""

    def __init__(self, rows: list[tuple[int, str]], min_score: float = MIN_SCORE):
        words = [(i, WORD.findall(t.lower())) for i, t in rows]
        words = [(i, w) for i, w in words if len(w) >= LEAST_WORDS]
        self.vocab: dict[str, int] = {}
        for _, w in words:
            for x in w:
                self.vocab.setdefault(x, len(self.vocab) + 1)
        self.names = [i for i, _ in words]
        self.ids = [np.array([self.vocab[x] for x in w], np.int64) for _, w in words]
        size = np.array([len(x) for x in self.ids], np.int64)
        self.least = min_score * 2 * size
        # gaps that an alignment of an item can have and still reach the least score
        self.room = np.maximum(0, (2 * size - self.least).astype(np.int64))
        found = [(gram_codes(ids, s), t) for t, ids in enumerate(self.ids) for s in SEEDS]
        code = np.concatenate([c for c, _ in found] or [np.zeros(0, np.int64)])
        t = np.concatenate([np.full(len(c), t) for c, t in found] or [np.zeros(0, np.int64)]).astype(np.int64)
        q = np.concatenate([np.arange(len(c)) for c, _ in found] or [np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(code, kind="stable")
        self.t, self.q = t[order], q[order]
        self.keys, self.first = np.unique(code[order], return_index=True)
        self.last = np.append(self.first[1:], len(code))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the seeds in a row of word ids, ascending, and their numbers among the keys."""
        at, key = [], []
        for s in SEEDS:
            codes = gram_codes(ids, s)
            p = member(codes, self.keys)
            at.append(p)
            key.append(np.searchsorted(self.keys, codes[p]))
        at, key = np.concatenate(at), np.concatenate(key)
        order = np.argsort(at, kind="stable")
        return at[order], key[order]

    def rare(self, places: np.ndarray, keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, diagonal, place) of the hits that have another one of their item near their diagonal; place ascends."""
        n = self.last[keys] - self.first[keys]
        at = np.repeat(self.first[keys] - np.cumsum(n) + n, n) + np.arange(n.sum())
        p, x, t = np.repeat(places, n), np.repeat(text, n), self.t[at]
        d = p - self.q[at]
        order = np.lexsort((d, t, x))
        p, x, t, d = p[order], x[order], t[order], d[order]
        near = (np.diff(d) <= DRIFT) & (np.diff(t) == 0) & (np.diff(x) == 0)
        kept = np.zeros(len(p), bool)
        kept[1:] |= near
        kept[:-1] |= near
        kept = np.nonzero(kept)[0]
        kept = kept[np.argsort(p[kept], kind="stable")]
        return x[kept], t[kept], d[kept], p[kept]

    def passages(self, text: str) -> list[tuple[list[int], list[int], list[int], list[int], list[int]]]:
        """(word ids, starts, ends, items, their diagonals) of each passage of a text."""
        at = [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]
        ids = [self.vocab.get(w, 0) for w, _, _ in at]
        places, keys = self.hits(np.array(ids, np.int64))
        _, ts, ds, ps = self.rare(places, keys, np.zeros(len(places), np.int64))
        spans: list[list] = []
        for t, d in zip(ts.tolist(), ds.tolist(), strict=True):
            now = [max(0, d - int(self.room[t])), min(len(ids), d + len(self.ids[t]) + int(self.room[t])), [t], [d]]
            while spans and now[0] <= spans[-1][1]:  # it may reach left over several
                a, b, items, diagonals = spans.pop()
                items += now[2]
                diagonals += now[3]
                now = [min(a, now[0]), max(b, now[1]), items, diagonals]
            spans.append(now)
        return [(ids[a:b], [s for _, s, _ in at[a:b]], [e for _, _, e in at[a:b]], items, [d - a for d in diagonals]) for a, b, items, diagonals in spans]

    def may_reach(self, t: int, b: np.ndarray) -> bool:
        """Whether the words that item t and b have in common could reach the item's least score."""
        words, n = np.unique(self.ids[t], return_counts=True)
        found, times = np.unique(b, return_counts=True)
        at = np.minimum(np.searchsorted(found, words), len(found) - 1)
        return 2 * int(np.minimum(n, times[at])[found[at] == words].sum()) >= self.least[t]

    def aligned(self, t: int, b: np.ndarray, diagonals: list[int]) -> list[tuple[int, int, int, int]]:
        """align() of item t with b, then with what lies left and right of each span, while the score reaches the least."""
        a = self.ids[t]
        out, todo = [], [(0, len(b))]
        while todo:
            lo, hi = todo.pop()
            if hi <= lo or not self.may_reach(t, b[lo:hi]):
                continue
            whole = next((d for d in diagonals if lo <= d and d + len(a) <= hi and (b[d:d + len(a)] == a).all()), None)
            top, matched, x, y = align(a, b[lo:hi]) if whole is None else (2 * len(a), len(a), whole - lo, whole - lo + len(a))
            if matched and top >= self.least[t]:
                out.append((top, matched, lo + x, lo + y))
                todo += [(lo, lo + x), (lo + y, hi)]
        return sorted(out, key=lambda r: r[2])

    def scores(self, ids: np.ndarray, t: np.ndarray, d: np.ndarray, memo: dict) -> list[tuple[int, int, int, int, int]]:
        """(item, score, matched, start, end) of a passage's alignments; start and end count its words."""
        order = np.lexsort((d, t))
        t, d, out = t[order], d[order], set()
        for one in np.split(np.arange(len(t)), np.nonzero(np.diff(t))[0] + 1):
            item, room = int(t[one[0]]), int(self.room[t[one[0]]])
            size = len(self.ids[item])
            for lo, hi in stretches(d[one].tolist(), size + 2 * room):
                a, b = max(0, lo - room), min(len(ids), hi + size + room)
                key = (item, ids[a:b].tobytes())
                if key not in memo:
                    if len(memo) > 20_000:
                        memo.clear()
                    memo[key] = self.aligned(item, ids[a:b], sorted({x - a for x in d[one].tolist() if lo <= x <= hi}))
                out |= {(item, top, matched, a + x, a + y) for top, matched, x, y in memo[key]}
        return sorted(out)


def _row(row: np.ndarray, gain: np.ndarray, steps: np.ndarray, edge: int, floor: bool) -> np.ndarray:
    """The next row of packed alignment cells: diagonal, up, then left."""
    new = np.empty_like(row)
    new[0] = edge
    np.maximum(row[:-1] + gain, row[1:] - ONE, out=new[1:])
    if floor:
        new[new < ONE] = 0
    new = np.maximum.accumulate(new + steps) - steps
    if floor:
        new[new < ONE] = 0
    return new


def _gain(x: int, b: np.ndarray) -> np.ndarray:
    return np.where(b == x, 2 * ONE + 1, -ONE) if x else np.full(len(b), -ONE)


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman of two word-id arrays: (score, matched words, start and end in b). Ids of 0 match nothing.

    A first pass keeps one row of cells and finds the end of the best alignment, a second one goes back from there."""
    steps, row = np.arange(len(b) + 1, dtype=np.int64) * ONE, np.zeros(len(b) + 1, np.int64)
    best, i, j = 0, 0, 0
    for k, x in enumerate(a.tolist(), 1):
        row = _row(row, _gain(x, b), steps, 0, True)
        top = int(row.max())
        if top > best:
            best, i, j = top, k, int(row.argmax())
    if not best:
        return 0, 0, 0, 0
    back, row = b[:j][::-1], -steps[:j + 1]
    for k, x in enumerate(a[:i][::-1].tolist(), 1):
        row = _row(row, _gain(x, back), steps[:j + 1], -k * ONE, False)
        if row.max() == best:
            return best // ONE, best % ONE, j - int(row.argmax()), j
    raise AssertionError("an alignment has a start")


def find(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, block: int = BLOCK_ITEMS) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) to (doc_id, item_id, score, matched, start, end)."""
    return _find(docs.select("doc_id", "text"), items, min_score, block, ["doc_id"])


def _find(docs: DataFrame, items: DataFrame, min_score: float, block: int, keep: list[str]) -> DataFrame:
    tests = items.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    rows, chars = tests.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-rows // block), -(-chars // BLOCK_CHARS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [_block(docs, tests.filter(part == k) if blocks > 1 else tests, min_score, keep) for k in range(blocks)])


def _block(docs: DataFrame, tests: DataFrame, min_score: float, keep: list[str]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in tests.collect()], min_score))  # a block of items

    def cut():
        items = held.value

        def run(texts: list[str | None]):
            texts = [t or "" for t in texts]
            ids, starts = known_words(texts, items.vocab)
            places, keys = items.hits(ids)
            some = np.unique(items.rare(places, keys, np.searchsorted(starts, places, side="right") - 1)[0])
            rows = [(r, *p) for r in some.tolist() for p in items.passages(texts[r])]
            return [r[0] for r in rows], [[r[k] for r in rows] for k in range(1, 6)]

        return run

    passages = written(per_text(docs, keep, cut, "ids array<long>, starts array<int>, ends array<int>, items array<int>, diagonals array<int>"))
    # a passage goes through as JSON in the place of a text
    out = passages.select(*keep, F.to_json(F.struct("ids", "starts", "ends", "items", "diagonals")).alias("text"))

    def score():
        items, memo = held.value, {}

        def run(passages: list[str]):
            rows = []
            for r, p in enumerate(map(json.loads, passages)):
                for t, top, matched, a, b in items.scores(np.array(p["ids"], np.int64), np.array(p["items"], np.int64), np.array(p["diagonals"], np.int64), memo):
                    rows.append((r, items.names[t], top / (2 * len(items.ids[t])), matched, p["starts"][a], p["ends"][b - 1]))
            return [r[0] for r in rows], [[r[k] for r in rows] for k in range(1, 6)]

        return run

    return per_text(out, keep, score, "item_id long, score double, matched long, start long, end long")


def stretches(diagonals: list[int], apart: int) -> list[tuple[int, int]]:
    """Sorted diagonals in runs whose gaps stay within `apart`."""
    out = [[diagonals[0], diagonals[0]]]
    for d in diagonals[1:]:
        if d - out[-1][1] > apart:
            out.append([d, d])
        out[-1][1] = d
    return [(a, b) for a, b in out]


def clean(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, block: int = BLOCK_ITEMS) -> DataFrame:
    """docs without the rows whose text holds a test item. Rows are told apart by doc_id and text."""
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.md5("text"))
    found = _find(docs.select("doc_id", "text", key.alias("_row")), items, min_score, block, ["_row"])
    hit = written(found.select(F.col("_row").alias("_hit")).distinct())
    side = F.broadcast(hit) if hit.count() <= 100_000 else hit
    return packed(docs, key.alias("_row")).join(side, F.col("_row") == F.col("_hit"), "left_anti").select("_doc.*")
