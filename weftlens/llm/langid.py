"""Language identification by prediction by partial matching (PPM).

For every language a variable-order byte context tree (contexts of 0 to 3 bytes) is counted on labelled rows and then
frozen. The code length of a text is the sum, over its bytes, of the exact PPM code: the longest context codes the byte
if it saw it there, else it codes an escape (method C: distinct successors / (total + distinct successors)) and the next
shorter context goes on, down to a uniform code over 256 bytes. The language with the shortest code wins; the score is
its share of the probability under equal priors.

With frozen statistics the code of a byte depends on four bytes only, so the trees are compiled to tables that NumPy
looks up for whole batches.

Defined results: null text, empty text and text without a letter give `und` with score 0; ties go to the language
that sorts first; without any labelled row every text is `und`. A null doc_id is not held out and comes back null. Repeated
rows count once in the sample and each get the same prediction; an empty table gives no rows; columns of docs other than
doc_id, text and lang are not read, whatever their names. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, per_text

UND = "und"
PAD = b"\n\n\n"
#: The documented bound of the training sample: labelled rows and characters of each language.
ROWS_PER_LANGUAGE, CHARS_PER_LANGUAGE = 1200, 4_000_000
#: Known byte pairs up to which four-byte windows are found in a square table (int32), else by binary search.
SQUARE = 4000


def text_bytes(text: str) -> np.ndarray:
    return np.frombuffer(PAD + text.lower().encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)


def _windows(b: np.ndarray) -> np.ndarray:
    """Four bytes ending at each byte after the padding, as one number."""
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


def gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, text) rows to (lang, gram, n): four-byte windows with their counts in this partition."""
    held: dict[str, dict[int, int]] = {}
    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            grams, n = np.unique(np.concatenate([_windows(text_bytes(t)) for t in texts]), return_counts=True)
            mine = held.setdefault(lang, {})
            for g, k in zip(grams.tolist(), n.tolist(), strict=True):
                mine[g] = mine.get(g, 0) + k
    for lang, mine in held.items():
        yield pd.DataFrame({"lang": lang, "gram": np.fromiter(mine.keys(), np.int64, len(mine)), "n": np.fromiter(mine.values(), np.int64, len(mine))})


def training_sample(docs: DataFrame, allowed: Column, rows: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """(lang, text): at most `rows` distinct texts of each language, or all where there are fewer."""
    able = docs.filter(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return bounded_rows(able.select("lang", F.md5("text").alias("key"), "text"), "lang", rows, CHARS_PER_LANGUAGE).select("lang", "text")


class Trees:
    """The context trees of all languages, compiled to code lengths in bits."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        k = len(self.langs)
        at = counts["lang"].map({x: i for i, x in enumerate(self.langs)}).to_numpy(np.int64)
        gram, n = counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)

        def table(keys_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(keys_of, return_inverse=True)
            out = np.zeros((len(keys), k))
            np.add.at(out, (where, at), n)
            return keys, out

        def code(keys: np.ndarray, c: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Bits of each symbol after its context, and contexts with the bits of their escapes."""
            contexts, where = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.zeros((len(contexts), k)), np.zeros((len(contexts), k))
            np.add.at(total, where, c)
            np.add.at(kinds, where, c > 0)
            all_ = np.maximum(total + kinds, 1)
            escape = np.where(kinds > 0, np.log2(all_ / np.maximum(kinds, 1)), 0.0)
            bits = np.where(c > 0, np.log2(all_[where] / np.maximum(c, 1)), escape[where] + shorter)
            return bits, contexts, escape

        keys0, c0 = table(gram & 0xFF)
        bits0, _, escape0 = code(keys0, c0, np.full((len(keys0), k), 8.0))
        self.bits0 = np.broadcast_to(escape0[0] + 8.0, (256, k)).copy()
        self.bits0[keys0] = bits0
        keys1, c1 = table(gram & 0xFFFF)
        bits1, contexts, escape1 = code(keys1, c1, self.bits0[keys1 & 0xFF])
        one = np.zeros((256, k))
        one[contexts] = escape1
        every = np.arange(65536)
        self.bits1 = (one[every >> 8] + self.bits0[every & 0xFF]).astype(np.float32)
        self.bits1[keys1] = bits1
        self.keys2, c2 = table(gram & 0xFFFFFF)
        bits2, contexts, escape2 = code(self.keys2, c2, self.bits1[self.keys2 & 0xFFFF])
        self.bits2 = bits2.astype(np.float32)
        self.escape2 = np.zeros((65536, k), np.float32)
        self.escape2[contexts] = escape2
        self.keys3, c3 = table(gram)
        bits3, self.contexts3, escape3 = code(self.keys3, c3, self._two(self.keys3 & 0xFFFFFF))
        self.bits3, self.escape3 = bits3.astype(np.float32), escape3.astype(np.float32)
        pairs = np.unique(np.concatenate([self.keys3 >> 16, self.keys3 & 0xFFFF]))
        self.pair = self.square = None
        if len(pairs) <= SQUARE:
            self.pair = np.zeros(65536, np.int32)
            self.pair[pairs] = np.arange(1, len(pairs) + 1)
            self.square = np.full((len(pairs) + 1) ** 2, -1, np.int32)
            self.square[self.pair[self.keys3 >> 16] * (len(pairs) + 1) + self.pair[self.keys3 & 0xFFFF]] = np.arange(len(self.keys3))
            self.side = len(pairs) + 1

    def _two(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the third byte after two."""
        i = np.minimum(np.searchsorted(self.keys2, grams), len(self.keys2) - 1)
        seen = self.keys2[i] == grams
        return np.where(seen[:, None], self.bits2[i], self.escape2[grams >> 8] + self.bits1[grams & 0xFFFF])

    def bits(self, windows: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each window of four, by language."""
        if self.square is not None:
            i = self.square[self.pair[windows >> 16] * self.side + self.pair[windows & 0xFFFF]]
            seen = i >= 0
        else:
            i = np.minimum(np.searchsorted(self.keys3, windows), len(self.keys3) - 1)
            seen = self.keys3[i] == windows
        out = self.bits3[i]
        rest = np.nonzero(~seen)[0]
        if len(rest):
            w = windows[rest].astype(np.int64)
            j = np.minimum(np.searchsorted(self.contexts3, w >> 8), len(self.contexts3) - 1)
            met = self.contexts3[j] == w >> 8
            out[rest] = np.where(met[:, None], self.escape3[j], 0) + self._two(w & 0xFFFFFF)
        return out

    def lengths(self, texts: list[str], chunk: int = 1 << 19) -> np.ndarray:
        """Code length in bits of each whole text, by language."""
        out = np.zeros((len(texts), len(self.langs)))
        held, rows, size = [], [], 0

        def flush() -> None:
            nonlocal held, rows, size
            if held:
                w = np.concatenate(held)
                starts = np.cumsum([0, *map(len, held)])[:-1]
                np.add.at(out, rows, np.add.reduceat(self.bits(w), starts, axis=0, dtype=np.float64))
            held, rows, size = [], [], 0

        for r, t in enumerate(texts):
            w = _windows(text_bytes(t))
            for s in range(0, len(w), chunk):
                held.append(w[s:s + chunk])
                rows.append(r)
                size += len(held[-1])
                if size >= chunk:
                    flush()
        flush()
        return out


def fit(docs: DataFrame, allowed: Column, rows: int = ROWS_PER_LANGUAGE) -> Trees | None:
    """Trees from the allowed rows of docs(doc_id, text, lang); None if there are none."""
    sample = training_sample(docs, allowed, rows)
    counts = sample.mapInPandas(gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counts.toPandas()  # windows of a bounded sample
    return Trees(got) if len(got) else None


def identify(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """docs(doc_id, text) to (doc_id, held_out, lang_pred, score); held_out: crc32 of the id's text mod 3 is 1."""
    model = docs.sparkSession.sparkContext.broadcast(trees)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def make():
        trees = model.value

        def predict(texts: list[str | None]):
            lang, score = np.full(len(texts), UND, dtype=object), np.zeros(len(texts))
            ok = [i for i, t in enumerate(texts) if t is not None]
            if trees is not None and ok:
                bits = trees.lengths([texts[i] for i in ok])
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(ok)), best]
                lang[ok] = np.array(trees.langs, dtype=object)[best]
                score[ok] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            return None, (lang, score)

        return predict

    out = per_text(docs.select("doc_id", F.when(lettered, F.col("text")).alias("text")), ["doc_id"], make, "lang_pred string, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1
