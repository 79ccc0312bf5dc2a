"""Toxicity severity by cumulative-link (proportional-odds) ordinal regression on sparse text features.

A word's features are hashes of the word and of its first four and five letters; a text's value of a feature is its
count divided by the words. One weight vector z = w.x is shared by all ordered thresholds: P(grade > k) = s(z - t_k),
t_0 < t_1 < ... The expected severity is the sum of these probabilities.

As z is a mean over words, a frozen model is one number a word: scoring is a lookup.

The labels are binary (toxic 0 or 1). Ordered grades come from counts, not from the regression: in folds, the words that the
toxic texts of the other folds hold more often than the clean ones (by MIN_Z standard errors) are a list, and a toxic text's
dose is the share of its words on the list that was made without it. Toxic texts above the median dose are grade 2, the
other ones grade 1. `fit_grades` takes any ordered grades.

Defined results: null text and text without a word have expected severity 0, grade 0, and are not toxic; without
labelled rows of both kinds every text has severity 0. An id labelled twice is toxic if one label says so; of several texts
of a labelled id the least enters the sample; equal doses take the lower grade. Repeated rows are scored alike, a null doc_id
comes back null, an empty table gives no rows; columns of docs other than doc_id and text are not read, whatever their names.
Texts are read whole.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, per_text

DIM = 1 << 18
SCALE = 30.0
#: The documented bound of the fit's sample: toxic and clean labelled rows, and their characters.
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_CHARS = 1500, 3000, 40_000_000
FOLDS = 5
DECAY = 1e-5
STEPS = 80
#: A feature has a weight if this many texts of the sample hold it, and its share of the texts of grade 0 and of the others
#: differs by so many standard errors.
MIN_TEXTS = 4
MIN_Z = 4.0
#: Characters of words that a worker remembers before it starts anew, and of the longest that it remembers.
CACHE_CHARS, LONG = 8_000_000, 100


def features(word: str) -> tuple[int, int, int]:
    b = word.encode("utf-8", "replace")
    return zlib.crc32(b) % DIM, zlib.crc32(b"4" + word[:4].encode("utf-8", "replace")) % DIM, zlib.crc32(b"5" + word[:5].encode("utf-8", "replace")) % DIM


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Weights by feature and ordered thresholds; score(texts) gives P(grade > k) for each k."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts, self.cache, self.held = weights.astype(np.float32), cuts, {}, 0

    def __reduce__(self):
        return Model, (self.weights, self.cuts)

    def word(self, word: str) -> float:
        v = float(sum(self.weights[f] for f in features(word)))
        if len(word) <= LONG:
            self.held += len(word)
            if self.held > CACHE_CHARS:
                self.cache.clear()
                self.held = len(word)
            self.cache[word] = v
        return v

    def above(self, texts: list[str]) -> np.ndarray:
        z, get, words_of = np.zeros(len(texts)), self.cache.get, WORD.findall
        some = np.zeros(len(texts), dtype=bool)
        for i, t in enumerate(texts):
            ws = words_of(t.lower())
            if ws:
                total = 0.0
                for w in ws:
                    v = get(w)
                    total += self.word(w) if v is None else v
                z[i], some[i] = SCALE * total / len(ws), True
        return _sigmoid(z[:, None] - self.cuts[None, :]) * some[:, None]


def telling(high: np.ndarray, total_high: int, low: np.ndarray, total_low: int) -> np.ndarray:
    """Difference of two shares of texts in standard errors; 0 where less than MIN_TEXTS texts count."""
    n1, n0 = max(total_high, 1), max(total_low, 1)
    p = (high + low) / (n1 + n0)
    z = (high / n1 - low / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    return np.where(high + low >= MIN_TEXTS, z, 0.0)


def ordered_grades(texts: list[str], toxic: np.ndarray, folds: int = FOLDS) -> np.ndarray:
    """Grades 0, 1, 2 of texts labelled 0 or 1, by cross-fitted doses."""
    ids: dict[str, int] = {}
    words = [np.array([ids.setdefault(w, len(ids)) for w in WORD.findall(t.lower())], np.int64) for t in texts]
    fold = np.array([zlib.crc32(t.encode("utf-8", "replace")) % folds for t in texts])
    kinds = [np.unique(w) for w in words]
    dose = np.zeros(len(texts))
    for k in range(folds):
        count = [np.bincount(np.concatenate([kinds[i] for i in np.nonzero((toxic == y) & (fold != k))[0]] or [np.zeros(0, np.int64)]), minlength=len(ids)) for y in (0, 1)]
        listed = telling(count[1], int(((toxic == 1) & (fold != k)).sum()), count[0], int(((toxic == 0) & (fold != k)).sum())) >= MIN_Z
        for i in np.nonzero((toxic == 1) & (fold == k))[0]:
            dose[i] = listed[words[i]].mean() if len(words[i]) else 0.0
    return toxic + ((toxic == 1) & (dose > np.median(dose[toxic == 1])))


def loss_and_gradient(rows, cols, vals, grades, share, w, cuts):
    """Mean negative log-likelihood of the grades under weights w and cuts, with its gradients."""
    z = np.bincount(rows, vals * w[cols], minlength=len(grades))
    edge = np.concatenate([[-50.0], cuts, [50.0]])
    hi, lo = _sigmoid(edge[grades + 1] - z), _sigmoid(edge[grades] - z)
    p = np.maximum(hi - lo, 1e-9)
    dh, dl = hi * (1 - hi) / p, lo * (1 - lo) / p
    g = np.bincount(cols, vals * ((dh - dl) * share)[rows], minlength=len(w))
    gc = np.array([dl[grades == j + 1] @ share[grades == j + 1] - dh[grades == j] @ share[grades == j] for j in range(len(cuts))])
    return -float(share @ np.log(p)), g, gc


def design(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of each distinct word's features."""
    rows, feats, vals = [], [], []
    memo: dict[str, tuple[int, int, int]] = {}
    for i, t in enumerate(texts):
        ws = WORD.findall(t.lower())
        for w, n in Counter(ws).items():
            f = memo.get(w) or memo.setdefault(w, features(w))
            rows += (i, i, i)
            feats += f
            vals += (n / len(ws),) * 3
    return np.array(rows, np.int64), np.array(feats, np.int64), SCALE * np.array(vals, float)


def fit_grades(texts: list[str], grades: np.ndarray, weight: np.ndarray | None = None, steps: int = STEPS, rate: float = 0.5, decay: float = DECAY) -> Model:
    """Full-batch Adam on the weighted likelihood of the ordered grades 0..K-1, over the telling features."""
    rows, feats, vals = design(texts)
    held = np.unique(rows * DIM + feats)
    high, of, n1 = grades[held // DIM] > 0, held % DIM, int((grades > 0).sum())
    keep = np.abs(telling(np.bincount(of[high], minlength=DIM), n1, np.bincount(of[~high], minlength=DIM), len(texts) - n1)) >= MIN_Z
    rows, feats, vals = rows[keep[feats]], feats[keep[feats]], vals[keep[feats]]
    used, cols = np.unique(feats, return_inverse=True)
    share = np.full(len(texts), 1 / len(texts)) if weight is None else weight / weight.sum()
    w, cuts = np.zeros(len(used)), np.arange(int(grades.max()), dtype=float) + 1
    m, v, mc, vc = np.zeros_like(w), np.zeros_like(w), np.zeros_like(cuts), np.zeros_like(cuts)
    for step in range(1, steps + 1):
        _, g, gc = loss_and_gradient(rows, cols, vals, grades, share, w, cuts)
        g = g + decay * w
        m, v, mc, vc = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mc + 0.1 * gc, 0.99 * vc + 0.01 * gc * gc
        a, b = 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-8)
        cuts = np.sort(cuts - 0.2 * (mc / a) / (np.sqrt(vc / b) + 1e-8))
    full = np.zeros(DIM)
    full[used] = w
    return Model(full, cuts)


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, chars: int = SAMPLE_CHARS) -> Model | None:
    """A model from labels(doc_id, toxic) of docs; None if one kind is missing. The sample has one row an id, lowest hashes first."""
    able = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    size = {r[0]: r[1] for r in able.groupBy("toxic").agg(F.count(F.lit(1))).collect()}  # two rows
    if len(size) < 2:
        return None
    hashed = F.xxhash64("doc_id", F.lit(12))
    ids = [able.filter(F.col("toxic") == k).orderBy(hashed, "doc_id").limit(n) for k, n in ((1, toxic_rows), (0, clean_rows))]
    ids = F.broadcast(ids[0].unionByName(ids[1]))  # at most toxic_rows + clean_rows rows
    texts = docs.select("doc_id", "text").filter(F.length("text") <= chars // 100)
    one = texts.join(ids, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    upto = F.sum(F.length("text")).over(Window.partitionBy("toxic").orderBy(hashed, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    got = one.withColumn("_c", upto).filter(F.col("_c") <= chars // 2).drop("_c").toPandas().sort_values("doc_id")
    y = got["toxic"].to_numpy(np.int64)
    if len(set(y.tolist())) < 2:
        return None
    texts = got["text"].tolist()
    weight = np.where(y == 1, size[1] / (y == 1).sum(), size[0] / (y == 0).sum())  # as in all labelled rows
    return fit_grades(texts, ordered_grades(texts, y), weight)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text) to (doc_id, severity, grade, toxic): expected grade, likeliest side of each threshold, grade > 0."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = held.value

        def run(texts: list[str | None]):
            above = model.above([t or "" for t in texts]) if model else np.zeros((len(texts), 1))
            grade = (above >= 0.5).sum(axis=1)
            return None, (above.sum(axis=1), grade, grade > 0)

        return run

    return per_text(docs, ["doc_id"], make, "severity double, grade int, toxic boolean")
