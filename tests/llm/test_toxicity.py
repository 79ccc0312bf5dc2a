"""Toxicity: the ordinal fit, held-out rows, unusual rows."""

import math
import random

import numpy as np
import pyarrow.parquet as pq

from weftlens.llm import toxicity as X


def made(n, rng):
    texts, grades = [], []
    for _ in range(n):
        g = rng.choice([0, 0, 0, 1, 2])
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        for i in rng.sample(range(60), (0, 6, 16)[g]):
            words[i] = rng.choice(["vile", "nasty", "grim"])
        texts.append(" ".join(words))
        grades.append(g)
    return texts, np.array(grades)


def test_ordered_grades_share_their_weights():
    rng = random.Random(1)
    texts, grades = made(900, rng)
    model = X.fit_grades(texts, grades)
    test, want = made(300, rng)
    above = model.above(test)
    assert above.shape == (300, 2) and (above[:, 0] >= above[:, 1]).all() and model.cuts[0] < model.cuts[1]
    assert ((above >= 0.5).sum(axis=1) == want).mean() > 0.95
    severity = above.sum(axis=1)
    assert severity[want == 0].mean() < severity[want == 1].mean() < severity[want == 2].mean()


def test_likelihood_and_gradient_against_plain_python():
    rng = np.random.default_rng(3)
    n, k, grades = 40, 6, np.array([0, 1, 2, 2] * 10)
    dense = rng.random((n, k)) * (rng.random((n, k)) < 0.6)
    rows, cols = np.nonzero(dense)
    share, w, cuts = rng.random(n), rng.normal(size=k), np.array([-0.3, 1.1])
    share /= share.sum()
    s = lambda x: 1 / (1 + math.exp(-x))

    def loss(w, cuts):
        out = 0.0
        for i in range(n):
            z = sum(dense[i, j] * w[j] for j in range(k))
            above = [1.0, *(s(z - t) for t in cuts), 0.0]
            out -= share[i] * math.log(above[grades[i]] - above[grades[i] + 1])
        return out

    got, g, gc = X.loss_and_gradient(rows, cols, dense[rows, cols], grades, share, w, cuts)
    assert abs(got - loss(w, cuts)) < 1e-9
    step = lambda v, j: np.where(np.arange(len(v)) == j, 1e-6, 0)
    for j in range(k):
        assert abs(g[j] - (loss(w + step(w, j), cuts) - loss(w - step(w, j), cuts)) / 2e-6) < 1e-6
    for j in range(2):
        assert abs(gc[j] - (loss(w, cuts + step(cuts, j)) - loss(w, cuts - step(cuts, j))) / 2e-6) < 1e-6


def test_scores_are_those_of_the_formula(spark):
    texts, grades = made(200, random.Random(5))
    model = X.fit_grades(texts, grades, steps=30)
    got = {r.doc_id: r for r in X.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        words = t.split()
        z = X.SCALE * sum(model.weights[f] for w in words for f in X.features(w)) / len(words)
        above = [1 / (1 + math.exp(c - z)) for c in model.cuts]
        assert abs(got[i].severity - sum(above)) < 1e-4 and got[i].grade == sum(a >= 0.5 for a in above)


def test_grades_follow_the_dose():
    texts, grades = made(900, random.Random(7))
    got = X.ordered_grades(texts, (grades > 0).astype(int))
    assert (got == grades).mean() > 0.95 and ((got > 0) == (grades > 0)).all()


def test_the_sample_is_bounded_under_repeated_ids(spark):
    docs = spark.createDataFrame([(1, f"vile nasty word {i}") for i in range(3000)] + [(i, "plain good word") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 50 + [(1, 0)] * 5 + [(i, 0) for i in range(2, 60)], "doc_id long, toxic int")
    seen = []
    real = X.fit_grades
    X.fit_grades = lambda texts, *a: seen.append(len(texts)) or real(texts, *a)
    try:
        assert X.fit(docs, labels, toxic_rows=10, clean_rows=20) is not None
    finally:
        X.fit_grades = real
    assert seen == [21]  # id 1 once, and 20 of the others


def test_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    test = X.F.pmod(X.F.xxhash64("doc_id", X.F.lit(99)), X.F.lit(10)) < 3
    model = X.fit(docs, labels.filter(~test))
    got = X.score(docs.filter(test), model).toPandas().merge(pq.read_table(f"{d}/labels.parquet").to_pandas(), on="doc_id", suffixes=("", "_y"))
    assert got["toxic"][got["toxic_y"] == 1].mean() > 0.8 and got["toxic"][got["toxic_y"] == 0].mean() < 0.01


def test_unusual_rows(spark):
    rng = random.Random(2)
    texts, grades = made(200, rng)
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g > 0)) for i, g in enumerate(grades)] + [(None, 1), (3, None), (4, 7)], "doc_id long, toxic int")
    model = X.fit(docs, labels)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, " ..", "c"), (None, "vile nasty grim", "d"), (5, "vile " * 200000, "e"), (5, "vile " * 200000, "e")], "doc_id long, text string, severity string")
    got = X.score(odd, model).collect()
    assert len(got) == 6 and all(r.severity == 0 and r.grade == 0 and not r.toxic for r in got if r.doc_id in (1, 2, 3))
    assert all(r.toxic for r in got if r.doc_id in (None, 5))
    assert X.fit(docs, labels.filter("toxic = 1")) is None and {r.severity for r in X.score(docs, None).collect()} == {0.0}
    assert X.score(docs.limit(0), model).collect() == []
    assert X.fit(docs.limit(0), labels) is None and X.fit(docs, labels.limit(0)) is None
