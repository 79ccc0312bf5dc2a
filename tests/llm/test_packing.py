"""Packing: bounds against all choices, batches within the budget."""

import itertools
import random

from weftlens.llm import packing as P

SCHEMA = "doc_id long, text string"


def cost(lengths, counts, tops):
    return sum((min(t for t in tops if t >= x) - x) * k for x, k in zip(lengths, counts, strict=True))


def test_bounds_have_the_least_padding():
    rng = random.Random(1)
    for _ in range(300):
        lengths = sorted(rng.sample(range(0, 60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 20) for _ in lengths]
        k = rng.randrange(1, 6)
        got = P.bounds(lengths, counts, k)
        best = min(cost(lengths, counts, (*c, lengths[-1])) for n in range(k) for c in itertools.combinations(lengths[:-1], n))
        assert len(got) <= k and got[-1] == lengths[-1] and cost(lengths, counts, got) == best


def test_batches(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 41, 300])) for i in range(2000)] + [(None, None), (3, "w " * 30000), (4, "a b"), (4, "a b")]
    got = P.pack(spark.createDataFrame(rows, SCHEMA), buckets=4, budget=1000).toPandas()
    assert len(got) == len(rows) and (got["padding"] == got["bucket_len"] - got["n_words"]).all() and (got["padding"] >= 0).all()
    for (_, _), x in got.groupby(["bucket", "batch"]):
        assert sorted(x["slot"]) == list(range(len(x))) and (x["bucket_len"].sum() <= 1000 or len(x) == 1 or x["bucket_len"].max() == 0)
    for _, x in got.groupby("bucket"):
        full = x.groupby("batch").size().sort_index()
        assert list(full.index) == list(range(len(full))) and full.iloc[:-1].nunique() <= 1
    lengths = got["n_words"].value_counts().sort_index()
    assert got["padding"].sum() == cost(list(lengths.index), list(lengths), P.bounds(list(lengths.index), list(lengths), 4))


def test_other_lengths_and_clashing_columns(spark):
    rows = [(i, "x", n, "b") for i, n in enumerate([3, 3, None, -5, 900, 20])] + [(2**53 + 1, "x", 7, "b"), (None, "x", 7, "b")]
    docs = spark.createDataFrame(rows, SCHEMA + ", n_tokens int, bucket string")
    got = {r.doc_id: r for r in P.pack(docs, buckets=3, budget=50, length="n_tokens").collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {0: 3, 1: 3, 2: 0, 3: 0, 4: 900, 5: 20, 2**53 + 1: 7, None: 7}
    assert [c for c, _ in P.pack(docs).dtypes] == ["doc_id", "n_words", "bucket", "bucket_len", "batch", "slot", "padding"]


def test_empty(spark):
    assert P.bounds([], []) == [] and P.pack(spark.createDataFrame([], SCHEMA)).collect() == []
