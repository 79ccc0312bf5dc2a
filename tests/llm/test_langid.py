"""Language identification: exact code lengths, frozen statistics, held-out rows."""

import math
import random
import zlib
from collections import Counter

import pandas as pd
import pyarrow.parquet as pq

from weftlens.llm import langid as L

DOCS = "/root/testdata/sf0.01/documents.parquet"


def slow_bits(train, text):
    """PPM, method C, orders 3 to 0, byte by byte."""
    counts = {}
    for t in train:
        b = L.PAD + t.lower().encode()
        for i in range(3, len(b)):
            for k in range(4):
                counts.setdefault(b[i - k:i], {}).setdefault(b[i], 0)
                counts[b[i - k:i]][b[i]] += 1
    b, out = L.PAD + text.lower().encode(), 0.0
    for i in range(3, len(b)):
        for k in (3, 2, 1, 0, -1):
            if k < 0:
                out += 8
                break
            c = counts.get(b[i - k:i])
            if not c:
                continue
            all_ = sum(c.values()) + len(c)
            if b[i] in c:
                out -= math.log2(c[b[i]] / all_)
                break
            out -= math.log2(len(c) / all_)
    return out


def trees(rows):
    got = pd.concat(L.gram_counts(iter([pd.DataFrame(rows, columns=["lang", "text"])])))
    return L.Trees(got)


def test_code_lengths_are_exact():
    rng = random.Random(1)
    text = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 80)))
    train = [("x", text("abc dé")) for _ in range(20)] + [("y", text("cdef gß")) for _ in range(20)]
    t = trees(train)
    tests = [text("abcdefg hézß漢") for _ in range(40)] + ["", "q"]
    got = t.lengths(tests)
    for i, x in enumerate(tests):
        for j, lang in enumerate(t.langs):
            assert abs(got[i, j] - slow_bits([s for la, s in train if la == lang], x)) < 1e-3 * (1 + len(x))
    t.square = None
    assert abs(t.lengths(tests) - got).max() < 1e-3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    out = L.identify(docs, L.fit(docs, ~L.held_out(docs["doc_id"]))).toPandas()
    raw = pq.read_table(DOCS, columns=["doc_id", "lang"]).to_pandas()
    assert (out["held_out"] == out["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    both = out.merge(raw, on="doc_id")
    both = both[both["held_out"] & both["lang"].notna()]
    assert (both["lang_pred"] == both["lang"]).mean() > 0.98 and out["score"].between(0, 1).all()


def test_labels_of_held_out_rows_are_never_learnt(spark):
    rows = [(i, f"abc abd abe {i}", "right" if zlib.crc32(str(i).encode()) % 3 != 1 else "wrong") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert L.fit(docs, ~L.held_out(docs["doc_id"])).langs == ["right"]


def test_the_sample_is_bounded_and_reaches_each_language(spark):
    rows = [(1, f"abc {i}", "a") for i in range(3000)] + [(None, f"xyz {i % 3}", "b") for i in range(3000)] + [(5, "long " * 900_000, "c"), (6, "short", "c")]
    got = L.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), L.F.lit(True), 100).collect()
    assert Counter(r.lang for r in got) == {"a": 100, "b": 3, "c": 1}


def test_unusual_rows(spark):
    docs = spark.createDataFrame([(1, "aaa bbb", "a"), (2, "ccc ddd", "c"), (3, None, "a"), (4, "", "c"), (5, "123 !?", None), (None, "aaa", None), (6, "ccc " * 100000, None), (6, "ccc", None), (6, "ccc", None)], "doc_id long, text string, lang string")
    t = L.fit(docs, L.F.lit(True))
    got = L.identify(docs.withColumn("score", L.F.lit("x")), t).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert len(got) == 9 and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3, 4, 5))
    assert by[None].lang_pred == "a" and by[6].lang_pred == "c" and by[None].held_out is False
    assert L.fit(docs.filter("lang is null"), L.F.lit(True)) is None
    assert {r.lang_pred for r in L.identify(docs, None).collect()} == {"und"}
    assert L.identify(docs.limit(0), t).collect() == []
