"""The pipeline's rows against plain versions of its stages: SQL, all pairs of bags, alignments of all pairs, and counting."""

import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from weftlens.llm import decontam as D
from weftlens.llm import neardup as N
from weftlens.llm import packing as P
from weftlens.llm import quality as Q
from weftlens.llm import secrets as S

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("ra", "lin", "to", "nes")]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.randrange(15, 40)))) for i in range(6)]
    docs = []
    for i in range(150):
        words = say(rng.randrange(30, 160))
        if i % 9 == 0:
            words[5:5] = items[i % 6][1].split()
        if i % 7 == 0:
            words[3:3] = ["password=", "aB3xY9kQ2mZ7"]
        if i % 11 == 0:
            words = [w + "#$%" for w in words]
        docs.append([i, " ".join(words), rng.choice(["en", "de", None]), rng.choice(["a", "b"])])
    for i in range(150, 190):  # copies, some with a word edited
        words = docs[rng.randrange(150)][1].split()
        if i % 2:
            words[len(words) // 2] = "edited"
        docs.append([i, " ".join(words), "en", "a"])
    docs += [[190, None, None, None], [191, "", "en", "a"], [None, docs[1][1] + " more", "en", "b"]]
    return [tuple([*d, len(d[1] or "")]) for d in docs], items


def plain(docs, items):
    con = duckdb.connect()
    frame = pd.DataFrame([(k, d[1], d[2], d[3]) for k, d in enumerate(docs)], columns=["doc_id", "text", "lang", "source"])
    con.register("documents", frame)
    keep = {r[0] for r in con.execute(f"SELECT doc_id FROM ({Q.oracle_sql()}) WHERE kept").fetchall()}
    rows = [d for k, d in enumerate(docs) if k in keep]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    bags = [N.bag(d[1]) for d in rows]
    for a, b in itertools.combinations(range(len(rows)), 2):
        if N.similarity(bags[a], bags[b]) >= N.SIMILARITY:
            up[root(a)] = root(b)
    groups = {}
    for k, d in enumerate(rows):
        groups.setdefault(root(k), []).append(d)
    rows = [min(g, key=lambda d: (d[0] is None, d[0])) for g in groups.values()]

    def clean(text):
        for _, item in items:
            ids = {}
            a = np.array([ids.setdefault(w, len(ids) + 1) for w in item.split()])
            b = np.array([ids.get(w, 0) for w in D.WORD.findall(text.lower())])
            if len(b) and D.align(a, b)[0] >= D.MIN_SCORE * 2 * len(a):
                return False
        return True

    rows = [d for d in rows if clean(d[1])]
    tokens = S.encoding(S.load_ranks(S.VOCABULARY)).encode_ordinary
    return {d[0]: len(re.findall(r"[^\x20\x09-\x0D]+", S.redacted(d[1], S._spans(d[1], tokens)[1], "[SECRET]"))) for d in rows}


def test_rows_are_those_of_the_plain_stages(spark, tables, tmp_path):
    docs, items = tables
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = pipeline.run(spark, str(tmp_path)).toPandas()
    want = plain(docs, items)
    assert 60 < len(want) < 150
    assert {None if pd.isna(i) else int(i): n for i, n in zip(got["doc_id"], got["n_words"], strict=True)} == want and len(got) == len(want)
    lengths = sorted(Counter(want.values()).items())
    tops = P.bounds([x for x, _ in lengths], [k for _, k in lengths])
    assert got["padding"].sum() == sum(k * (min(t for t in tops if t >= x) - x) for x, k in lengths)
    for _, x in got.groupby("bucket"):
        assert all(sorted(y["slot"]) == list(range(len(y))) for _, y in x.groupby("batch"))
