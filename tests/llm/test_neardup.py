"""Near duplicates against a comparison of all pairs, and the unusual cases."""

import itertools
import random

import numpy as np
import pytest

from weftlens.llm import neardup as N

SCHEMA = "doc_id long, text string"


def brute(rows):
    """Components of all pairs at SIMILARITY or more, as {doc_id: least doc_id}."""
    bags = {i: N.bag(t) for i, t in rows if t and N.WORD.search(t)}
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(bags, 2):
        if N.similarity(bags[a], bags[b]) >= N.SIMILARITY:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {i: root(i) for i in up}


def edited(words, edits, rng):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(900)]
    out = []
    for _ in range(40):  # groups around a text; some copies are only alike to other copies
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 240))]
        out += [edited(base, rng.randrange(0, 9), rng) for _ in range(rng.randrange(1, 12))]
    chain = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(30):  # each near the one before
        chain = edited(chain, 1, rng).split()
        out.append(" ".join(chain))
    out += [out[0]] * 5 + ["a b c d e f g h i j " * 40, "a b c d e f g h i j " * 44]
    rng.shuffle(out)
    return list(enumerate(out))


def found(spark, rows):
    return {r.doc_id: r for r in N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_groups_are_those_of_all_pairs(spark, rows):
    want, got = brute(rows), found(spark, rows)
    assert {i: r.class_id for i, r in got.items()} == want
    assert sum(r.kept for r in got.values()) == len(set(want.values()))
    sizes = {i: list(want.values()).count(i) for i in set(want.values())}
    assert all(r.class_size == sizes[r.class_id] for r in got.values())


def test_a_hot_group_whose_copies_are_alike_to_few_of_it(spark):
    rng = random.Random(9)
    base = [f"b{rng.randrange(300)}" for _ in range(150)]
    rows = list(enumerate([edited(base, rng.randrange(2, 8), rng) for _ in range(250)]))
    assert {i: r.class_id for i, r in found(spark, rows).items()} == brute(rows)


def test_candidates_of_a_hot_group_grow_with_it_not_with_its_square(spark):
    """Copies of a 300-word text with six words edited: about 0.67 alike, thus all open and none linked."""
    rng = random.Random(4)
    base = [f"b{rng.randrange(10**6)}" for _ in range(300)]
    made = {}
    for n in (200, 800):
        texts = [edited(base, 6, rng) for _ in range(n)]
        keys = [i.to_bytes(24, "big") for i in range(n)]
        open_ = spark.createDataFrame([(bytearray(k), 296, bytearray(k)) for k in keys], "key binary, n long, comp binary")
        held = spark.createDataFrame([(bytearray(k), t) for k, t in zip(keys, texts, strict=True)], "key binary, text string")
        made[n] = N.prefix_pairs(open_, held).count()
    assert made[200] <= 200 and made[800] <= 800


def test_parities_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        ids = np.unique(rng.integers(0, 2**60, 200).astype(np.uint64))
        a, b = (rng.integers(0, 3, len(ids)) * (rng.random(len(ids)) < 0.9) for _ in range(2))
        bits = [N.parity(ids[w > 0], w[w > 0]).view(np.uint64) for w in (a, b)]
        assert sum(int(x).bit_count() for x in bits[0] ^ bits[1]) <= np.abs(a - b).sum()


def test_prefix_filter_keeps_every_pair(spark):
    rng = random.Random(3)
    base = [f"b{rng.randrange(40)}" for _ in range(120)]
    texts = [edited(base, rng.randrange(0, 6), rng) for _ in range(60)]
    keys = [bytes([0] * 23 + [i]) for i in range(len(texts))]
    n = [int(N.bag(t)[1].sum()) for t in texts]
    open_ = spark.createDataFrame([(bytearray(k), m, bytearray(k)) for k, m in zip(keys, n, strict=True)], "key binary, n long, comp binary")
    held = spark.createDataFrame([(bytearray(k), t) for k, t in zip(keys, texts, strict=True)], "key binary, text string")
    got = {(bytes(r.a), bytes(r.b)) for r in N.prefix_pairs(open_, held).collect()}
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(zip(keys, texts, strict=True), 2) if N.similarity(N.bag(x), N.bag(y)) >= N.SIMILARITY}
    assert want and want <= got


def test_signatures_estimate_the_weighted_similarity():
    rng = np.random.default_rng(1)
    for trial in range(3):
        ids = np.unique(rng.integers(0, 2**52, 120).astype(np.uint64))
        a, b = rng.integers(0, 9, len(ids)), rng.integers(0, 9, len(ids))
        regs = []
        for salt in range(8):
            key = N.mix(ids + np.uint64(salt + 100 * trial)) >> np.uint64(12)
            one = [N.signatures(np.zeros(int((w > 0).sum()), np.int64), key[w > 0], w[w > 0], 1)[0] for w in (a, b)]
            regs.append((one[0] == one[1]).mean())
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs(np.mean(regs) - want) < 4 * np.sqrt(want * (1 - want) / (8 * N.REGISTERS))


def test_unusual_rows(spark):
    rows = [(1, None), (2, None), (3, ""), (4, " .,! "), (None, "one two three four five six"), (5, "one two three four five six"), (5, "one two three four five six"),
            (6, "one two"), (7, "One, two"), (8, "x " * 30000), (9, "x " * 30000)]
    out = N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert [by[i][0].class_id for i in (1, 2, 3, 4)] == [1, 2, 3, 4] and all(by[i][0].kept for i in (1, 2, 3, 4))
    assert by[None][0].class_id == 5 and not by[None][0].kept and all(r.class_size == 3 for r in by[5])
    assert by[7][0].class_id == 6 and by[9][0].class_id == 8


def test_empty_tables_and_extra_columns(spark):
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert N.deduplicated(spark.createDataFrame([], SCHEMA)).collect() == []
    t = "one two three four five six seven"
    docs = spark.createDataFrame([(1, t, "a", 1), (2, t, "b", 2), (2, t, "b", 2), (3, None, None, 3), (4, "", "c", 4), (4, "", "c", 4)], "doc_id long, text string, wkey string, _id int")
    out = N.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.wkey) for r in out.collect() if r.wkey) == [(1, "a"), (4, "c"), (4, "c")]


def test_what_is_a_word_is_decided_once(spark):
    """Marks, joiners, superscripts and fractions: Java's and Python's word characters differ on them."""
    odd = ["\U0001F469\u200D\U0001F467 \U0001F468\u200D\U0001F466", "\u0301 \u0302", "\u00b2 \u00bd", "\u203f", "\u0661 \u0e33", "\U0001F600"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(10, odd[0]), (11, odd[2])]
    kept = sorted(r.doc_id for r in N.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect())
    words = {i: bool(N.WORD.search(t)) for i, t in rows}
    assert kept == [i for i, _ in rows if not (i == 10 and words[10]) and not (i == 11 and words[11])]


def test_recall_of_pairs_at_each_similarity():
    """Pairs of 300-word texts that share a band, against (1 - s^6)^28."""
    rng = random.Random(6)
    for edits, least in ((3, 1.0), (6, 0.98)):  # similarities of about 0.9 and 0.82
        hit = n = 0
        for _ in range(60):
            base = [f"q{rng.randrange(10**6)}" for _ in range(300)]
            a, b = " ".join(base), edited(base, edits, rng)
            if N.similarity(N.bag(a), N.bag(b)) >= N.SIMILARITY:
                _, _, bands = N.sketch([a, b])
                n, hit = n + 1, hit + bool((bands[0] == bands[1]).any())
        assert n > 20 and hit / n >= least


def test_one_of_each_group_stays(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.doc_id for r in N.deduplicated(docs).collect()) == sorted(set(brute(rows).values()))
