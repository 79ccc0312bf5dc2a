"""Token counts against a search of all segmentations."""

import random

from weftlens.llm import tokencount as T


def test_shared_prefixes_change_nothing():
    counter = T.Counter(T.load_pieces(T.VOCABULARY))
    rng = random.Random(1)
    words = {"".join(rng.choice("abcdefghilmnorstuéß漢😀") for _ in range(rng.randrange(1, 14))) for _ in range(3000)}
    counter.learn(words)
    alone = T.Counter(counter.pieces)
    for w in list(words)[:500]:
        alone.known.clear()
        alone.learn({w})
        assert alone.known[w] == counter.known[w]


def test_scores_are_the_greatest():
    counter = T.Counter({T.MARK: -2.0, "a": -1.0, "b": -1.5, "ab": -1.7, T.MARK + "a": -2.5, "ba": -3.0, "aba": -3.3, T.MARK + "ab": -9.0})
    rng = random.Random(2)
    for _ in range(300):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
        counter.learn({w})
        full = T.MARK + w
        memo = {0: {(0.0, 0)}}
        for i in range(1, len(full) + 1):
            memo[i] = {(round(s + counter.pieces[full[a:i]], 9), n + 1) for a in range(i) if full[a:i] in counter.pieces for s, n in memo[a]}
            memo[i] |= {(round(s + T.UNKNOWN, 9), n + len(full[i - 1].encode())) for s, n in memo[i - 1]}
        top = max(s for s, _ in memo[len(full)])
        assert counter.known[w] in {n for s, n in memo[len(full)] if s == top}


def test_unusual_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (None, "the house"), (4, "the " * 100000), (4, "x\x00y"), (5, "😀漢 ퟿")]
    got = {(r.doc_id, r.n_words): r.n_tokens for r in T.count_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[(1, 0)] == got[(2, 0)] == got[(3, 0)] == 0 and got[(None, 2)] == 2 and got[(4, 100000)] == 100000
    assert T.count_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []
