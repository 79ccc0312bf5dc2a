"""Decontamination and license scans against alignments of all pairs, and planted edits."""

import random
import tracemalloc

import numpy as np
import pytest

from weftlens.llm import decontam as D
from weftlens.llm import licenses as C

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(500)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(rng.randrange(8, 60)) for _ in range(25)] + [["one", "two", "three"], ["the"] * 12]
    docs, planted = [], {}
    for i in range(300):
        words = say(rng.randrange(0, 150))
        if i % 5 == 0:
            t = rng.randrange(25)
            copy = list(items[t])
            for _ in range(len(copy) // 12):
                copy[rng.randrange(len(copy))] = "edited"
            at = rng.randrange(len(words) + 1)
            words[at:at] = copy
            planted[i] = t
        docs.append((i, " ".join(words).capitalize() + "."))
    return docs, [(i, " ".join(w)) for i, w in enumerate(items)], planted


def test_planted_copies_are_found_and_others_are_not(spark, tables):
    docs, items, planted = tables
    got = {(r.doc_id, r.item_id): r for r in D.find(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert set(got) == set(planted.items())
    for (d, t), r in got.items():
        assert docs[d][1][r.start:r.end].lower().split()[0] in items[t][1].split() and r.matched <= len(items[t][1].split())


def test_scores_are_those_of_the_whole_alignment(spark, tables):
    docs, items, planted = tables
    got = {(r.doc_id, r.item_id): r.score for r in D.find(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    for d, t in planted.items():
        vocab = {w: i + 1 for i, w in enumerate(items[t][1].split())}
        a = np.array([vocab[w] for w in items[t][1].split()])
        b = np.array([vocab.get(w, 0) for w in D.WORD.findall(docs[d][1].lower())])
        assert abs(got[(d, t)] - D.align(a, b)[0] / (2 * len(a))) < 1e-9


def test_copies_with_every_fifth_to_seventh_word_changed(spark):
    """Against alignments of all pairs; the new words are in no item, so no passage holds the grams that they break."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(20, 45))] for _ in range(12)]
    docs = []
    for k, every in [(k, e) for k in range(12) for e in (5, 6, 7)]:
        copy = [f"new{j}" if j % every == every - 1 else w for j, w in enumerate(items[k])]
        docs.append([rng.choice(vocabulary) for _ in range(30)] + copy + [rng.choice(vocabulary) for _ in range(30)])
    # words put between the copy's: few runs of four are left, and the copy is much longer than the item
    docs += [[x for j, w in enumerate(items[k]) for x in ([w, "put"] if j >= 12 and j % 2 else [w])] for k in range(12)]
    vocab = {f"w{i}": i + 1 for i in range(300)}
    want = {}
    for d, words in enumerate(docs):
        for t, item in enumerate(items):
            a, b = np.array([vocab[w] for w in item]), np.array([vocab.get(w, 0) for w in words])
            b[~np.isin(b, a)] = 0
            score = D.align(a, b)[0] / (2 * len(a))
            if score >= D.MIN_SCORE:
                want[(d, t)] = score
    assert len(want) >= 48
    got = D.find(spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], DOCS), spark.createDataFrame([(t, " ".join(w)) for t, w in enumerate(items)], ITEMS)).collect()
    assert {(r.doc_id, r.item_id): r.score for r in got} == pytest.approx(want)


def test_blocks_of_items_change_nothing(spark, tables):
    docs, items, _ = tables
    a, b = (sorted(map(tuple, D.find(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block=k).collect())) for k in (20_000, 5))
    assert a == b


def test_copies_in_a_row_are_reported_one_by_one(spark, tables):
    _, items, _ = tables
    text = items[3][1]
    words = text.split()
    edited = " ".join(["edited" if j == len(words) // 2 else w for j, w in enumerate(words)])
    docs = [(1, f"{text} {text}"), (2, f"x {text} {edited} y {text} z")]
    got = D.find(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    spans = sorted((r.doc_id, r.start, r.end) for r in got if r.item_id == 3)
    n, m = len(text), len(edited)
    assert spans == [(1, 0, n), (1, n + 1, 2 * n + 1), (2, 2, 2 + n), (2, 3 + n, 3 + n + m), (2, 6 + n + m, 6 + 2 * n + m)]
    assert len(got) == 5


def test_clean_drops_only_the_contaminated(spark, tables):
    docs, items, planted = tables
    rows = [(*d, "r", "h") for d in docs] + [(None, None, "r", "h"), (4, "", "r", "h"), (4, "", "r", "h"), (None, items[0][1], "r", "h")]
    frame = spark.createDataFrame(rows, DOCS + ", _row string, _hit string")
    out = D.clean(frame, spark.createDataFrame([*items, (0, items[0][1]), (99, None), (98, "")], ITEMS))
    assert out.columns == frame.columns
    assert out.count() == len(rows) - len(planted) - 1
    assert not {r.doc_id for r in out.collect()} & set(planted)


def test_alignment_of_a_known_case():
    a, b = np.array([1, 2, 3, 4, 5]), np.array([0, 1, 2, 0, 4, 5, 0])
    assert D.align(a, b) == (7, 4, 1, 6)


def test_empty_tables(spark, tables):
    docs, items, _ = tables
    d, t = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert D.find(d.limit(0), t).collect() == [] and D.find(d, t.limit(0)).collect() == []
    assert D.clean(d, t.limit(0)).count() == len(docs) and D.clean(d.limit(0), t).collect() == []


def test_a_long_text_is_read_to_its_end(spark, tables):
    _, items, _ = tables
    docs = spark.createDataFrame([(1, "filler " * 200000 + items[3][1])], DOCS)
    assert [(r.item_id, r.score) for r in D.find(docs, spark.createDataFrame(items, ITEMS)).collect()] == [(3, 1.0)]


TEXTS = {(n, k): t for n, k, t in C.templates() if k != "name"}


@pytest.fixture(scope="module")
def index():
    return C.Index(C.templates())


def test_licenses_with_edits_and_spans(spark):
    mit, gpl = "Released under the MIT License.", TEXTS["gpl-3.0", "notice"]
    edited = gpl.replace("redistribute", "share").replace("General ", "")
    rows = [(1, f"Intro. {mit} End.", "c"), (2, f"a b c {edited} d e", "c"), (3, None, "c"), (4, "", "c"), (5, "license the work", "c"), (6, f"{mit} {mit}", "c"), (6, f"{mit} {mit}", "c"), (None, mit.upper(), "c"), (7, "pad " * 100000 + mit, "c")]
    got = {}
    for r in C.scan(spark.createDataFrame(rows, DOCS + ", license string")).collect():
        got.setdefault(r.doc_id, []).append(r)
    text = {i: t for i, t, _ in rows}
    assert set(got) == {1, 2, 6, 7, None}
    r = got[1][0]
    assert (r.license, r.coverage, r.kind) == ("mit", 1.0, "name") and text[1][r.start:r.end] == mit.rstrip(".")
    assert got[2][0].license == "gpl-3.0" and 0.8 <= got[2][0].coverage < 1
    assert [x.license for x in got[6]] == ["mit"] * 4 and len(got[7]) == 1
    assert C.scan(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize(("text", "want"), [
    ("Licensed under CC BY-ND 4.0.", ["cc-by-nd-4.0"]), ("Licensed under CC BY-NC-SA 4.0", ["cc-by-nc-sa-4.0"]), ("Licensed under CC BY 3.0", ["cc-by-3.0"]), ("Licensed under CC BY-NC 5.0", []),
    ("This work is licensed under the GNU General Public License, version 2.", ["gpl-2.0"]), ("Released under the BSD License.", ["bsd"]), ("Released under an MIT License", ["mit"]),
    (C.GNU.format("Lesser ", "3"), ["lgpl-3.0"]), (C.GNU.format("Affero ", "3"), ["agpl-3.0"]), (C.GNU.format("", "2"), ["gpl-2.0"]), ("Released under the MIT License by Foo.", ["mit"]),
    ("Licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License", ["cc-by-nd-4.0"]), ("Released under the GNU Lesser General Public License", ["lgpl"]),
    ("Licensed under CC BY 4.0. Licensed under CC BY-SA 4.0.", ["cc-by-4.0", "cc-by-sa-4.0"])])
def test_siblings_are_told_apart(index, text, want):
    assert [m[0] for m in index.matches(text)] == want


@pytest.mark.parametrize("name", sorted(p.stem for p in C.TEXTS.glob("*.txt")))
def test_whole_texts_are_found_as_themselves(index, name):
    text = TEXTS[name, "text"]
    words = C.WORD.findall(text)
    rng = random.Random(name)
    edited = " ".join("edited" if rng.random() < 0.05 else w for w in words)
    for t, least in ((text, 1.0), (edited, 0.9)):
        got = index.matches(f"some words before {t} and some after")
        assert [m[:2] for m in got] == [(name, "text")] and got[0][2] >= least
        assert abs(got[0][3] - 18) < 60 and abs(got[0][4] - 18 - len(t)) < 60


def test_matches_are_those_of_alignments_with_all_templates(index, monkeypatch):
    """Names and notices with edits, without the index of fingerprints."""
    rng = random.Random(21)
    short = [t for n, k, t in C.templates() if k != "text"]
    texts = []
    for _ in range(60):
        words = [rng.choice(["by", "the", "a", "4", "license", "some", "text", "public"]) for _ in range(12)]
        words[6:6] = [w if rng.random() > 0.06 else "edit" for w in rng.choice(short).split()]
        texts.append(" ".join(words))
    got = [index.matches(t) for t in texts]
    every = lambda ids: {t: [[-len(index.ids[t]), len(ids), 0, len(ids), 1]] for t, k in enumerate(index.kinds) if k != "text"}
    monkeypatch.setattr(index, "candidates", every)
    want = [index.matches(t) for t in texts]
    assert sum(map(bool, want)) > 30 and sum(g == w for g, w in zip(got, want, strict=True)) >= 59


def test_a_renamed_license_is_not_its_sibling(index):
    text = TEXTS["gpl-3.0", "text"].replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC")
    assert ("gpl-3.0", "text") not in [m[:2] for m in index.matches(text)]


def test_banded_alignment_against_the_whole_table():
    rng = random.Random(3)
    for _ in range(200):
        a = np.array([rng.randrange(1, 9) for _ in range(12)])
        b = np.array([0] * rng.randrange(4) + [x for x in a.tolist() if rng.random() > 0.1] + [0] * 3)
        pairs = C.banded(a, b, -40, 40)
        top, matched, _, end = D.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        gaps = (pairs[-1][0] - pairs[0][0]) + (pairs[-1][1] - pairs[0][1])  # a score of matches, mismatches and gaps between them
        assert 2 * len(pairs) - (gaps - 2 * (len(pairs) - 1)) <= top and len(pairs) <= matched + 1


def test_every_window_of_a_template_has_a_fingerprint(index):
    for t, kind in enumerate(index.kinds):
        n, window = C.GRAMS[kind]
        places = {q for at in index.where[kind].values() for u, q in at if u == t}
        if kind == "name":
            assert places
        else:
            assert all(places & set(range(i, i + window)) for i in range(max(1, len(index.ids[t]) - n + 1 - window + 1)))


def slow_align(a, b):
    """Score and matched words of the best local alignment, cell by cell."""
    best, h = (0, 0), {}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = [(0, 0)]
            same = a[i - 1] == b[j - 1] != 0
            for x, y, add, hit in ((i - 1, j - 1, 2 if same else -1, int(same)), (i - 1, j, -1, 0), (i, j - 1, -1, 0)):
                v, n = h.get((x, y), (0, 0))
                s.append((v + add, n + hit) if v + add > 0 else (0, 0))
            h[i, j] = max(s)
            best = max(best, h[i, j])
    return best


def test_linear_space_alignment_against_the_whole_table():
    rng = random.Random(8)
    for _ in range(150):
        a = np.array([rng.randrange(0, 6) for _ in range(rng.randrange(1, 14))])
        b = np.array([rng.randrange(0, 6) for _ in range(rng.randrange(1, 20))])
        top, matched, start, end = D.align(a, b)
        assert (top, matched) == slow_align(a.tolist(), b.tolist()) and D.align(a, b[start:end])[:2] == (top, matched)


def test_long_items_take_little_memory(spark):
    words = [f"w{i}" for i in np.random.default_rng(1).integers(0, 20000, 50_000)]
    edited = ["new" if i % 9 == 0 else w for i, w in enumerate(words[:4000])]
    docs = [(1, "before " * 50 + " ".join(words) + " after"), (2, "x " + " ".join(edited))]
    got = D.find(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:4000]))], ITEMS)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (1, 2), (2, 2)]
    a, b = np.arange(1, 3001), np.arange(3, 9003)
    tracemalloc.start()
    assert D.align(a, b) == (2 * 2998, 2998, 0, 2998)
    assert tracemalloc.get_traced_memory()[1] < 3_000_000
    tracemalloc.stop()


@pytest.mark.parametrize(("rate", "least"), [(0.05, 1.0), (0.1, 1.0), (0.15, 0.99), (0.2, 0.99), (0.25, 0.98)])
def test_recall_by_rate_of_edited_words(rate, least):
    """Of copies that reach the score by full alignment, those with a seed; also items of 8 to 20 words."""
    rng = random.Random(5)
    items = [(i, " ".join(f"v{rng.randrange(4000)}" for _ in range(rng.randrange(8, 60)))) for i in range(400)]
    index = D.Items(items)
    n = found = 0
    for t, (_, text) in enumerate(items):
        copy = [w if rng.random() >= rate else "edit" for w in text.split()]
        ids = np.array([index.vocab.get(w, 0) for w in copy], np.int64)
        if D.align(index.ids[t], ids)[0] >= index.least[t]:
            n += 1
            found += any(x[0] == t for p in index.passages(" ".join(copy)) for x in index.scores(np.array(p[0], np.int64), np.array(p[3]), np.array(p[4]), {}))
    assert n > 300 and found / n >= least
