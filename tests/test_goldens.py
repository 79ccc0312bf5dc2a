"""Searches through the store against golden results: pairs of loci, scores to three decimals, sets of features."""

import json
import unicodedata
from pathlib import Path

import pytest

from weftlens.operators import frequency as Q
from weftlens.plans import library as L
from weftlens.plans import search as S
from weftlens.sources.store import Store

GOLD = json.loads((Path(__file__).parent / "data" / "goldens.json").read_text("utf-8"))
nfkd = lambda s: unicodedata.normalize("NFKD", s)


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    """All golden texts; the lemmata of their forms are the dictionaries."""
    d = tmp_path_factory.mktemp("golden")
    store = Store(spark, str(d / "tables"))
    for language, texts in (("latin", ("epic_a", "epic_b")), ("greek", ("epic_c", "prose_d"))):
        edges = {(nfkd(f), nfkd(s)) for t in texts for f, stems in GOLD["texts"][t]["lemmata"].items() for s in stems}
        L.add_dictionary(store, "lemmata", language, spark.createDataFrame(sorted(edges), "key string, value string"))
    ids = {}
    for name, t in GOLD["texts"].items():
        (d / f"{name}.tess").write_text(t["tagged"], "utf-8")
        ids[name] = L.ingest(store, str(d / f"{name}.tess"), name, "author", t["language"], is_prose=name == "prose_d")
    return store, ids


def check(store, p, golden):
    rid = S.submit(store, p)
    got = {}
    for r in S.results(store, rid).orderBy(S.F.desc("score")).collect():
        got.setdefault(f"{r.target_tag.split()[-1]}|{r.source_tag.split()[-1]}", (f"{r.score:.3f}", sorted(r.features)))
    assert got == {k: (f"{score:.3f}", sorted(features)) for k, (score, features) in golden["rows"].items()}


@pytest.mark.parametrize("name", ["latin_texts", "latin_corpus"])
def test_latin_lemmata(library, name):
    store, ids = library
    g = GOLD["results"][name]
    check(store, S.Params(ids["epic_a"], ids["epic_b"], "line", "lemmata", g["stopwords"], freq_basis=name.split("_")[1], max_distance=10, min_score=0.0), g)


@pytest.mark.parametrize("name", ["greek_texts", "greek_corpus"])
def test_greek_lemmata_of_phrases_by_span(library, name):
    store, ids = library
    g = GOLD["results"][name]
    check(store, S.Params(ids["epic_c"], ids["prose_d"], "phrase", "lemmata", g["stopwords"], freq_basis=name.split("_")[1], distance="span", max_distance=10, min_score=0.0), g)


def test_english_forms(library):
    store, ids = library
    g = GOLD["results"]["english"]
    check(store, S.Params(ids["english_a"], ids["english_b"], "line", "form", g["stopwords"], max_distance=10, min_score=6.0), g)


def test_latin_sound_has_the_golden_pairs_and_features(library):
    """The scores of this golden follow another rule; its pairs are among those found, with the same features."""
    store, ids = library
    g = GOLD["results"]["latin_sound"]
    rid = S.submit(store, S.Params(ids["epic_a"], ids["epic_b"], "line", "sound", g["stopwords"], max_distance=999, min_score=0.0))
    got = {f"{r.target_tag.split()[-1]}|{r.source_tag.split()[-1]}": sorted(r.features) for r in S.results(store, rid).collect()}
    assert len(got) == 53 and {k: got.get(k) for k in g["rows"]} == {k: sorted(f) for k, (_, f) in g["rows"].items()}


@pytest.mark.parametrize("text", ["epic_a", "epic_b", "epic_c", "prose_d"])
def test_counts_of_tokens_that_share_a_lemma(library, text):
    store, ids = library
    t = GOLD["texts"][text]
    total, counts = t["sharing"]
    got = L.text_inverse(store, ids[text], t["language"], "lemmata").collect()
    assert {r.form: round(total / r.inv) for r in got} == {nfkd(k): v for k, v in counts.items()}


def test_corpus_counts(library):
    store, _ = library
    for language in ("latin", "greek"):
        total, counts = GOLD["lemma_counts"][language]
        got = {r.feature: r.n for r in L.frequencies(store, language, "lemmata").collect()}
        assert got == {nfkd(k): v for k, v in counts.items()} and sum(got.values()) == total


def test_a_bridge_of_languages(library):
    """Greek to Latin with a small dictionary, against the rule in plain Python."""
    store, ids = library
    spark = store.spark
    greek, latin = GOLD["texts"]["epic_c"], GOLD["texts"]["epic_b"]
    lemmata = [{nfkd(f): {nfkd(s) for s in x} for f, x in t["lemmata"].items()} for t in (greek, latin)]
    targets = sorted({s for x in lemmata[1].values() for s in x})
    bridge = {g: targets[i % len(targets)::len(targets) // 3][:3] for i, g in enumerate(sorted({s for x in lemmata[0].values() for s in x}))}
    L.add_dictionary(store, "translations", "greek", spark.createDataFrame([(g, x) for g, xs in bridge.items() for x in xs], "key string, value string"))
    p = S.Params(ids["epic_c"], ids["epic_b"], "line", "lemmata", ["et"], max_distance=999, min_score=0.0, method="greek_to_latin", far_stopwords=["ὁ"])
    got = {(r.source_tag.split()[-1], r.target_tag.split()[-1]): (sorted(r.features), r.distance, round(r.score, 6), [tuple(h) for h in r.highlight]) for r in S.results(store, S.submit(store, p)).collect()}
    lines = [[(loc, [nfkd(f) for _, f in words]) for loc, words in t["line"]] for t in (greek, latin)]
    share = [{f: sum(bool(lem.get(f, {f}) & lem.get(x, {x})) for _, forms in ls for x in forms) for _, forms in ls for f in forms} for ls, lem in zip(lines, lemmata, strict=True)]
    size = [sum(len(forms) for _, forms in ls) for ls in lines]
    sibling = {f: {x for x in share[0] if set(bridge.get(f, ())) & set(bridge.get(x, ()))} | {f} for f in share[0]}
    inv = [{f: size[0] / sum(share[0][x] for x in sibling[f]) for f in share[0]}, {f: size[1] / n for f, n in share[1].items()}]
    want = {}
    for g_loc, g_forms in lines[0]:
        for l_loc, l_forms in lines[1]:
            moved = [{x for s in lemmata[0].get(f, {f}) - {"ὁ"} for x in bridge.get(s, ())} - {"et"} for f in g_forms]
            own = [lemmata[1].get(f, {f}) - {"et"} for f in l_forms]
            hits = [(i, j) for i, a in enumerate(moved) for j, b in enumerate(own) if a & b]
            sides = [sorted({h[k] for h in hits}) for k in (0, 1)]
            if len(hits) < 2 or any(len({forms[i] for i in side}) < 2 for side, forms in zip(sides, (g_forms, l_forms), strict=True)):
                continue
            gap = 0
            for side, forms, v in zip(sides, (g_forms, l_forms), inv, strict=True):
                a, b = sorted(side, key=lambda i, forms=forms, v=v: (-v[forms[i]], i))[:2]
                gap += abs(a - b) + 1
            total = sum(inv[0][g_forms[i]] for i in sides[0]) + sum(inv[1][l_forms[j]] for j in sides[1])
            want[g_loc, l_loc] = (sorted({x for i, j in hits for x in moved[i] & own[j]}), gap, round(S_log(total) - S_log(gap), 6), sorted(hits))
    assert len(want) > 3 and got == want
    with pytest.raises(ValueError):
        S.submit(store, S.Params(ids["epic_a"], ids["epic_b"], feature="lemmata", method="greek_to_latin"))
    with pytest.raises(ValueError):
        S.submit(store, S.Params(ids["epic_a"], ids["epic_c"]))


def S_log(x):
    import math

    return math.log(x)


def test_languages_do_not_mix(library):
    store, ids = library
    words = {r.feature for r in S.create_stoplist(store, 10, "form", "latin").collect()}
    assert words and not words & {"the", "of", "and"}
    some = {r.feature: r.n for r in S.create_stoplist(store, 5, "lemmata", "latin", [ids["epic_a"]]).collect()}
    assert max(some.values()) < max(r.n for r in S.create_stoplist(store, 5, "lemmata", "latin").collect())


def test_indexes_of_features_go_on_from_the_count(library):
    store, _ = library
    rows = store.find("features", language="latin", feature="form").collect()
    assert sorted(r["index"] for r in rows) == list(range(len(rows))) and len({r.token for r in rows}) == len(rows)
    first = next(r for r in rows if r["index"] == 0)
    assert first.token == "arma"
    assert Q.stoplist(L.frequencies(store, "latin", "form"), 1).count() == 1
