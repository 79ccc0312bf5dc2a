"""Ingest, search, cache, retrieval, multi-text search, export, command line, jobs, store and deletion; the core score by hand."""

import datetime
import gzip
import hashlib
import json
import math
import random
import xml.etree.ElementTree as ET

import pytest

from weftlens import cli
from weftlens.functions import codec
from weftlens.functions import predicates as P
from weftlens.functions import text as X
from weftlens.operators import frequency as Q
from weftlens.operators import matching as M
from weftlens.operators import results as R
from weftlens.plans import library as L
from weftlens.plans import search as S
from weftlens.plans.jobs import IngestQueue, JobQueue
from weftlens.sources import exports, tess
from weftlens.sources import store as T
from weftlens.sources.store import Store
from weftlens.streaming import ingest as stream

A = ["<alpha. one. 1.1>\tarma virumque cano troiae qui primus ab oris", "<alpha. one. 1.2>\titaliam fato profugus laviniaque venit", "not tagged", "<alpha. one. 1.3>\tlitora multum ille et terris iactatus et alto. vi superum"]
B = ["<beta. two. 1>\tbella per emathios plus quam civilia campos", "<beta. two. 2>\tiusque datum sceleri cano primus in oris", "<beta. two. 3>\tet terris iactatus alto multum"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    for name, lines in (("alpha.one", A), ("beta.two", B)):
        (d / f"{name}.tess").write_text("\n".join(lines) + "\n")
    return d


def filled(spark, folder, name, multitext=True):
    store = Store(spark, str(folder / name))
    ids = {}
    for file, title, author in (("alpha.one", "one", "alpha"), ("beta.two", "two", "beta")):
        ids[title] = L.ingest(store, str(folder / f"{file}.tess"), title, author, "latin", multitext=multitext)
    return store, ids


@pytest.fixture(scope="module")
def library(spark, folder):
    return filled(spark, folder, "tables")


@pytest.fixture(scope="module")
def done(library):
    store, ids = library
    p = S.Params(ids["two"], ids["one"], stopwords=["et"], min_score=0.0, max_distance=20)
    return store, ids, p, S.submit(store, p)


def test_tagged_files(spark, folder):
    path = str(folder / "alpha.one.tess")
    lines = tess.read_lines(spark, path).orderBy("line_no").collect()
    assert [r.tag for r in lines] == ["1.1", "1.2", "1.3"] and [r.line_no for r in lines] == [0, 1, 3]
    assert lines[0].body.startswith("arma virumque") and tess.read_lines(spark, path, include_tag=False).orderBy("line_no").first().line == lines[0].body
    assert tess.line_at(spark, path, 2) == "not tagged" and tess.line_counts(spark, path).first().lines == 4
    with pytest.raises(IndexError):
        tess.line_at(spark, path, 4)
    assert [r.token for r in tess.read_tokens(spark, path).filter("line_no = 1").orderBy("pos").collect()] == A[1].split()[3:]
    assert tess.read_files(spark, path).first().hash == hashlib.md5((folder / "alpha.one.tess").read_bytes()).hexdigest()


@pytest.mark.parametrize(("name", "lines", "want"), [
    ("a.b.tess", ["<a. b. 1> text", "<a. b. 2> text", "", "<a. b. 3> text"], []), ("a.b.tess", ["<a. b. 1.1> text", "<a. b. 1.2> text", "<a. b. 2.1> text"], []),
    ("a.b.3.tess", ["<a. b. 3.1> text", "<a. b. 3.2> text"], []), ("a.b.tess", ["<a. b. 1> text", "<a. b. 3> text"], [(1, "minor locus")]), ("a.b.tess", ["<a. b. 1.1> text", "<a. b. 3.1> text"], [(1, "major locus")]),
    ("a.b.tess", ["<a. b. 1.1> text", "<a. b. 2.2> text"], [(1, "minor locus")]), ("a.b.tess", ["<x. b. 1> text", "<a. y. 2> text"], [(0, "author or title"), (1, "author or title")]),
    ("a.b.tess", ["<a. b. 1> text", "no tag here"], [(1, "no tag")]), ("a.b.tess", ["<a. b. one> text"], [(0, "no locus")]), ("a.b.txt", ["<a. b. 1> text"], [(None, "extension")]), ("a.b.tess", ["<a. b. 2> text"], [(0, "minor locus")])])
def test_violations_of_tagged_files(spark, tmp_path, name, lines, want):
    (tmp_path / name).write_text("\n".join(lines))
    assert sorted(((r.line_no, r.problem) for r in tess.violations(spark, str(tmp_path / name)).collect()), key=str) == want


def test_ingest(library, folder):
    store, ids = library
    row = L.text_row(store, ids["one"])
    assert row["status"] == "Done" and row["divisions"] == ["1"] and row["hash"] and {"feature form", "feature sound", "multitext"} <= set(row["details"])
    assert L.text_row(store, ids["two"])["divisions"] == []
    with pytest.raises(ValueError):
        L.ingest(store, str(folder / "alpha.one.tess"), "one", "alpha", "latin")
    with pytest.raises(ValueError):
        L.ingest(store, str(folder / "alpha.one.tess"), "x", "alpha", "klingon")
    with pytest.raises(ValueError):
        L.ingest(store, str(folder / "missing.tess"), "missing", "alpha", "latin")
    failed = store.find("texts", title="missing").first()
    assert failed.status == "Failed" and "missing" in failed.msg and store.find("units", text_id=failed.text_id).isEmpty()
    store.remove_text(failed.text_id)


def test_search_cache_and_retrieval(done):
    store, ids, p, rid = done
    before = S.search_row(store, rid)["last_queried"]
    assert S.submit(store, p) == rid and S.search_row(store, rid)["last_queried"] > before
    assert S.submit(store, S.Params(**{**p.__dict__, "max_distance": 19})) != rid
    out = {(r.target_tag, r.source_tag): r for r in S.results(store, rid).collect()}
    assert set(out) == {("alpha one 1.1", "beta two 2"), ("alpha one 1.3", "beta two 3")}
    assert sorted(out[("alpha one 1.1", "beta two 2")].features) == ["cano", "oris", "primus"]
    assert all(r.score >= 0 and r.distance <= 20 for r in out.values())
    status, msg, stages = S.progress(store, rid)
    assert status == "Done" and msg.startswith("Done in") and [x["stage"] for x in stages] == ["stoplist", "frequencies", "match", "save"] and all(x["value"] == 1 for x in stages)
    assert [r.score for r in S.top(store, rid, 1).collect()] == [max(r.score for r in out.values())]
    assert [r.target_tag for r in S.results(store, rid, "target_tag", "descending", 1, 1).collect()] == ["alpha one 1.1"]
    none = S.submit(store, S.Params(**{**p.__dict__, "min_score": 99.0}))
    assert S.results(store, none).isEmpty() and S.progress(store, none)[0] == "Done"


@pytest.mark.parametrize("wrong", [{"feature": "nothing"}, {"method": "nothing"}, {"score_basis": "lemmata"}, {"freq_basis": "x"}, {"distance": "x"}, {"unit_type": "x"}, {"method": "greek_to_latin"}, {"feature": "lemmata"}, {"source": "x"}])
def test_wrong_parameters(done, wrong):
    store, ids, p, _ = done
    with pytest.raises(ValueError):
        S.submit(store, S.Params(**{**p.__dict__, **wrong}))


def test_sound_searches_are_scored_by_sound(done):
    """submit with sound gives the rule of match_sound: multiplicities, first occurrences, trigram frequencies."""
    store, ids, _, _ = done
    rid = S.submit(store, S.Params(ids["two"], ids["one"], feature="sound", stopwords=[], max_distance=999, min_score=-99.0))
    got = {(r.target_tag, r.source_tag): (r.distance, round(r.score, 9)) for r in S.results(store, rid).collect()}
    tri = lambda body: [w[i:i + 3] for w in body.replace("v", "u").split() for i in range(len(w) - 2)]
    side = [{f"{name} {line.split('>')[0].split()[-1]}": [tri(w) for w in [line.split("\t")[1].replace(".", "")]][0] for line in lines if line[0] == "<"} for name, lines in (("alpha one", A), ("beta two", B))]
    inv = [{g: sum(map(len, s.values())) / sum(x.count(g) for x in s.values()) for x in s.values() for g in x} for s in side]
    want = {}
    for t, a in side[0].items():
        for s, b in side[1].items():
            both = set(a) & set(b)
            words = lambda x, body: sum(1 for w in body if set(tri(w)) & both)
            bodies = [next(line for line in lines if f" {k.split()[-1]}>" in line).split("\t")[1].replace(".", "").replace("v", "u").split() for k, lines in ((t, A), (s, B))]
            hits = {(i, j) for i, x in enumerate(bodies[0]) for j, y in enumerate(bodies[1]) if set(tri(x)) & set(tri(y))}
            if len(hits) < 2 or len(both) < 2:
                continue
            gap = 0
            for seq, v in ((a, inv[0]), (b, inv[1])):
                first = sorted(both, key=lambda g, seq=seq, v=v: (-v[g], seq.index(g)))[:2]
                gap += abs(seq.index(first[0]) - seq.index(first[1])) + 1
            want[t, s] = (gap, round(math.log(sum(a.count(g) * b.count(g) * (inv[0][g] + inv[1][g]) for g in both)) - math.log(gap), 9))
    assert want and got == want
    corpus = S.submit(store, S.Params(ids["two"], ids["one"], feature="sound", stopwords=[], freq_basis="corpus", max_distance=999, min_score=-99.0))
    assert S.results(store, corpus).count() == len(want)


def test_stoplists(done):
    store, ids, p, _ = done
    S.save_stoplist(store, "mine", ["et", "et", "in"])
    S.save_stoplist(store, "mine", ["et"])
    assert S.named_stoplist(store, "mine") == ["et"]
    named = S.submit(store, S.Params(**{**p.__dict__, "stopwords": "mine"}))
    assert S.results(store, named).count() == 2
    assert [r.feature for r in S.create_stoplist(store, 1, "form", "latin").collect()] == ["et"]
    top = S.create_stoplist(store, 3, "form", "latin", [ids["two"]]).collect()
    assert all(r.n == 1 for r in top)
    with pytest.raises(ValueError):
        S.named_stoplist(store, "nobody's")


def test_added_features(spark, folder):
    store, ids = filled(spark, folder, "added", multitext=False)
    with pytest.raises(ValueError):
        L.add_feature(store, ids["one"], "lemmata")
    assert L.text_row(store, ids["one"])["details"]["feature lemmata"] == "Failed"
    (folder / "lemmata.csv").write_text("arma,arma,armo\nCano,cano,canus\nalone\nprimus,first\nprimus,primus\n")
    assert L.load_dictionary(store, "lemmata", "latin", str(folder / "lemmata.csv")) == 5
    assert {(r.key, r.value) for r in L.dictionary(store, "lemmata", "latin").collect()} == {("arma", "arma"), ("arma", "armo"), ("cano", "cano"), ("cano", "canus"), ("primus", "primus")}
    assert L.setup(store) == {"latin": 5}
    for t in ids.values():
        L.add_feature(store, t, "lemmata")
        L.add_feature(store, t, "test")
    got = {r.feature: r.n for r in L.frequencies(store, "latin", "lemmata").collect()}
    assert got["canus"] == 2 and got["armo"] == 1 and got["et"] == 3
    for f in ("sound", "test"):
        assert {r.feature: r.n for r in L.frequencies(store, "latin", f).collect()} == {r.feature: r.n for r in L.frequencies(store, "latin", "sound").collect()}
    index = [r["index"] for r in store.find("features", feature="lemmata").collect()]
    assert sorted(index) == list(range(len(index)))
    with pytest.raises(NotImplementedError):
        L.add_feature(store, ids["one"], "test", multitext=True)
    rid = S.submit(store, S.Params(ids["two"], ids["one"], feature="lemmata", stopwords=["et"], min_score=0.0, max_distance=20))
    assert any("canus" in r.features for r in S.results(store, rid).collect())


def test_stored_bigrams_are_those_built(done):
    store, ids, _, _ = done
    for text in ids.values():
        inv = Q.inverse_frequencies(L.unit_tokens(store, text, "line"))
        for kind in ("line", "phrase"):
            want = {}
            units = {}
            for r in L.unit_tokens(store, text, kind).join(inv, "form").orderBy("unit", "pos").collect():
                units.setdefault(r.unit, []).append((r.pos, r.form, r.inv))
            for u, toks in units.items():
                for i, (p1, f1, i1) in enumerate(toks):
                    for p2, f2, i2 in toks[i + 1:]:
                        want.setdefault((u, *sorted((f1, f2))), round(math.log((i1 + i2) / (p2 - p1)), 9))
            got = {(r.unit, r.w1, r.w2): round(r.score, 9) for r in store.find("bigrams", text_id=text, unit_type=kind, feature="form").collect()}
            assert got == want and want


def test_multitext_search(done):
    store, ids, p, rid = done
    m = S.MultiParams(rid, list(ids.values()))
    multi = S.submit_multitext(store, m)
    assert S.submit_multitext(store, m) == multi and S.progress(store, multi)[0] == "Done"
    rows = {r.target_tag: r for r in S.multitext_results(store, multi).collect()}
    refs = {(x.w1, x.w2): [u.tag for u in x.units] for x in rows["alpha one 1.1"].cross_references}
    assert set(refs) == {("cano", "oris"), ("cano", "primus"), ("oris", "primus")} and all(sorted(v) == ["alpha one 1.1", "beta two 2"] for v in refs.values())
    scores = [u.score for x in rows["alpha one 1.1"].cross_references for u in x.units if (x.w1, x.w2) == ("cano", "primus")]
    assert scores == sorted(scores, reverse=True)
    one = S.submit_multitext(store, S.MultiParams(rid, [ids["two"]], top=1))
    assert all(len(x.units) == 1 and x.units[0].tag.startswith("beta") for r in S.multitext_results(store, one).collect() for x in r.cross_references)
    L.unregister_bigrams(store, ids["two"])
    assert store.find("bigrams", text_id=ids["two"]).isEmpty()
    L.register_bigrams(store, ids["two"])


def test_exports(done, folder):
    store, ids, p, rid = done
    path = lambda kind: str(folder / f"out.{kind}")
    for kind in ("csv", "json", "xml"):
        S.export(store, rid, path(kind), kind)
    S.export(store, rid, path("tsv.gz"), "tsv")
    S.export(store, rid, path("semi"), "csv", ";")
    lines = gzip.open(path("tsv.gz"), "rt").read().split("\n")
    head = [x for x in lines if x.startswith("#")]
    assert any(x.startswith("# source ") and x.endswith("= beta.two") for x in head) and any(x.startswith("# stopwords") and x.endswith("= et") for x in head)
    assert lines[len(head)].split("\t") == exports.COLUMNS
    rows = [x.split("\t") for x in lines[len(head) + 1:] if x]
    assert [r[0] for r in rows] == ["1", "2"] and float(rows[0][6]) == 10 and rows[0][1].startswith('"alpha one') and "**" in rows[0][2]
    assert ";".join(exports.COLUMNS) in open(path("semi")).read() and ",".join(exports.COLUMNS) in open(path("csv")).read()
    out = json.loads(open(path("json")).read())
    assert len(out["results"]) == 2 and out["parameters"]["source"]["title"] == "two" and out["parameters"]["stopwords"] == ["et"] and "status" not in out
    assert out["results"][0]["score"] == 10 and "**cano**" in "".join(r["source_snippet"] for r in out["results"])
    root = ET.parse(path("xml")).getroot()
    assert root.tag == "results" and root.attrib["source"] == "beta.two" and root.find("commonwords").text == "et"
    data = root.findall("tessdata")
    assert len(data) == 2 and [x.attrib["text"] for x in data[0]] == ["source", "target"] and data[0][0].find("span") is not None or "span" in (data[0][0].text or "")
    assert {x.attrib["line"] for d in data for x in d} == {"1.1", "2", "1.3", "3"}
    with pytest.raises(ValueError):
        S.export(store, rid, path("pdf"), "pdf")
    with pytest.raises(ValueError):
        S.export(store, "nothing", path("csv"), "csv")
    store.update("searches", store.spark.createDataFrame([store.find("searches", results_id=rid).first().asDict(recursive=True) | {"status": "Running"}], S.SEARCHES))
    with pytest.raises(RuntimeError):
        S.export(store, rid, path("csv"), "csv")
    store.update("searches", store.spark.createDataFrame([store.find("searches", results_id=rid).first().asDict(recursive=True) | {"status": "Done"}], S.SEARCHES))


def test_an_export_of_no_match_is_whole(done, folder):
    store, ids, p, _ = done
    none = S.submit(store, S.Params(**{**p.__dict__, "min_score": 98.0}))
    S.export(store, none, str(folder / "none.json"), "json")
    S.export(store, none, str(folder / "none.xml"), "xml")
    assert json.loads((folder / "none.json").read_text())["results"] == [] and ET.parse(folder / "none.xml").getroot().tag == "results"


def test_command_line(spark, folder, capsys):
    run = lambda *a: cli.main(["--store", str(folder / "cli"), *map(str, a)], spark)
    manifest = folder / "manifest.json"
    manifest.write_text(json.dumps([{"title": "two", "author": "beta", "language": "latin", "year": 65, "path": str(folder / "beta.two.tess"), "is_prose": False}]))
    (folder / "again.tsv").write_text("beta\ttwo\n")
    (folder / "lem.csv").write_text("cano,canus\narma,armo\n")
    assert run("setup", "--lemmata", "latin", folder / "lem.csv") == 0 and "2" in capsys.readouterr().out
    assert run("ingest", folder / "alpha.one.tess", "one", "alpha", "latin", "--year", "-19") == 0
    text_id = capsys.readouterr().out.strip()
    assert run("ingest", folder / "alpha.one.tess", "one", "alpha", "latin") == 1 and "already" in capsys.readouterr().err
    assert run("mass-ingest", manifest) == 0 and len(capsys.readouterr().out.split()) == 1 and run("mass-ingest", manifest) == 0
    assert run("mass-reingest", folder / "again.tsv") == 0 and run("add-multitext") == 0 and run("mass-add-feature", "test") == 0
    capsys.readouterr()
    assert run("find", "--author", "beta") == 0 and "two\tDone" in capsys.readouterr().out
    (folder / "update.json").write_text(json.dumps([{"_id": text_id, "year": -20, "urn": "u:1"}]))
    assert run("update", folder / "update.json") == 0
    row = L.text_row(Store(spark, str(folder / "cli")), text_id)
    assert row["year"] == -20 and row["extras"]["urn"] == "u:1"
    (folder / "wrong.json").write_text(json.dumps([{"_id": "nobody", "year": 1}]))
    assert run("update", folder / "wrong.json") == 1
    capsys.readouterr()
    assert run("search", "latin", "beta", "two", "latin", "alpha", "one", "--stopwords", "et,in", "--min-score", "0", "--max-distance", "20", "--output", folder / "cli.tsv") == 0
    shown = capsys.readouterr().out.split("\n")
    rid = shown[0]
    assert "alpha one 1.1" in "".join(shown) and "Result\t" in (folder / "cli.tsv").read_text()
    assert run("export", rid, folder / "cli.json", "--format", "json") == 0 and len(json.loads((folder / "cli.json").read_text())["results"]) == 2
    assert run("cleancache") == 0 and run("index") == 0 and run("delete", text_id) == 0 and run("delete", text_id) == 1
    assert Store(spark, str(folder / "cli")).find("texts").count() == 1 and Store(spark, str(folder / "cli")).read("searches").count() == 0


def test_jobs(done, folder):
    store, ids, p, rid = done
    queue = JobQueue(store, 2)
    job, new = queue.search(S.Params(**{**p.__dict__, "max_distance": 18}))
    bad = queue.put(S.submit, S.Params(**{**p.__dict__, "method": "nothing"}))
    assert queue.result(job, 300) == new and queue.status(job) == "Done" and S.progress(store, new)[0] == "Done"
    with pytest.raises(ValueError):
        queue.result(bad, 300)
    assert queue.status(bad) == "Failed"
    queue.close()
    ingests = IngestQueue(store)
    first = ingests.ingest(str(folder / "beta.two.tess"), "again", "beta", "latin")
    second = ingests.ingest(str(folder / "beta.two.tess"), "again", "beta", "latin")
    ingests.cancel(second)
    text = ingests.result(first, 300)
    assert ingests.status(second) == "Cancelled" and L.text_row(store, text)["status"] == "Done"
    ingests.close()
    store.remove_text(text)


def test_streaming_ingest(spark, folder, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tess").write_text("\n".join(A))
    lines = stream.line_stream(spark, str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "tables"))
    sink = stream.into(store, "stream_lines")
    stream.start(lines, sink, str(tmp_path / "check")).awaitTermination(120)
    (tmp_path / "in" / "b.tess").write_text("\n".join(B))
    stream.start(stream.line_stream(spark, str(tmp_path / "in")), sink, str(tmp_path / "check")).awaitTermination(120)
    assert {r.tag for r in store.read("stream_lines").collect()} == {"1.1", "1.2", "1.3", "1", "2", "3"}
    sink(store.read("stream_lines").drop("batch").limit(1), 0)  # a replayed batch changes nothing
    assert store.read("stream_lines").count() == 6
    counts = {}
    stream.start(stream.feature_stream(stream.line_stream(spark, str(tmp_path / "in"))), lambda df, i: counts.update({r.feature: r.n for r in df.collect()}), str(tmp_path / "counts"), "complete").awaitTermination(120)
    assert counts["et"] == 3 and counts["cano"] == 2


def test_score_by_hand(spark):
    schema = "unit string, pos int, form string, inv double, feature string"
    t = spark.createDataFrame([("t", 0, "a", 4.0, "a"), ("t", 3, "b", 2.0, "b"), ("u", 0, "a", 4.0, "a"), ("v", 0, "a", 4.0, "a"), ("v", 1, "a", 4.0, "a")], schema)
    s = spark.createDataFrame([("s", 1, "a", 5.0, "a"), ("s", 2, "b", 3.0, "b")], schema)
    got = M.match(t, s, max_distance=None).collect()
    assert [(r.t_unit, r.distance) for r in got] == [("t", 6)]  # one shared word, or one form twice, is no match
    assert abs(got[0].score - (math.log(14.0) - math.log(6))) < 1e-12
    assert [tuple(h) for h in got[0].highlight] == [(1, 0), (2, 3)]
    assert M.match(t, s, max_distance=5).count() == 0 and M.match(t, s, Q.stoplist_of(spark, ["a"]), max_distance=None).count() == 0
    inv = [spark.createDataFrame(rows, "form string, inv double") for rows in ([("a", 4.0), ("b", 2.0)], [("a", 5.0), ("b", 3.0)])]
    late = M.match(t.drop("inv"), s.drop("inv"), None, *inv, max_distance=None).collect()
    assert late == got
    two = spark.createDataFrame([("t", 0, "a", 4.0, "x"), ("t", 0, "a", 4.0, "y"), ("t", 1, "b", 2.0, "z")], schema)  # two features of one pair of positions are one hit
    assert M.match(two, spark.createDataFrame([("s", 0, "a", 1.0, "x"), ("s", 0, "a", 1.0, "y")], schema), max_distance=None).count() == 0


def test_span_distance_of_random_positions(spark):
    rng = random.Random(3)
    schema = "unit string, pos int, form string, inv double, feature string"
    t, s, want = [], [], {}
    for u in range(40):
        places = rng.sample(range(60), rng.randrange(2, 9))
        t += [(f"t{u}", p, f"f{u}.{k}", 1.0, f"f{u}.{k}") for k, p in enumerate(places)]
        s += [(f"s{u}", k, f"f{u}.{k}", 1.0, f"f{u}.{k}") for k in range(len(places))]
        want[f"t{u}"] = max(places) - min(places) + 1 + len(places)
    got = M.match(spark.createDataFrame(t, schema), spark.createDataFrame(s, schema), distance="span", max_distance=None).collect()
    assert {r.t_unit: r.distance for r in got} == want


def test_frequencies_of_some_texts(spark):
    n = spark.createDataFrame([("x", "a", 2), ("y", "a", 3), ("y", "b", 9), ("z", "b", 1)], "text_id string, feature string, n long")
    assert [tuple(r) for r in Q.summed_frequencies(n).collect()] == [("b", 10), ("a", 5)] and [tuple(r) for r in Q.summed_frequencies(n, ["x", "y"]).collect()] == [("b", 9), ("a", 5)]


def test_filters(spark):
    df = spark.createDataFrame([(1, "a"), (5, "b"), (9, None)], "n int, s string")
    n = lambda **w: sorted(r.n for r in df.filter(P.build_filter(**w)).collect())
    assert n() == [1, 5, 9] and n(n=(9, 5)) == [5, 9] and n(n_not=(4, 6)) == [1, 9] and n(s=["a", "b"]) == [1, 5]
    assert n(s_not="a") == [5] and n(n=5, s=None) == [5] and n(literal_not=True, n_not=(4, 6)) == []
    assert sorted(r.n for r in df.filter(P.any_of({"n": 1}, {"s": "b"})).collect()) == [1, 5] and df.filter(P.any_of()).count() == 0


def test_text_functions(spark):
    r = spark.range(1).select(
        X.trigrams(X.F.lit("arma")).alias("tri"), X.highlight(X.F.lit("arma, virumque cano"), X.F.array(X.F.lit(1))).alias("hl"),
        X.tag_of(X.F.lit("<a. b. 1.2> x")).alias("tag"), X.nfkd(X.F.lit("é")).alias("nfkd"), X.file_title(X.F.lit("De Bello")).alias("title")).first()
    assert (r.tri, r.hl, r.tag, r.nfkd, r.title) == (["arm", "rma"], "arma, **virumque** cano", "1.2", "é", "de_bello")
    tags = ["a 9", "a 10", "a 010.2", "a 1234567890123456789", "a 1234567890123456788", "b", "a"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in tags], "t string").orderBy(X.natural_key(X.F.col("t")), "t").collect()]
    assert got == ["a", "a 9", "a 10", "a 010.2", "a 1234567890123456788", "a 1234567890123456789", "b"]


def test_pages_of_random_matches(spark):
    rng = random.Random(9)
    rows = [(f"test {rng.randrange(9000)}.{rng.randrange(9000)}", f"test {rng.randrange(9000)}.{rng.randrange(9000)}", sorted("".join(rng.choices("abcdef", k=4)) for _ in range(2)), rng.random()) for _ in range(100)]
    m = spark.createDataFrame(rows, "source_tag string, target_tag string, matched_features array<string>, score double")
    natural = lambda t: [int(x) for x in t.split()[1].split(".")]
    keys = {"score": lambda r: r[3], "source_tag": lambda r: natural(r[0]), "target_tag": lambda r: natural(r[1]), "matched_features": lambda r: ", ".join(r[2])}
    for by, key in keys.items():
        for order in ("ascending", "descending"):
            want = sorted(rows, key=key, reverse=order == "descending")
            for number in range(4):
                got = [tuple(r) for r in R.page(m, by, order, 30, number).collect()]
                assert [key(r) for r in got] == [key(r) for r in want[30 * number:30 * number + 30]]
    assert R.page(m, "score", None, 10, 0).count() == 100 and R.page_count(m, 30) == 4
    pages = R.pages(m, 30).collect()
    assert sorted(r.result for r in pages) == list(range(1, 101)) and all(r.page == (r.result - 1) // 30 for r in pages)
    best = sorted(pages, key=lambda r: r.result)
    assert [r.score for r in best] == sorted((r[3] for r in rows), reverse=True) and best[0].normal_score == 10


def test_rows_as_json(spark):
    df = spark.createDataFrame([("x", 1, None, ("a", [1, 2]))], "id string, n int, none string, s struct<a: string, b: array<int>>")
    line = codec.encoded(df, exclude=("n",)).first().json
    assert json.loads(line) == {"id": "x", "none": None, "s": {"a": "a", "b": [1, 2]}}
    back = codec.decoded(codec.encoded(df), df.schema)
    assert back.collect() == df.collect()
    more = codec.decoded(spark.createDataFrame([('{"id": "y", "urn": "u", "m": {"k": 1}}',)], "json string"), "id string, extras map<string,string>").first()
    assert more.id == "y" and more.extras == {"urn": "u", "m": '{"k":1}'}
    assert codec.flattened(df).columns == ["id", "n", "none", "s.a", "s.b"]
    assert df.select(codec.key_hash(["id"])).first() == df.select(codec.key_hash(["id"])).first()


def test_store_rules(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    words = spark.createDataFrame([("x", ["a"]), ("x", ["a"])], "name string, stopwords array<string>")
    assert store.insert("stopwords", words) == 1 and store.insert("stopwords", words) == 0
    old = store.read("stopwords")
    store.update("stopwords", spark.createDataFrame([("x", ["b"])], words.schema))
    assert store.read("stopwords").first().stopwords == ["b"] and old.first().stopwords == ["a"]  # a plan made before reads what it was made on
    with pytest.raises(ValueError):
        store.update("stopwords", spark.createDataFrame([("y", ["b"])], words.schema))
    with pytest.raises(ValueError):
        store.delete("stopwords")
    with pytest.raises(ValueError):
        store.delete_rows("stopwords", words.limit(0))
    with pytest.raises(ValueError):
        store.read("nothing")
    store.insert("stopwords", spark.createDataFrame([("z", ["c"])], words.schema))
    store.delete_rows("stopwords", spark.createDataFrame([("x",)], "name string"))
    assert [r.name for r in store.read("stopwords").collect()] == ["z"]
    store.insert("stopwords", spark.createDataFrame([("w", ["d"], 1)], "name string, stopwords array<string>, extra int"))
    assert {r.name: r.extra for r in store.read("stopwords").collect()} == {"z": None, "w": 1}
    assert store.vacuum(1) > 0 and store.read("stopwords").count() == 2


def test_store_partitions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    rows = spark.range(400).selectExpr("concat('t', id % 4) as text_id", "if(id % 8 < 4, 'line', 'phrase') as unit_type", "cast(id as int) as unit", "0 as pos", "'f' as form")
    store.insert("units", rows, check=False)
    assert store.find("units", text_id="t1").count() == 100
    plan = store.find("units", text_id="t1", unit_type="line")
    assert {f.split("text_id=")[1].split("/")[0] for f in plan.inputFiles()} == {"t1"} and all("unit_type=line" in f for f in plan.inputFiles())
    before = set(store.read("units").inputFiles())
    store.insert("units", rows.limit(1).selectExpr("'new' as text_id", "unit_type", "unit", "pos", "form"), check=False)
    assert before < set(store.read("units").inputFiles())  # an insert only adds files
    store.delete("units", text_id="t2")
    assert set(store.read("units").inputFiles()) & before == {f for f in before if "text_id=t2" not in f}  # a delete only drops folders
    store.delete("units", unit=(0, 50))
    assert store.read("units").filter("unit <= 50").isEmpty() and store.read("units").count() == 301 - sum(i % 4 != 2 for i in range(51)) - 1 + (0 if store.find("units", text_id="new").isEmpty() else 1)


def test_pipelines_and_lookups(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id int, k string")
    b = spark.createDataFrame([("x", 5), ("x", 4)], "k string, v int")
    got = T.pipeline(a, [{"match": {"id": (1, 3)}}, {"lookup": {"from": b, "on": ["k"], "as": "vs"}}, {"set": {"n": X.F.size("vs")}}, {"sort": [("n", False), ("id", True)]}, {"skip": 1}, {"limit": 2}, {"project": ["id", "n", "vs"]}]).collect()
    assert [(r.id, r.n, [v.v for v in r.vs]) for r in got] == [(3, 2, [4, 5]), (2, 0, [])]
    assert T.pipeline(a, [{"set": {"l": X.F.array(X.F.lit(1), X.F.lit(2))}}, {"unwind": "l"}]).count() == 6
    with pytest.raises(ValueError):
        T.pipeline(a, [{"nothing": 1}])
    rows = spark.createDataFrame([("1", "a", ["q"]), ("2", None, None), ("3", "b", ["a", "a"])], "id string, source string, texts array<string>")
    assert {r.id for r in T.referring(rows, spark.createDataFrame([("a",)], "id string"), "source", "texts").collect()} == {"1", "3"}


def test_deletion(spark, folder):
    store, ids = filled(spark, folder, "deletion")
    p = S.Params(ids["two"], ids["one"], stopwords=["et"], min_score=0.0, max_distance=20)
    rid = S.submit(store, p)
    multi = S.submit_multitext(store, S.MultiParams(rid, [ids["one"]]))
    row = store.find("searches", results_id=multi).first().asDict(recursive=True)
    S.clean_cache(store)
    assert store.read("searches").count() == 2
    store.update("searches", spark.createDataFrame([row | {"last_queried": datetime.datetime.now() - datetime.timedelta(days=8)}], S.SEARCHES))
    S.clean_cache(store)
    assert [r.results_id for r in store.read("searches").collect()] == [rid] and store.read("multiresults").count() == 0
    S.submit_multitext(store, S.MultiParams(rid, [ids["one"]]))
    again = L.reingest(store, ids["one"], multitext=True)
    assert again == ids["one"] and store.read("searches").count() == 0 and store.read("matches").count() == 0 and store.read("multiresults").count() == 0
    assert {r.text_id for r in store.read("units").select("text_id").distinct().collect()} == set(ids.values())
    rid = S.submit(store, p)
    S.obliterate(store)
    assert store.read("searches").count() == 0 and store.read("matches").count() == 0
    store.remove_text(ids["one"])
    for table in ("units", "tokens", "feature_freq", "bigrams", "texts"):
        assert {r.text_id for r in store.read(table).select("text_id").distinct().collect()} == {ids["two"]}
