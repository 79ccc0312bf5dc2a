"""Searches as jobs: parameters, stoplists, methods, cache, run, retrieve, export."""

from __future__ import annotations

import datetime
import hashlib
import json
import time
import traceback
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import older_than
from ..functions.text import display_tag
from ..operators import features as X
from ..operators import frequency as Q
from ..operators import matching as M
from ..operators import multitext as U
from ..operators import results as R
from ..sources import exports
from ..sources.scratch import written
from ..sources.store import Store
from . import library as L

SEARCHES = ("results_id string, search_type string, key string, parameters string, status string, msg string, source_text string, target_text string, text_ids array<string>, parallels_id string,"
            " last_queried timestamp, progress array<struct<stage: string, value: double>>")
STAGES = ("stoplist", "frequencies", "match", "save", "export")


@dataclass
class Params:
    source: str
    target: str
    unit_type: str = "line"
    feature: str = "form"
    stopwords: int | str | list[str] = 10
    stopword_basis: str = "corpus"
    score_basis: str | None = None
    freq_basis: str = "texts"
    max_distance: int = 10
    distance: str = "frequency"
    min_score: float = 6.0
    method: str = "original"
    far_stopwords: list[str] = field(default_factory=list)

    def canonical(self) -> str:
        d = asdict(self)
        for k in ("stopwords", "far_stopwords"):
            if isinstance(d[k], list):
                d[k] = sorted(set(d[k]))
        d["score_basis"] = d["score_basis"] or d["feature"]
        return json.dumps(d, sort_keys=True, ensure_ascii=False)

    def key(self) -> str:
        return hashlib.sha256(self.canonical().encode()).hexdigest()


# stoplists


def create_stoplist(store: Store, n: int, feature: str, language: str, basis: str | list[str] = "corpus") -> DataFrame:
    """(feature, n) of the n most frequent features of a language: in its whole corpus, or in a list of texts."""
    return Q.stoplist(L.frequencies(store, language, feature, None if basis == "corpus" else list(basis)), n)


def save_stoplist(store: Store, name: str, words: list[str]) -> None:
    """Keep a list under a name, replacing one of that name."""
    store.put("stopwords", [{"name": name, "stopwords": sorted(set(words))}], "name string, stopwords array<string>")


def named_stoplist(store: Store, name: str) -> list[str]:
    row = store.find("stopwords", name=name).first() if store.exists("stopwords") else None
    if row is None:
        raise ValueError(f"no stoplist {name!r}")
    return row.stopwords


def stoplist(store: Store, p: Params, language: str) -> DataFrame:
    """The stoplist of a search: given words, a stored list's name, or the n most frequent features."""
    if isinstance(p.stopwords, int):
        return create_stoplist(store, p.stopwords, p.feature, language, "corpus" if p.stopword_basis == "corpus" else [p.source, p.target])
    return Q.stoplist_of(store.spark, named_stoplist(store, p.stopwords) if isinstance(p.stopwords, str) else p.stopwords)


# methods: (source row, target row, params) -> (t_unit, s_unit, features, distance, score, highlight)


def _check(p: Params, source: dict, target: dict) -> None:
    if p.method not in METHODS:
        raise ValueError(f"unknown method {p.method!r}")
    if p.feature not in X.FEATURIZERS:
        raise ValueError(f"unknown feature {p.feature!r}")
    if (p.score_basis or p.feature) != p.feature:
        raise ValueError("the score basis must be the matched feature")
    if p.freq_basis not in ("texts", "corpus"):
        raise ValueError(f"unknown frequency basis {p.freq_basis!r}")
    if p.distance not in M.DISTANCES:
        raise ValueError(f"unknown distance {p.distance!r}")
    if p.unit_type not in ("line", "phrase"):
        raise ValueError(f"unknown unit type {p.unit_type!r}")
    if p.method == "greek_to_latin" and (source["language"], target["language"]) != ("greek", "latin"):
        raise ValueError("the source must be Greek and the target Latin")
    if p.method == "original" and source["language"] != target["language"]:
        raise ValueError("the texts' languages differ")


def corpus_frequencies(store: Store, language: str, feature: str) -> DataFrame:
    """(feature, freq) over all texts of the language."""
    n = L.frequencies(store, language, feature)
    return n.join(F.broadcast(n.agg(F.sum("n").alias("_all")))).select("feature", (F.col("n") / F.col("_all")).alias("freq"))


def inverse(store: Store, p: Params, text: dict, tokens: DataFrame) -> DataFrame:
    """(form, inv) by the frequency basis; of sound, (feature, inv): trigrams are not looked up by their word."""
    language, feature = text["language"], p.feature
    if p.feature in ("sound", "test"):
        if p.freq_basis == "corpus":
            return corpus_frequencies(store, language, feature).select("feature", F.try_divide(F.lit(1.0), "freq").alias("inv"))
        lines = X.exploded(L.featurized(store, L.unit_tokens(store, text["text_id"], "line"), language, feature))
        return Q.of_counts(Q.feature_counts(lines), "feature")
    if p.freq_basis == "corpus":
        return Q.inverse_averaged_frequencies(tokens, corpus_frequencies(store, language, feature))
    return L.text_inverse(store, text["text_id"], language, feature)


def original(store: Store, p: Params, source: dict, target: dict, stage: Callable[[str], None]) -> DataFrame:
    """Texts of one language by a common feature."""
    language = source["language"]
    stage("stoplist")
    stop = written(stoplist(store, p, language).select("feature"))
    stage("frequencies")
    ready = []
    for text in (target, source):
        tokens = L.featurized(store, L.unit_tokens(store, text["text_id"], p.unit_type), language, p.feature)
        ready.append((X.exploded(tokens), written(inverse(store, p, text, tokens))))
    (t, ti), (s, si) = ready
    stage("match")
    if p.feature in ("sound", "test"):
        return M.match_sound(R.trigram_places(t), R.trigram_places(s), stop, ti, si, max_distance=p.max_distance, min_score=p.min_score)
    return M.match(t, s, stop, ti, si, distance=p.distance, max_distance=p.max_distance, min_score=p.min_score)


def greek_to_latin(store: Store, p: Params, source: dict, target: dict, stage: Callable[[str], None]) -> DataFrame:
    """A Greek source and a Latin target by translated lemmata: `stopwords` are Latin, `far_stopwords` Greek."""
    lemmata = Params(**{**asdict(p), "feature": "lemmata"})
    stage("stoplist")
    words = p.stopwords if isinstance(p.stopwords, list) else [r[0] for r in stoplist(store, lemmata, "latin").select("feature").collect()]  # a top-n or a named list
    latin_stop, greek_stop = Q.stoplist_of(store.spark, words), Q.stoplist_of(store.spark, p.far_stopwords)
    bridge = written(L.dictionary(store, "translations", "greek").select(F.col("key").alias("feature"), F.col("value").alias("other")))
    stage("frequencies")
    greek, latin = (L.featurized(store, L.unit_tokens(store, t["text_id"], p.unit_type), t["language"], "lemmata") for t in (source, target))
    latin_inv = inverse(store, lemmata, target, latin)
    if p.freq_basis == "corpus":
        greek_inv = inverse(store, lemmata, source, greek)
    else:
        counts = Q.cofeature_counts(L.featurized(store, L.unit_tokens(store, source["text_id"], "line"), "greek", "lemmata"))
        greek_inv = M.bridge_inverse_frequencies(written(counts), greek.count(), bridge)
    stage("match")
    found = M.match_bridge(X.exploded(greek), X.exploded(latin), bridge, greek_stop, latin_stop, written(greek_inv), written(latin_inv), distance=p.distance, max_distance=p.max_distance, min_score=p.min_score)
    turned = F.transform("highlight", lambda h: F.struct(h["t_pos"].alias("s_pos"), h["s_pos"].alias("t_pos")))
    return found.select(F.col("s_unit").alias("t_unit"), F.col("t_unit").alias("s_unit"), "features", "distance", "score", F.array_sort(turned).alias("highlight"))


METHODS = {"original": original, "greek_to_latin": greek_to_latin}


def run_match(store: Store, p: Params, stage: Callable[[str], None] = lambda name: None) -> DataFrame:
    """The matches of a search: (t_unit, s_unit, features, distance, score, highlight)."""
    source, target = L.text_row(store, p.source), L.text_row(store, p.target)
    _check(p, source, target)
    return METHODS[p.method](store, p, source, target, stage)


# jobs


class Progress:
    """A search's row in the store: its status and how far each stage is."""

    def __init__(self, store: Store, rid: str, p, **named):
        self.store, self.stages = store, []
        self.row = {"results_id": rid, "search_type": p.method, "key": p.key(), "parameters": p.canonical(), "source_text": None, "target_text": None, "text_ids": [], "parallels_id": None} | named

    def note(self, status: str, msg: str) -> None:
        row = self.row | {"status": status, "msg": msg, "last_queried": datetime.datetime.now(), "progress": [{"stage": s, "value": v} for s, v in self.stages]}
        self.store.put("searches", [row], SEARCHES)

    def stage(self, name: str) -> None:
        """The last stage is done, the next one begins."""
        self.stages = [(s, 1.0) for s, _ in self.stages] + [(name, 0.0)]
        self.note("Running", name)


def cached(store: Store, p) -> str | None:
    """results_id of a finished search with the same parameters; it counts as queried now."""
    if not store.exists("searches"):
        return None
    row = store.read("searches").filter((F.col("key") == p.key()) & (F.col("status") == "Done")).first()
    if row is None:
        return None
    store.put("searches", [row.asDict(recursive=True) | {"last_queried": datetime.datetime.now()}], SEARCHES)
    return row.results_id


def submit(store: Store, p: Params, results_id: str | None = None, export_to: str | None = None) -> str:
    """Run a search, or return the cached one. A failure is recorded and raised; no match is a valid result."""
    source, target = L.text_row(store, p.source), L.text_row(store, p.target)
    _check(p, source, target)
    if old := cached(store, p):
        return old
    rid, began = results_id or uuid.uuid4().hex, time.time()
    state = Progress(store, rid, p, source_text=p.source, target_text=p.target)
    state.note("Running", "")
    try:
        found = run_match(store, p, state.stage).withColumn("search_id", F.lit(rid)).withColumn("match_id", F.md5(F.concat_ws(":", F.lit(rid), "t_unit", "s_unit")))
        state.stage("save")
        store.insert("matches", found, check=False)
        if export_to:
            state.stage("export")
            _export(store, rid, export_to, "tsv")
        state.stages = [(s, 1.0) for s, _ in state.stages]
    except Exception:
        state.note("Failed", traceback.format_exc()[-2000:])
        raise
    state.note("Done", f"Done in {time.time() - began:.1f} seconds")
    return rid


def search_row(store: Store, rid: str) -> dict:
    row = store.find("searches", results_id=rid).first() if store.exists("searches") else None
    if row is None:
        raise ValueError(f"no search {rid!r}")
    d = row.asDict(recursive=True)
    return d | {"parameters": json.loads(d["parameters"])}


def progress(store: Store, rid: str) -> tuple[str, str, list[dict]]:
    """(status, message, stages with how far they are)."""
    row = search_row(store, rid)
    return row["status"], row["msg"], row["progress"]


# retrieval


def results(store: Store, rid: str, sort_by: str | None = None, order: str | None = None, per_page: int | None = None, number: int | None = None) -> DataFrame:
    """Matches with units, tags and snippets of both sides: all of them, or a page."""
    p = search_row(store, rid)["parameters"]
    found = store.find("matches", search_id=rid)
    names = store.read("texts").select("text_id", "author", "title")
    for prefix, side, text in (("t", "target", p["target"]), ("s", "source", p["source"])):
        u = L.unit_tokens(store, text, p["unit_type"]).filter("pos = 0").select("unit", "tags", "snippet", "text_id").join(F.broadcast(names.filter(F.col("text_id") == text)), "text_id")
        u = u.select(F.col("unit").alias(f"{side}_unit"), display_tag(F.col("author"), F.col("title"), F.col("tags")).alias(f"{side}_tag"), F.col("snippet").alias(f"{side}_snippet"))
        found = found.withColumnRenamed(f"{prefix}_unit", f"{side}_unit").join(u, f"{side}_unit")
    return R.page(found.withColumn("matched_features", F.col("features")), sort_by, order, per_page, number, ("target_unit", "source_unit"))


def top(store: Store, rid: str, n: int = 10) -> DataFrame:
    """The n best matches, for display."""
    return results(store, rid, "score", "descending", n, 0)


def _export(store: Store, rid: str, path: str, file_format: str, delimiter: str | None = None) -> None:
    row = search_row(store, rid)
    p = row["parameters"]
    ranked = R.ranked(results(store, rid), ("target_unit", "source_unit"))
    exports.export(ranked, path, file_format, row | {"status": "Done"}, L.text_row(store, p["source"]), L.text_row(store, p["target"]), delimiter)


def export(store: Store, rid: str, path: str, file_format: str = "csv", delimiter: str | None = None) -> None:
    """Write a search's results to one file. RuntimeError if it isn't Done."""
    row = search_row(store, rid)
    if file_format not in exports.FORMATS:
        raise ValueError(f"unknown format {file_format!r}")
    if row["status"] != "Done":
        raise RuntimeError(f"the search is {row['status']}")
    _export(store, rid, path, file_format, delimiter)


def clean_cache(store: Store, days: int = 7) -> None:
    """Drop searches that were last queried more than some days ago, with their results."""
    if store.exists("searches"):
        store.remove_searches(store.read("searches").filter(older_than(F.col("last_queried"), days)).select("results_id"))


def obliterate(store: Store) -> None:
    """Drop all searches with their results."""
    if store.exists("searches"):
        store.remove_searches(store.read("searches").select("results_id"))


# multi-text searches


@dataclass
class MultiParams:
    """A multi-text search: the pairs of features of a finished search's matches, in other texts."""
    parallels: str
    texts: list[str]
    unit_type: str = "line"
    top: int | None = None
    method: str = "multitext"

    def canonical(self) -> str:
        return json.dumps(asdict(self) | {"texts": sorted(set(self.texts))}, sort_keys=True)

    def key(self) -> str:
        return hashlib.sha256(self.canonical().encode()).hexdigest()


def submit_multitext(store: Store, p: MultiParams) -> str:
    """Look the pairs up in the texts' stored bigrams (phrases of prose), or return the cached search."""
    if old := cached(store, p):
        return old
    start = search_row(store, p.parallels)
    if start["status"] != "Done":
        raise RuntimeError(f"the search is {start['status']}")
    rid, began = uuid.uuid4().hex, time.time()
    state = Progress(store, rid, p, text_ids=sorted(set(p.texts)), parallels_id=p.parallels)
    state.note("Running", "")
    try:
        state.stage("lookup")
        feature = "lemmata" if start["search_type"] == "greek_to_latin" else start["parameters"]["feature"]
        texts = store.find("texts", text_id=p.texts).select("text_id", "is_prose")
        held = U.of_unit_types(store.find("bigrams", text_id=p.texts, feature=feature), texts, p.unit_type)
        found = U.multitext(store.find("matches", search_id=p.parallels), held, p.top).filter("unit is not null")
        state.stage("save")
        store.insert("multiresults", found.withColumn("search_id", F.lit(rid)), check=False)
        state.stages = [(s, 1.0) for s, _ in state.stages]
    except Exception:
        state.note("Failed", traceback.format_exc()[-2000:])
        raise
    state.note("Done", f"Done in {time.time() - began:.1f} seconds")
    return rid


def multitext_results(store: Store, rid: str, sort_by: str | None = None, order: str | None = None, per_page: int | None = None, number: int | None = None) -> DataFrame:
    """The matches of the first search, or a page of them, each with `cross_references`: pairs of features, with the tags and scores
    of the units that hold them. Matches without one have an empty array."""
    search = search_row(store, rid)
    p = search["parameters"]
    held = store.find("multiresults", search_id=rid)
    names = store.read("texts").select("text_id", "author", "title", F.when(F.col("is_prose"), "phrase").otherwise(p["unit_type"]).alias("unit_type"))
    tags = store.find("units", text_id=p["texts"]).filter("pos = 0").join(F.broadcast(names), ["text_id", "unit_type"])
    tags = tags.select("text_id", "unit", display_tag(F.col("author"), F.col("title"), F.col("tags")).alias("tag"), "snippet")
    each = held.join(tags, ["text_id", "unit"]).groupBy("match_id", "w1", "w2").agg(F.array_sort(F.collect_list(F.struct("place", "tag", "snippet", "score"))).alias("units"))
    lists = each.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("w1", "w2", "units"))).alias("cross_references"))
    found = results(store, p["parallels"], sort_by, order, per_page, number).join(lists, "match_id", "left")
    return found.withColumn("cross_references", F.coalesce("cross_references", F.array().cast(lists.schema["cross_references"].dataType.simpleString())))
