"""The corpus: ingest of tagged files, the registry of features, dictionaries, bigrams, metadata, removal."""

from __future__ import annotations

import datetime
import hashlib
import traceback

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import frequency as Q
from ..operators import multitext as U
from ..operators import units
from ..operators.tokenizers import tokenizer
from ..sources import exports, tess
from ..sources.scratch import sized, written
from ..sources.store import Store

TEXTS = ("text_id string, title string, author string, language string, year int, is_prose boolean, path string, hash string, divisions array<string>, status string, msg string,"
         " details map<string, string>, extras map<string, string>")
#: Features that every text gets; others need a dictionary or are added later.
BASIC = ("form", "sound")
BIGRAM_FEATURES = ("form", "lemmata")


def text_key(language: str, title: str, author: str) -> str:
    return hashlib.md5(f"{language}/{title}/{author}".encode()).hexdigest()


def text_row(store: Store, text_id: str) -> dict:
    row = store.find("texts", text_id=text_id).first() if store.exists("texts") else None
    if row is None:
        raise ValueError(f"no text {text_id!r}")
    return row.asDict(recursive=True)


def find_texts(store: Store, **wanted) -> DataFrame:
    """Texts by title, author, language or other fields."""
    return store.find("texts", sort=["language", "author", "title"], **wanted)


def _note(store: Store, row: dict) -> None:
    store.put("texts", [row], TEXTS)


def note(store: Store, text_id: str, key: str, status: str) -> None:
    """The state of a step of a text's ingestion, kept in `details`."""
    row = text_row(store, text_id)
    _note(store, row | {"details": (row["details"] or {}) | {key: status}})


def ingest(store: Store, path: str, title: str, author: str, language: str, is_prose: bool = False, year: int | None = None, multitext: bool = False, **extras: str) -> str:
    """Read a tagged file into texts, tokens, units, features and, if asked, bigrams; the text's id.

    ValueError if it is there already, if the language is unknown, or if the file can't be read; what was written of a failed
    ingest is removed, and the text is left as Failed with the traceback."""
    tokenizer(language)
    text_id = text_key(language, title, author)
    if store.exists("texts") and not store.find("texts", text_id=text_id, status=["Done", "Running"]).isEmpty():
        raise ValueError("already ingested")
    row = {"text_id": text_id, "title": title, "author": author, "language": language, "year": year, "is_prose": is_prose, "path": path, "hash": None, "divisions": [],
           "status": "Running", "msg": str(datetime.datetime.now()), "details": {}, "extras": extras}
    _note(store, row)
    try:
        file = tess.read_files(store.spark, path).select("hash").first()
        lines = tess.read_lines(store.spark, path).select(F.lit(text_id).alias("text_id"), F.lit(language).alias("language"), "line_no", "tag", "line")
        lines = written(lines)
        if lines.isEmpty():
            raise ValueError("the file has no tagged line")
        store.insert("tokens", units.tagged_tokens(lines), check=False)
        store.insert("units", units.tagged_units(lines), check=False)
        divisions = units.divisions(lines.select("text_id", "tag")).first()
        dictionary = store.exists("dictionary")
        for feature in (*BASIC, *(("lemmata",) if dictionary and not store.find("dictionary", kind="lemmata", language=language).isEmpty() else ())):
            register(store, text_id, language, feature)
        if multitext:
            register_bigrams(store, text_id)
        done = text_row(store, text_id)
        _note(store, done | {"hash": file and file[0], "divisions": divisions[1] if divisions else [], "status": "Done", "msg": f"since {row['msg']}"})
    except Exception as e:
        for table in ("tokens", "units", "feature_freq", "bigrams"):
            if store.exists(table):
                store.delete(table, text_id=text_id)
        _note(store, row | {"status": "Failed", "msg": traceback.format_exc()[-2000:]})
        raise ValueError(f"{path} was not ingested: {e}") from e
    return text_id


def reingest(store: Store, text_id: str, multitext: bool = False) -> str:
    """Remove a text with all that hangs on it and read its file again."""
    row = text_row(store, text_id)
    store.remove_text(text_id)
    return ingest(store, row["path"], row["title"], row["author"], row["language"], row["is_prose"], row["year"], multitext, **(row["extras"] or {}))


def ingest_manifest(store: Store, path: str, multitext: bool = False) -> list[str]:
    """Ingest the texts of a JSON list; those that are there already are passed over."""
    done = []
    for r in exports.read_manifest(store.spark, path).collect():  # a list of files
        if not store.exists("texts") or store.find("texts", text_id=text_key(r.language, r.title, r.author), status="Done").isEmpty():
            done.append(ingest(store, r.path, r.title, r.author, r.language, bool(r.is_prose), r.year, multitext))
    return done


def reingest_manifest(store: Store, path: str, multitext: bool = False) -> list[str]:
    """Ingest again the texts of a TSV of authors and titles."""
    found = exports.read_names(store.spark, path).join(store.read("texts"), ["author", "title"]).select("text_id").collect()  # a list of files
    return [reingest(store, r[0], multitext) for r in found]


def update_metadata(store: Store, path: str) -> int:
    """Set the fields of texts named by a JSON list with `_id`; ValueError for an unknown id. Unknown fields go into extras."""
    changes = exports.read_updates(store.spark, path).collect()  # a list of changes
    known = set(store.read("texts").columns)
    for change in changes:
        d = {k: v for k, v in change.asDict(recursive=True).items() if v is not None}
        row = text_row(store, d.pop("text_id"))
        extras = (row["extras"] or {}) | {k: str(v) for k, v in d.items() if k not in known}
        changed = row | {k: v for k, v in d.items() if k in known} | {"extras": extras}
        _note(store, changed)
    return len(changes)


# features


def load_dictionary(store: Store, kind: str, language: str, path: str, value_language: str | None = None) -> int:
    """Add the edges of a CSV to the dictionary `kind` (lemmata, synonyms, translations) of a language; the number of edges."""
    edges = exports.read_dictionary(store.spark, path, language, "key", "value", value_language)
    return add_dictionary(store, kind, language, edges)


def add_dictionary(store: Store, kind: str, language: str, edges: DataFrame) -> int:
    """edges(key, value); they replace those of the same kind and language."""
    rows = written(edges.select(F.lit(kind).alias("kind"), F.lit(language).alias("language"), "key", "value").distinct())
    if store.exists("dictionary"):
        store.delete("dictionary", kind=kind, language=language)
    store.insert("dictionary", rows, check=False)
    return rows.count()


def dictionary(store: Store, kind: str, language: str) -> DataFrame:
    """(key, value) of a dictionary; ValueError if there is none."""
    if store.exists("dictionary"):
        found = store.find("dictionary", kind=kind, language=language).select("key", "value")
        if not found.isEmpty():
            return found
    raise ValueError(f"no {kind} of {language}")


def featurized(store: Store, tokens: DataFrame, language: str, feature: str) -> DataFrame:
    """tokens(..., form) with `features`; lemmata and synonyms come from the store's dictionaries."""
    tables = []
    if feature in ("lemmata", "semantic", "semantic + lemmata"):
        tables.append(dictionary(store, "lemmata", language).select(F.col("key").alias("form"), F.col("value").alias("lemma")))
    if feature.startswith("semantic"):
        tables.append(dictionary(store, "synonyms", language).select(F.col("key").alias("lemma"), F.col("value").alias("synonym")))
    return tokenizer(language).featurize(tokens, feature, *map(sized, tables))


def register(store: Store, text_id: str, language: str, feature: str) -> None:
    """Count a feature in a text and give new tokens an index. Forms are featurized once each and joined back by their counts."""
    tokens = store.find("tokens", text_id=text_id).filter("form is not null")
    forms = written(tokens.groupBy("form").agg(F.count(F.lit(1)).alias("k"), F.min("index").alias("at")))
    each = featurized(store, forms, language, feature).select("k", "at", F.explode("features").alias("token"))
    counts = each.groupBy("token").agg(F.sum("k").alias("n"), F.min("at").alias("at"))
    rows = written(counts.select(F.lit(language).alias("language"), F.lit(feature).alias("feature"), "token", F.lit(text_id).alias("text_id"), "n", "at"))
    known = store.read("features").filter((F.col("language") == language) & (F.col("feature") == feature)) if store.exists("features") else None
    store.insert("features", written(Q.registered(rows, known)), check=False)
    if store.exists("feature_freq"):
        store.delete("feature_freq", language=language, feature=feature, text_id=text_id)
    store.insert("feature_freq", rows.drop("at"), check=False)
    note(store, text_id, f"feature {feature}", "Done")


def add_feature(store: Store, text_id: str, feature: str, multitext: bool = False) -> None:
    """Register a feature of a text that was ingested without it. Nothing of the text is written anew."""
    if multitext:
        raise NotImplementedError("bigrams of an added feature")
    row = text_row(store, text_id)
    note(store, text_id, f"feature {feature}", "Running")
    try:
        register(store, text_id, row["language"], feature)
    except Exception:
        note(store, text_id, f"feature {feature}", "Failed")
        raise


def register_features(store: Store, language: str, feature: str, candidates: DataFrame) -> int:
    """Give the tokens of candidates(token) that are not there an index, going on from the count; how many were new."""
    rows = candidates.filter("token is not null").select(F.lit(language).alias("language"), F.lit(feature).alias("feature"), "token", F.lit("").alias("text_id"), F.lit(0).alias("at"))
    known = store.read("features").filter((F.col("language") == language) & (F.col("feature") == feature)) if store.exists("features") else None
    new = written(Q.registered(rows, known))
    store.insert("features", new, check=False)
    return new.count()


def setup(store: Store) -> dict[str, int]:
    """Register the lemmata of the dictionaries."""
    if not store.exists("dictionary"):
        return {}
    languages = [r[0] for r in store.find("dictionary", kind="lemmata").select("language").distinct().collect()]
    return {x: register_features(store, x, "lemmata", dictionary(store, "lemmata", x).select(F.col("value").alias("token")).distinct()) for x in languages}


def frequencies(store: Store, language: str, feature: str, texts: list[str] | None = None) -> DataFrame:
    """(feature, n): stored counts of a language's feature, of all texts or of some; only their folders are read."""
    wanted = {"language": language, "feature": feature} | ({"text_id": texts} if texts else {})
    return store.find("feature_freq", **wanted).groupBy(F.col("token").alias("feature")).agg(F.sum("n").alias("n"))


# units and bigrams


def unit_tokens(store: Store, text_id: str, unit_type: str) -> DataFrame:
    return store.find("units", text_id=text_id, unit_type=unit_type)


def text_inverse(store: Store, text_id: str, language: str, feature: str) -> DataFrame:
    """(form, inv) of a text, from its lines whatever the searched units."""
    lines = unit_tokens(store, text_id, "line")
    if feature == "form":
        return Q.inverse_frequencies(lines)
    return Q.inverse_cofeature_frequencies(featurized(store, lines, language, feature))


def register_bigrams(store: Store, text_id: str, features: tuple[str, ...] = BIGRAM_FEATURES) -> None:
    """Bigrams of a text's phrases and, in verse, lines. A feature without its dictionary is passed over."""
    row = text_row(store, text_id)
    for feature in features:
        try:
            inv = written(text_inverse(store, text_id, row["language"], feature))
        except ValueError:
            continue
        for kind in ("phrase",) if row["is_prose"] else ("phrase", "line"):
            tokens = X.exploded(featurized(store, unit_tokens(store, text_id, kind), row["language"], feature)).join(sized(inv), "form")
            found = U.bigrams(tokens).withColumns({"unit_type": F.lit(kind), "feature": F.lit(feature)})
            if store.exists("bigrams"):
                store.delete("bigrams", text_id=text_id, unit_type=kind, feature=feature)
            store.insert("bigrams", found, check=False)
    note(store, text_id, "multitext", "Done")


def unregister_bigrams(store: Store, text_id: str) -> None:
    if store.exists("bigrams"):
        store.delete("bigrams", text_id=text_id)
