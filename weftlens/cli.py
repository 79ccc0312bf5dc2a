"""Command line over the library: `python -m weftlens.cli --store FOLDER COMMAND ...`."""

from __future__ import annotations

import argparse
import logging
import sys

from .operators.tokenizers import TOKENIZERS

COMMANDS = {}


def command(name: str, *arguments: tuple):
    """Register a function (store, args) with its arguments, each (names, options)."""
    def add(f):
        COMMANDS[name] = (f, arguments)
        return f
    return add


def _arg(*names: str, **options) -> tuple:
    return names, options


@command("ingest", _arg("path"), _arg("title"), _arg("author"), _arg("language", choices=list(TOKENIZERS)), _arg("--year", type=int), _arg("--prose", action="store_true"), _arg("--multitext", action="store_true"))
def ingest(store, a):
    """Read a tagged file."""
    from .plans import library

    print(library.ingest(store, a.path, a.title, a.author, a.language, a.prose, a.year, a.multitext))


@command("search", _arg("source_language"), _arg("source_author"), _arg("source_title"), _arg("target_language"), _arg("target_author"), _arg("target_title"), _arg("--unit", choices=["line", "phrase"], default="line"),
         _arg("--feature", default="form"), _arg("--stopwords", default="10", help="a number, a stored list's name, or words separated by commas"), _arg("--stopword-basis", choices=["corpus", "texts"], default="corpus"),
         _arg("--freq-basis", choices=["texts", "corpus"], default="texts"), _arg("--max-distance", type=int, default=10), _arg("--distance", choices=["frequency", "span"], default="frequency"),
         _arg("--min-score", type=float, default=6.0), _arg("--method", default="original"), _arg("--far-stopwords", default=""), _arg("--output"))
def search(store, a):
    """Match two texts, print the ten best matches, and write all to --output. Underscores stand for spaces in names."""
    from .plans import library
    from .plans import search as S

    ids = [library.text_key(la, t.replace("_", " "), au.replace("_", " ")) for la, au, t in ((a.source_language, a.source_author, a.source_title), (a.target_language, a.target_author, a.target_title))]
    stop = int(a.stopwords) if a.stopwords.isdigit() else [w for w in a.stopwords.split(",") if w] if "," in a.stopwords else a.stopwords
    p = S.Params(*ids, a.unit, a.feature, stop, a.stopword_basis, None, a.freq_basis, a.max_distance, a.distance, a.min_score, a.method, [w for w in a.far_stopwords.split(",") if w])
    rid = S.submit(store, p)
    print(rid)
    for r in S.top(store, rid).collect():
        print(f"{r.score:.3f}\t{r.target_tag}\t{r.source_tag}\t{', '.join(r.features)}")
    if a.output:
        S.export(store, rid, a.output, "tsv")


@command("export", _arg("search"), _arg("path"), _arg("--format", choices=["csv", "tsv", "json", "xml"], default="csv"), _arg("--delimiter"))
def export(store, a):
    """Write a search's results."""
    from .plans import search as S

    S.export(store, a.search, a.path, a.format, a.delimiter)


@command("delete", _arg("text_id"))
def delete(store, a):
    """Remove a text and all that hangs on it."""
    from .plans import library

    library.text_row(store, a.text_id)
    store.remove_text(a.text_id)


@command("find", _arg("--title"), _arg("--author"), _arg("--language"))
def find(store, a):
    """List texts."""
    from .plans import library

    for r in library.find_texts(store, title=a.title, author=a.author, language=a.language).collect():
        print(f"{r.text_id}\t{r.language}\t{r.author}\t{r.title}\t{r.status}")


@command("update", _arg("manifest"))
def update(store, a):
    """Change texts' metadata by a JSON list with `_id`."""
    from .plans import library

    print(library.update_metadata(store, a.manifest))


@command("index", _arg("--keep", type=int, default=2))
def index(store, a):
    """Remove files that are no longer part of a table; the layout of the tables stands in for indexes."""
    print(store.vacuum(a.keep))


@command("setup", _arg("--lemmata", nargs=2, action="append", default=[], metavar=("LANGUAGE", "CSV")), _arg("--synonyms", nargs=2, action="append", default=[], metavar=("LANGUAGE", "CSV")),
         _arg("--translations", help="CSV of Greek words with Latin translations"))
def setup(store, a):
    """Load dictionaries and register their lemmata."""
    from .plans import library

    for kind, rows in (("lemmata", a.lemmata), ("synonyms", a.synonyms)):
        for language, path in rows:
            library.load_dictionary(store, kind, language, path)
    if a.translations:
        library.load_dictionary(store, "translations", "greek", a.translations, "latin")
    print(library.setup(store))


@command("cleancache", _arg("--days", type=int, default=7))
def cleancache(store, a):
    """Drop searches that nobody has asked for."""
    from .plans import search as S

    S.clean_cache(store, a.days)


@command("mass-ingest", _arg("manifest"), _arg("--multitext", action="store_true"))
def mass_ingest(store, a):
    """Ingest the texts of a JSON list."""
    from .plans import library

    print(*library.ingest_manifest(store, a.manifest, a.multitext), sep="\n")


@command("mass-reingest", _arg("manifest"), _arg("--multitext", action="store_true"))
def mass_reingest(store, a):
    """Ingest again the texts of a TSV of authors and titles."""
    from .plans import library

    print(*library.reingest_manifest(store, a.manifest, a.multitext), sep="\n")


@command("mass-add-feature", _arg("feature"), _arg("--language"))
def mass_add_feature(store, a):
    """Add a feature to all texts, or those of a language."""
    from .plans import library

    for r in library.find_texts(store, status="Done", language=a.language).collect():
        library.add_feature(store, r.text_id, a.feature)


@command("add-multitext", _arg("--language"))
def add_multitext(store, a):
    """Make the bigrams of texts that have none."""
    from .plans import library

    for r in library.find_texts(store, status="Done", language=a.language).collect():
        if "multitext" not in (r.details or {}):
            library.register_bigrams(store, r.text_id)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftlens", description=__doc__)
    p.add_argument("--store", required=True, help="folder of the tables")
    p.add_argument("--log", default="WARNING", help="logging level")
    subs = p.add_subparsers(dest="command", required=True)
    for name, (f, arguments) in COMMANDS.items():
        sub = subs.add_parser(name, help=f.__doc__, description=f.__doc__)
        for names, options in arguments:
            sub.add_argument(*names, **options)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=a.log.upper())
    from pyspark.sql import SparkSession

    from .sources.store import Store

    try:
        COMMANDS[a.command][0](Store(spark or SparkSession.builder.appName("weftlens").getOrCreate(), a.store), a)
    except (ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
