"""Column functions on text: normalisation, tokens, trigrams, natural order, tags, highlighting."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs that the highlighter treats as separators, and the other runs (the words).
SEPARATOR = r"[\s\d.!,;?\-&]+"
PIECE = r"[\s\d.!,;?\-&]+|[^\s\d.!,;?\-&]+"


def _nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def nfkd(text: Column) -> Column:
    """Compatibility decomposition; the only normalisation step that Spark has no builtin for."""
    return F.pandas_udf(_nfkd, "string")(text)


def tag_of(line: Column) -> Column:
    """Locus of a tagged line: the last blank-separated part of `<...>`; null without a tag."""
    inner = F.regexp_extract(line, r"^\s*<([^>]+)>", 1)
    return F.when(inner != "", F.element_at(F.split(F.trim(inner), " "), -1))


def untagged(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s*<[^>]*>\s*", "")


def is_tagged(line: Column) -> Column:
    return F.coalesce(F.ltrim(line).rlike("^<.*>"), F.lit(False))


def words(text: Column, pattern: str = r"\p{L}+") -> Column:
    """Lower-case words of a text; null has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def trigrams(word: Column) -> Column:
    """Overlapping three-character pieces of the word characters; none below three."""
    w = F.regexp_replace(word, r"(?U)\W", "")
    spots = F.filter(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.length(w) >= 3)
    return F.transform(spots, lambda i: F.substring(w, i, F.lit(3)))


def natural_key(text: Column) -> Column:
    """A sort key under which runs of digits compare as numbers: a run is led by its length without leading zeros."""
    runs = F.regexp_extract_all(text, F.lit(r"\d+|\D+"), F.lit(0))

    def key(run: Column) -> Column:
        digits = F.regexp_replace(run, r"^0+(?=\d)", "")
        return F.when(run.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 9, "0"), digits)).otherwise(run)

    return F.array_join(F.transform(runs, key), "")


def display_tag(author: Column, title: Column, tags: Column) -> Column:
    """`author title locus`, empty parts skipped."""
    empty = lambda c: F.when(c != "", c)
    return F.concat_ws(" ", empty(author), empty(title), empty(F.get(tags, 0)))


def highlight(snippet: Column, positions: Column, before: str = "**", after: str = "**") -> Column:
    """Wrap the words at the given positions (from 0) with markup; separators stay."""
    pieces = F.regexp_extract_all(snippet, F.lit(PIECE), F.lit(0))
    is_word = lambda p: ~p.rlike(f"^{SEPARATOR}$")
    state = F.aggregate(
        pieces, F.struct(F.lit(0).alias("n"), F.lit("").alias("out")),
        lambda s, p: F.when(is_word(p), F.struct((s["n"] + 1).alias("n"), F.concat(
            s["out"], F.when(F.array_contains(positions, s["n"]), F.concat(F.lit(before), p, F.lit(after))).otherwise(p)).alias("out"))).otherwise(
            F.struct(s["n"].alias("n"), F.concat(s["out"], p).alias("out"))))
    return state["out"]


def file_title(title: Column) -> Column:
    """A title in a file's name: lower case, spaces as underscores."""
    return F.regexp_replace(F.lower(title), " ", "_")


def pairs_of(items: Column) -> Column:
    """All two-element combinations of an array, in its order."""
    n = F.size(items)
    firsts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n - 1)
    return F.flatten(F.transform(firsts, lambda i: F.transform(F.slice(items, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda y: F.struct(F.get(items, i).alias("w1"), y.alias("w2")))))
