"""Units: lines and phrases of texts, simple (plain text, builtins) and exact (tagged text, one pass over its tokens)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import dropwhile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .tokenizers import LINE_END, Display, tokenizer

#: (text_id, unit_type, unit, pos, display, form, tags, snippet)
UNIT_TOKENS = "text_id string, unit_type string, unit int, pos int, token_index int, display string, form string, tags array<string>, snippet string"
PHRASE_END = re.compile("[.?!;:]")


def plain_units(texts: DataFrame, id_col: str, text_col: str, by: str = "line") -> DataFrame:
    """(id, unit, snippet): the pieces between newlines, or between runs of `.?!;:` and newlines; blank pieces are skipped."""
    parts = F.split(F.col(text_col), "\n" if by == "line" else r"[.?!;:\n]+")
    out = texts.select(F.col(id_col), F.posexplode(parts).alias("unit", "snippet"))
    return out.filter(F.trim("snippet") != "")


def token_positions(units: DataFrame, id_col: str, pattern: str = r"\p{L}+") -> DataFrame:
    """(id, unit, pos, form): the words of each unit."""
    return units.select(id_col, "unit", F.posexplode(X.words(F.col("snippet"), pattern)).alias("pos", "form"))


def trigram_positions(units: DataFrame, id_col: str, pattern: str = r"\p{L}+") -> DataFrame:
    """(id, unit, idx, pos, feature): the sound trigrams of each unit, idx among all of the unit, pos that of their word. A unit is a
    row, so numbering them needs no shuffle."""
    of_word = lambda w, i: F.transform(X.trigrams(w), lambda g: F.struct(i.alias("pos"), g.alias("feature")))
    every = F.flatten(F.transform(X.words(F.col("snippet"), pattern), of_word))
    return units.select(id_col, "unit", F.posexplode(every).alias("idx", "_g")).select(id_col, "unit", "idx", "_g.pos", "_g.feature")


@dataclass
class Unit:
    tags: list[str]
    tokens: list[tuple[int, str, str | None]] = field(default_factory=list)  # index in the text, display, form
    pieces: list[str] = field(default_factory=list)

    def snippet(self) -> str:
        """What is shown: from the first piece with a word character on."""
        shown = list(dropwhile(lambda p: not re.search(r"\w", p), self.pieces))
        return "".join(shown)


def unitize(tokens: list[Display], tags: list[str]) -> tuple[list[Unit], list[Unit]]:
    """(lines, phrases) of a text's display tokens.

    A phrase ends after a piece with one of `.?!;:` once it has a token, or at a blank line; the pieces without a word that
    follow its end are not shown. A unit that spans lines has all their tags. Trailing units of less than two tokens are
    dropped, short ones inside stay."""
    lines: list[Unit] = []
    phrases: list[Unit] = []
    at, after_end = 0, False
    line, phrase = Unit(tags[:1]), Unit(tags[:1])
    for i, t in enumerate(tokens):
        ends = LINE_END in t.text
        phrase.pieces.append(t.text)
        if not ends:
            line.pieces.append(t.text)
        if t.word:
            lone = phrases and not phrase.tokens and not re.search(r"\w", t.text)  # a lone mark after a phrase's end
            for u in (line, phrases[-1] if lone else phrase):
                u.tokens.append((i, t.text, t.form))
        if PHRASE_END.search(t.text) and phrase.tokens:
            phrases.append(phrase)
            phrase = Unit(tags[at:at + 1])
        if ends:
            if not phrase.tokens:
                phrase.tags.clear()
            elif after_end:  # a blank line
                phrase.pieces.pop()
                phrases.append(phrase)
                phrase = Unit([])
            if line.tokens:
                lines.append(line)
                at += 1
            line = Unit(tags[at:at + 1])
            phrase.tags += [x for x in tags[at:at + 1] if x not in phrase.tags]
        after_end = ends
    for unit, done in ((line, lines), (phrase, phrases)):
        if unit.tokens:
            done.append(unit)
        while done and len(done[-1].tokens) < 2:
            done.pop()
    return lines, phrases


def unit_rows(raw: str, language: str) -> Iterator[tuple]:
    """(unit_type, unit, pos, token_index, display, form, tags, snippet) of a tagged text."""
    for kind, units in zip(("line", "phrase"), unitize(*tokenizer(language).tokenize(raw)), strict=True):
        for k, u in enumerate(units):
            shown = "".join(u.pieces) if kind == "line" else u.snippet()
            yield from ((kind, k, p, i, d, f, u.tags, shown) for p, (i, d, f) in enumerate(u.tokens))


def tagged_units(lines: DataFrame) -> DataFrame:
    """lines(text_id, language, line_no, line) to UNIT_TOKENS; one text is one group, as its units follow from one another.

    A group is a text, so a task holds one text at a time; it can be no smaller than the longest text."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = unit_rows("\n".join(pdf.sort_values("line_no")["line"]), pdf["language"].iloc[0])
        out = pd.DataFrame(rows, columns=["unit_type", "unit", "pos", "token_index", "display", "form", "tags", "snippet"])
        return out.assign(text_id=pdf["text_id"].iloc[0])[["text_id", "unit_type", "unit", "pos", "token_index", "display", "form", "tags", "snippet"]]

    return lines.groupBy("text_id").applyInPandas(one, UNIT_TOKENS)


TOKENS = "text_id string, index int, display string, word boolean, form string"


def tagged_tokens(lines: DataFrame) -> DataFrame:
    """lines(text_id, language, line_no, line) to TOKENS: every display token of a text, in order."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, _ = tokenizer(pdf["language"].iloc[0]).tokenize("\n".join(pdf.sort_values("line_no")["line"]))
        out = pd.DataFrame([(i, t.text, t.word, t.form) for i, t in enumerate(tokens)], columns=["index", "display", "word", "form"])
        return out.assign(text_id=pdf["text_id"].iloc[0])[["text_id", "index", "display", "word", "form"]]

    return lines.groupBy("text_id").applyInPandas(one, TOKENS)


def nested_units(tokens: DataFrame) -> DataFrame:
    """Flat unit tokens to one row a unit: (text_id, unit_type, unit, tags, snippet, tokens), tokens in order, and `forms`."""
    each = F.struct("pos", "token_index", "display", "form", *[c for c in ("features",) if c in tokens.columns])
    out = tokens.groupBy("text_id", "unit_type", "unit").agg(F.first("tags").alias("tags"), F.first("snippet").alias("snippet"), F.array_sort(F.collect_list(each)).alias("tokens"))
    return out.withColumn("forms", F.transform("tokens", lambda t: t["form"]))


def plain_nested_units(units: DataFrame, id_col: str, pattern: str = r"\p{L}+") -> DataFrame:
    """plain_units() to one row a unit that has words: (id, unit, snippet, tokens, forms). A unit is a row already, so nothing is shuffled."""
    forms = units.withColumn("forms", X.words(F.col("snippet"), pattern)).filter(F.size("forms") > 0)
    token = lambda w, i: F.struct(i.alias("pos"), i.alias("token_index"), w.alias("display"), w.alias("form"))
    return forms.select(id_col, "unit", "snippet", F.transform("forms", token).alias("tokens"), "forms")


def divisions(tags: DataFrame) -> DataFrame:
    """tags(text_id, tag) to (text_id, divisions): what stands before the first dot, in natural order."""
    part = F.split("tag", "[.]")
    heads = tags.filter(F.size(part) >= 2).select("text_id", F.get(part, F.lit(0)).alias("division")).distinct()
    keyed = F.sort_array(F.collect_list(F.struct(X.natural_key(F.col("division")).alias("k"), "division")))
    return heads.groupBy("text_id").agg(F.transform(keyed, lambda x: x["division"]).alias("divisions"))
