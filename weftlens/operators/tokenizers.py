"""Tokenizers of the languages: normal forms, display tokens, tags and features. A new language is a subclass and a registry entry.

A tagged text is read as a whole, since a mark may belong to the word after it. Display tokens keep every character of the lines;
each is a word with a form, a word without one (digits, lone marks, another script) or a delimiter."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame

from . import features as X

#: Combining marks. The character range and the patterns of the languages below decide the tokens.
MARKS = "̀-ͯ"
TAG = re.compile(r"<[^>]+>")
LINE_END = " / "


@dataclass(frozen=True)
class Display:
    text: str
    word: bool
    form: str | None


class Tokenizer:
    """The language-neutral rules; languages set the patterns and `fold`."""

    language = ""
    delimiter = re.compile(rf"( / )|(\s+)|([^\w{MARKS}]+)")
    letters = re.compile("[a-zA-Z]+")
    features: tuple[str, ...] = ("form", "sound", "test")

    def fold(self, text: str) -> str:
        """What the language changes in decomposed lower-case text."""
        return text

    def finish(self, token: str) -> str:
        """What the language changes in a single form."""
        return token

    def is_form(self, token: str) -> bool:
        return bool(self.letters.search(token))

    def normalize(self, raw: str | list[str], split: bool = True) -> tuple[list[str] | str, list[str]]:
        """(forms, or the normal text if not split; tags). Tags, line marks and digits go; lines are stripped."""
        raw = " ".join(raw) if isinstance(raw, list) else raw
        tags = TAG.findall(raw)
        plain = re.sub(r"\d+", "", re.sub(rf"{TAG.pattern}[ \t]*", "", raw).replace("/", " "))
        plain = "".join(f"{line.strip()}\n" for line in plain.split("\n"))
        text = self.fold(unicodedata.normalize("NFKD", plain).lower())
        if not split:
            return text, tags
        return [self.finish(t) for t in self.delimiter.split(text) if t and not self.delimiter.fullmatch(t) and self.is_form(t)], tags

    def display(self, lines: list[str]) -> list[str]:
        """The pieces of the lines' texts, delimiters kept; a line ends with ` / `."""
        text = "".join(f"{re.sub(rf'^{TAG.pattern}[ \t]*', '', line.strip()).replace('/', ' ').strip()}{LINE_END}" for line in lines)
        return [t for t in self.delimiter.split(text + LINE_END) if t]

    def tokenize(self, raw: str) -> tuple[list[Display], list[str]]:
        """Display tokens with their forms, and the locus of each tagged line. Lines without a tag drop out.

        Forms are dealt to the words in order. If their numbers differ, each word is normalised alone."""
        lines = [line for line in raw.split("\n") if line.strip().startswith("<") and ">" in line]
        forms, tags = self.normalize("\n".join(lines) + "\n")
        pieces = self.display(lines)
        lone = re.compile(rf"[\d{MARKS}]+")
        words = [not lone.fullmatch(p) and not self.delimiter.search(p) for p in pieces]
        named = [w and self.is_form(p) or w and self.is_form(unicodedata.normalize("NFKD", p).lower()) for p, w in zip(pieces, words, strict=True)]
        if sum(named) != len(forms):
            forms = [(self.normalize(p)[0] or [None])[0] for p, n in zip(pieces, named, strict=True) if n]
        rest = iter(forms)
        out = [Display(p, bool(w or lone.fullmatch(p)), next(rest) if n else None) for p, w, n in zip(pieces, words, named, strict=True)]
        return out, [t[1:-1].split()[-1] for t in tags if t[1:-1].split()]

    def featurize(self, tokens: DataFrame, feature: str, *tables: DataFrame) -> DataFrame:
        """tokens(..., form) with `features`."""
        if feature not in self.features:
            raise ValueError(f"no feature {feature!r} in {self.language}")
        return X.featurize(tokens, feature, *tables)


class Latin(Tokenizer):
    language = "latin"
    features = ("form", "sound", "test", "lemmata", "semantic", "semantic + lemmata")

    def fold(self, text: str) -> str:
        return text.translate(str.maketrans("jJvV", "iIuU"))


class Greek(Tokenizer):
    language = "greek"
    features = Latin.features
    delimiter = re.compile(rf"( / )|(\s+)|([^\w\d{MARKS}ς])")
    letters = re.compile("[ΆΈ-ώς]+")
    vowels = "αειηουωΑΕΙΗΟΥΩ"

    def fold(self, text: str) -> str:
        """Grave as acute; marks before a word's first vowels go, or follow a single one; elision marks and digits go."""
        text = text.replace("̀", "́")

        def moved(m: re.Match) -> str:
            return f" {m[2]}" if len(m[2]) > 1 else f" {m[2]}{m[1]}"

        text = re.sub(rf"[\s.,;?!]([{MARKS}]+)([{self.vowels}]+)", moved, text)
        return re.sub(r"['\d]+", " ", text)

    def is_form(self, token: str) -> bool:
        return bool(re.search(r"\w", token)) and not re.fullmatch(r"\d+", token)


class English(Tokenizer):
    language = "english"
    features = ("form", "sound", "test", "lemmata")
    delimiter = re.compile(rf"( / )|(\s+)|([^\-'\w\d{MARKS}])|('+(?![a-zA-Z]+))|((?<![a-zA-Z])-(?![a-zA-Z]+))|(--+)")
    letters = re.compile(r"'?[a-zA-Z]+(?:['\-][a-zA-Z]*)?")

    def finish(self, token: str) -> str:
        return re.sub("[^a-zA-Z]", "", token)


TOKENIZERS: dict[str, Tokenizer] = {t.language: t for t in (Latin(), Greek(), English())}


def tokenizer(language: str) -> Tokenizer:
    if language not in TOKENIZERS:
        raise ValueError(f"unknown language {language!r}")
    return TOKENIZERS[language]
