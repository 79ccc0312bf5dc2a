"""Secret scans: three base patterns, and a token-efficiency test that exposes random strings.

A tokenizer's vocabulary spells words with few tokens, but random characters with many. A run of 16 or more characters
of `[A-Za-z0-9+/_=-]` whose characters per token under a byte-level BPE vocabulary are below MAX_RATIO is reported as
kind `token`, unless it is a known digest (hex of 32, 40, 56, 64, 96 or 128 digits), a UUID, a number, a word or
identifier without digits in one case, or part of a mail or web address. Spans of the base patterns always stay; an
added span never overlaps one.

Offsets are code points, ends exclusive. Defined results: null and empty texts have no span; spans that start together are
listed by kind; repeated rows get a row each; a null doc_id comes back null; an empty table gives no rows; columns of docs
other than doc_id and text are not read by scan and stay as they are in redact, whatever their names. Texts are read whole,
in time linear in their length.
"""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import DataFrame

from .common import per_text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters per token; prose has 3 to 5, random base64 about 1.4.
MAX_RATIO = 2.0
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})\Z")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
#: Tried only where a run of address characters begins, and never twice over it: linear in the text.
ADDRESS = re.compile(r"(?:https?://|www\.)\S+|(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]++)++")
#: A run is tokenized in pieces of so many characters, as the tokenizer takes more than linear time for one long word.
PIECE = 2048
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

Span = tuple[int, int, str]


def load_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoding(ranks: bytes):
    import tiktoken

    merged = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merged, special_tokens={})


def base_spans(text: str) -> list[Span]:
    """Spans of the three base patterns, by start, then kind as listed."""
    out: list[Span] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def plain(run: str) -> bool:
    """A known digest, an identifier or a word: not a random string."""
    core = run.strip("=-_+/")
    if not any(c.isdigit() for c in core):
        parts = [p for p in re.split(r"[-_/+=]", core) if p]
        if all(p.islower() or p.isupper() or p.istitle() for p in parts):
            return True
    return not re.search("[A-Za-z]", core) or len(core) < 16 or bool(DIGEST.match(core) or UUID.match(core))


class Cover:
    """Whether one of ascending spans overlaps [a, b), for queries with ascending a: a single sweep."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans: list[list[int]] = []
        for a, b in spans:
            if self.spans and a <= self.spans[-1][1]:
                self.spans[-1][1] = max(b, self.spans[-1][1])
            else:
                self.spans.append([a, b])
        self.at = 0

    def meets(self, a: int, b: int) -> bool:
        while self.at < len(self.spans) and self.spans[self.at][1] <= a:
            self.at += 1
        return self.at < len(self.spans) and self.spans[self.at][0] < b


def token_count(run: str, tokens) -> int:
    return sum(len(tokens(run[i:i + PIECE])) for i in range(0, len(run), PIECE))


def added_spans(text: str, base: list[Span], tokens) -> list[Span]:
    """Spans of kind token: runs that the vocabulary spells with many tokens."""
    out, covered, addresses = [], Cover([(a, b) for a, b, _ in base]), None
    for m in RUN.finditer(text):
        a, b = m.span()
        if plain(m[0]) or covered.meets(a, b) or (b - a) / token_count(m[0], tokens) >= MAX_RATIO:
            continue
        if addresses is None:
            addresses = Cover([x.span() for x in ADDRESS.finditer(text)])
        if not addresses.meets(a, b):
            out.append((a, b, "token"))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _spans(text: str | None, tokens) -> tuple[list[Span], list[Span]]:
    base = base_spans(text or "")
    more = added_spans(text or "", base, tokens)
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else base


def scan(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_token)."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def make():
        tokens = encoding(ranks.value).encode_ordinary

        def find(texts: list[str | None]):
            out = tuple([] for _ in range(6))
            for t in texts:
                base, all_ = _spans(t, tokens)
                kinds = [k for _, _, k in all_]
                row = (*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_), kinds.count("token"))
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            return None, out

        return find

    return per_text(docs, ["doc_id"], make, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_token long")


def redacted(text: str, spans: list[Span], mark: str) -> str:
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += (text[at:a], mark)
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, vocabulary: str = VOCABULARY, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span of text replaced by mark; overlapping spans give one mark; null stays null."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    others = [c for c in docs.columns if c != "text"]

    def make():
        tokens = encoding(ranks.value).encode_ordinary
        return lambda texts: (None, ([None if t is None else redacted(t, s, mark) if (s := _spans(t, tokens)[1]) else t for t in texts],))

    return per_text(docs, others, make, "text string").select(*docs.columns)
