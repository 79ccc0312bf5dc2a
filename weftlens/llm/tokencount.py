"""Token counts under a unigram vocabulary by trie-shared dynamic programming.

A text is cut at white space into pre-tokens, each led by the word mark U+2581. The best segmentation of a pre-token is
the one with the greatest sum of piece scores; its forward scores depend on the prefix only. The distinct new pre-tokens
of a batch are put in a trie (walked as a sorted list, whose common prefixes are the trie's inner nodes), so the forward
score of each shared prefix is computed once, and the token count stored at the pre-token's end. A text's count is the
sum over its pre-tokens.

The pieces are those of a public vocabulary; the score of the piece of rank r is the Zipf estimate -ln(r + 10). A
character that no piece holds costs UNKNOWN and counts as its UTF-8 bytes (byte fallback). Ties prefer the longer last
piece.

Defined results: null, empty and white texts have 0 tokens; repeated rows get a row each; a null doc_id comes back null; an
empty table gives no rows; columns of docs other than doc_id and text are not read, whatever their names. Texts are read
whole; a very long text is held alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from .common import per_text

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = -30.0
#: Characters of pre-tokens that a worker remembers before it starts anew, and of the longest that it remembers.
CACHE_CHARS, LONG = 8_000_000, 200


def load_pieces(path: str) -> dict[str, float]:
    """Scores by piece, without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return {p: -math.log(r + 10) for r, p in enumerate(plain)}


class Counter:
    """Counts tokens; remembers the terminal counts of the pre-tokens it has met."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        self.endings: dict[str, int] = {}
        for p in pieces:  # the longest piece that ends in a character bounds the search there
            self.endings[p[-1]] = max(self.endings.get(p[-1], 0), len(p))
        self.known: dict[str, int] = {}
        self.held = 0

    def learn(self, words: set[str]) -> None:
        score, ends = self.pieces.get, self.endings.get
        best, count, last = [0.0], [0], ""
        for word in sorted(words):
            w = MARK + word
            shared = 0
            for x, y in zip(w, last, strict=False):
                if x != y:
                    break
                shared += 1
            del best[shared + 1:], count[shared + 1:]
            for i in range(shared + 1, len(w) + 1):
                top, n = best[i - 1] + UNKNOWN, count[i - 1] + len(w[i - 1].encode("utf-8", "replace"))
                for a in range(i - 1, max(-1, i - 1 - ends(w[i - 1], 0)), -1):
                    s = score(w[a:i])
                    if s is not None and best[a] + s >= top:
                        top, n = best[a] + s, count[a] + 1
                best.append(top)
                count.append(n)
            last = w
            self.known[word] = count[-1]

    def counts(self, texts: list[str]) -> list[int]:
        split = [t.split() for t in texts]
        new = set().union(*split) - self.known.keys() if split else set()
        size = sum(map(len, new))
        if self.held + size > CACHE_CHARS:
            self.known.clear()
            self.held = 0
            new = set().union(*split)
        self.learn(new)
        get = self.known.__getitem__
        out = [sum(map(get, words)) for words in split]
        for w in new:
            if len(w) > LONG:
                del self.known[w]
            else:
                self.held += len(w)
        return out


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_words, n_tokens)."""
    held = docs.sparkSession.sparkContext.broadcast(load_pieces(vocabulary))

    def make():
        counter = Counter(held.value)

        def count(texts: list[str | None]):
            texts = [t or "" for t in texts]
            return None, ([len(t.split()) for t in texts], counter.counts(texts))

        return count

    return per_text(docs, ["doc_id"], make, "n_words long, n_tokens long")
