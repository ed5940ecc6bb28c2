"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenization takes, again and again, the longest piece of the vocabulary that
starts where the last one ended; pieces at the start of a word and pieces that continue it are
told apart. The automaton is a trie of the vocabulary under two roots, one for each sort of
piece. Where the trie cannot follow a character, a failure link leads to the node for what
remains unmatched after the pieces that are certain by then have been popped, and the number of
popped pieces is stored with the link. So every character is read once, links are amortized, and
a count comes out without building a piece.

A vocabulary with markers is read as word-piece: a piece that begins with the marker starts a
word, one without continues it, as do continuation marks where a vocabulary has those instead.

Results: words are ``[^\\x20\\x09-\\x0D]+``; a word that cannot be matched to its end counts as one
unknown token. A null text counts as empty: no words, no tokens. Texts and words of any length
are read whole. Repeated rows get equal results. An empty table gives an empty one. Input columns
called like an output give way to it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, quoted, without

MARK = "▁"
TABLE_WORDS = 200_000  # counts of words that a worker keeps


class Automaton:
    """Trie with failure links over pieces that start a word and pieces that continue one.

    ``step[node]`` maps a character to the next node; ``link[node]`` is the failure link (-1: the
    word cannot be matched) and ``popped[node]`` the pieces popped on it.
    """

    START, INSIDE = 0, 1

    def __init__(self, starting: Iterable[str], continuing: Iterable[str]) -> None:
        self.step: list[dict[str, int]] = [{}, {}]
        piece_end = [False, False]
        for root, pieces in ((self.START, starting), (self.INSIDE, continuing)):
            for piece in pieces:
                node = root
                for char in piece:
                    if char not in self.step[node]:
                        self.step[node][char] = len(self.step)
                        self.step.append({})
                        piece_end.append(False)
                    node = self.step[node][char]
                if piece:
                    piece_end[node] = True
        self.link, self.popped = [-1] * len(self.step), [0] * len(self.step)
        queue = deque([self.START, self.INSIDE])
        while queue:
            node = queue.popleft()
            for char, child in self.step[node].items():
                if piece_end[child]:
                    self.link[child], self.popped[child] = self.INSIDE, 1
                else:
                    # What the parent leaves unmatched, followed by this character.
                    at, count = self.link[node], self.popped[node]
                    while at != -1 and char not in self.step[at]:
                        count += self.popped[at]
                        at = self.link[at]
                    if at != -1:
                        self.link[child], self.popped[child] = self.step[at][char], count
                queue.append(child)

    def count(self, word: str) -> int:
        """Number of pieces of a word; 0 if it cannot be matched."""
        step, link, popped = self.step, self.link, self.popped
        node, total = self.START, 0
        for char in word:
            while (follow := step[node].get(char)) is None:
                total += popped[node]
                node = link[node]
                if node == -1:
                    return 0
            node = follow
        while node != self.INSIDE:
            total += popped[node]
            node = link[node]
            if node == -1:
                return 0
        return total


def vocabulary(model: str) -> tuple[list[str], list[str]]:
    """Pieces that start a word and pieces that continue one, of a SentencePiece model file.
    Control and byte pieces stand for no characters and are left out."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    plain = [
        pieces.id_to_piece(n)
        for n in range(pieces.get_piece_size())
        if not (pieces.is_control(n) or pieces.is_unknown(n) or pieces.is_byte(n) or pieces.is_unused(n))
    ]
    starting = [p[1:] for p in plain if p.startswith(MARK) and p.strip(MARK)]
    return [p for p in starting if MARK not in p], [p for p in plain if MARK not in p]


class Counts(dict):
    """Pieces of words met before; cleared when full, so that its memory stays bounded."""

    def __init__(self, automaton: Automaton, limit: int = TABLE_WORDS) -> None:
        self.automaton, self.limit = automaton, limit

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = n
        return n


def count_tokens(docs: DataFrame, starting: list[str], continuing: list[str], text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_tokens`` (unknown words count as one) and ``n_unknown``."""
    prepare(docs.sparkSession)
    # Built where it is used: the pieces travel as one string, smaller than the automaton.
    pieces = "\n".join(starting), "\n".join(continuing)
    if any("\n" in p for p in (*starting, *continuing)):
        raise ValueError("pieces with line ends cannot match a word")

    @F.arrow_udf("n_words long, n_tokens long, n_unknown long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = Counts(Automaton(*(p.split("\n") for p in pieces)))
        for batch in batches:
            out = ([], [], [])
            for value in batch.to_pylist():
                found = [counts[word] for word in _words(value or "")]
                unknown = found.count(0)
                for part, n in zip(out, (len(found), sum(found) + unknown, unknown)):
                    part.append(n)
            yield pa.StructArray.from_arrays([pa.array(p, pa.int64()) for p in out], names=["n_words", "n_tokens", "n_unknown"])

    rows = without(docs, ["n_words", "n_tokens", "n_unknown", "_tw_found"])
    return rows.withColumn("_tw_found", counted(quoted(text))).select(*map(quoted, rows.columns), "_tw_found.*")


def _words(text: str) -> list[str]:
    # Cut as bytes: there only the six ASCII characters part words.
    return [word.decode() for word in text.encode().split()] if not text.isascii() else _ascii_words(text)


def _ascii_words(text: str) -> list[str]:
    # The separators 0x1C to 0x1F part words for strings, but not here.
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [word.decode() for word in text.encode().split()]
    return text.split()
