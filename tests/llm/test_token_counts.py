import random
import re

from helpers import SCHEMA, awkward, clashing, frame
from tokenizers import models

from tablewright.llm import token_counts as tokens
from tablewright.llm.queries import tokenizer


def greedy(word, starting, continuing):
    """Longest match first by trying every length."""
    at, n = 0, 0
    while at < len(word):
        pieces = continuing if at else starting
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


def test_small_vocabularies_equal_greedy_matching():
    dice = random.Random(6)
    for _ in range(300):
        make = lambda: {"".join(dice.choices("abc", k=dice.randint(1, 5))) for _ in range(dice.randint(0, 12))}
        starting, continuing = make(), make()
        automaton = tokens.Automaton(starting, continuing)
        for _ in range(60):
            word = "".join(dice.choices("abcd", weights=[5, 5, 5, 1], k=dice.randint(1, 14)))
            assert automaton.count(word) == greedy(word, starting, continuing), (word, starting, continuing)


def test_vocabulary_equals_the_library():
    starting, continuing = tokens.vocabulary(tokenizer("piece_bpe_32k.model"))
    vocab = {p: n for n, p in enumerate(["[UNK]", *dict.fromkeys(starting), *dict.fromkeys("##" + p for p in continuing)])}
    library = models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=100000)
    automaton = tokens.Automaton(starting, continuing)
    words = {w for _, text, *_ in awkward(200) for w in (text or "").split() if len(w) < 500} | {"x" * 300, "naïve", "漢字", "\U0001f9ff", "</s>"}
    for word in words:
        pieces = [p.value for p in library.tokenize(word)]
        assert automaton.count(word) == (0 if pieces == ["[UNK]"] else len(pieces)), word


def test_documents(spark):
    starting, continuing = ["th", "t", "one", "o"], ["e", "he", "n", "d"]
    docs = clashing(frame(spark), ["n_words", "_tw_found"])
    for row in tokens.count_tokens(docs, starting, continuing).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", row.text or "")
        found = [greedy(w[:3000], set(starting), set(continuing)) for w in words]
        assert (row.n_words, row.n_tokens, row.n_unknown) == (len(words), sum(found) + found.count(0), found.count(0))
    assert tokens.count_tokens(frame(spark, [], SCHEMA), starting, continuing).collect() == []
    assert tokens._words("a\x1cb c\x85d") == ["a\x1cb", "c\x85d"] and tokens._words("a\x1cb c") == ["a\x1cb", "c"]


def test_full_table_is_cleared():
    counts = tokens.Counts(tokens.Automaton(["a"], ["b"]), limit=2)
    assert [counts[w] for w in ("a", "ab", "abb", "a", "c")] == [1, 2, 3, 1, 0] and len(counts) <= 2
