"""Near copies by shingles against all pairs."""

import random

import pytest
from helpers import frame

import corpus_pipeline
from tablewright.llm import shingles

SCHEMA = "doc_id long, text string"


def similarity(a, b):
    sets = [{tuple(w[n : n + 5]) for n in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in (a, b))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def brute(rows):
    """Smallest id of each component."""
    root = list(range(len(rows)))

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for i in range(len(rows)):
        for j in range(i):
            if similarity(rows[i][1], rows[j][1]) >= 0.8:
                root[top(i)] = top(j)
    low = {}
    for n, (doc, _) in enumerate(rows):
        low[top(n)] = min(doc, low.get(top(n), doc))
    return set(low.values())


@pytest.fixture(scope="module")
def rows():
    dice, made = random.Random(4), []
    word = lambda: f"w{dice.randrange(3000)}"
    for length, edits in [(100, 1), (100, 2), (200, 1), (200, 3), (300, 1), (300, 6), (60, 1), (24, 0), (400, 8), (100, 3), (200, 8)]:
        for _ in range(3):
            text = [word() for _ in range(length)]
            made.append((len(made), " ".join(text)))
            copy = list(text)
            for n in range(edits):
                copy[(n + 1) * length // (edits + 1)] = word()
            made.append((len(made), " ".join(copy).upper()))
    chain = [word() for _ in range(150)]
    for n in range(12):  # neighbours are similar, the ends are not
        chain[12 * n + 3] = word()
        made.append((len(made), " ".join(chain)))
    base = [word() for _ in range(120)]
    for n in range(60):  # one large group, every second text farther away
        text = list(base)
        text[n] = word()
        if n % 2:
            text[60:90] = [word() for _ in range(30)]
        made.append((len(made), " ".join(text)))
    dice.shuffle(made)
    return made + [(1000, "one two"), (1001, "One  two"), (1002, "two one")]


def test_stage_equals_all_pairs(spark, rows):
    got = [r.doc_id for r in corpus_pipeline.near_stage(spark, frame(spark, rows, SCHEMA), "").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    found = [similarity(a[1], b[1]) for a, b in zip(sorted(rows)[:66:2], sorted(rows)[1:66:2])]
    assert sum(0.8 <= s < 0.98 for s in found) >= 15 and sum(s < 0.8 for s in found) >= 3


def test_bands_meet():
    """Pairs at the bound share a band, and the least values agree as often as the sets do."""
    dice = random.Random(9)
    met = 0
    for _ in range(300):
        pool = [dice.getrandbits(64) for _ in range(110)]
        a, b = (shingles.np.array(sorted(x), shingles.np.uint64) for x in (pool[:99], pool[11:]))
        assert shingles.similar(a, b) == (88 * 5 >= 4 * 110)
        met += bool((shingles.band_keys(a) == shingles.band_keys(b)).any())
    assert met >= 298


def far_copies(dice, base, count, edits):
    """Copies of a text with edits of their own, mutually below the bound."""
    out = []
    for _ in range(count):
        text = list(base)
        for at in dice.sample(range(len(base)), edits):
            text[at] = f"e{dice.randrange(10**9)}"
        out.append(" ".join(text))
    return out


def test_far_copies_make_few_pairs(spark, monkeypatch):
    """Copies that are mutually at 0.5 to 0.79: the sets of few pairs are compared, and no similar one is missed."""
    dice, made = random.Random(11), {}
    base = [f"w{dice.randrange(5000)}" for _ in range(200)]
    kept = shingles._open_pairs
    for count in (100, 400):
        texts = far_copies(dice, base, count, 4)
        found = [similarity(a, b) for a, b in zip(texts, texts[1:])]
        assert sum(0.5 < s < 0.8 for s in found) > 0.9 * len(found)
        rows = [(n, t) for n, t in enumerate(texts)]

        def counting(*args):
            pairs = kept(*args).checkpoint()
            made[count] = pairs.count()
            return pairs

        monkeypatch.setattr(shingles, "_open_pairs", counting)
        got = {r.doc_id for r in corpus_pipeline.near_stage(spark, frame(spark, rows, SCHEMA), "").collect()}
        assert got == brute(rows) and len(got) > 0.9 * count
        assert made[count] < count * (count - 1) / 2 / 6


def test_similar_pairs_among_far_copies(spark):
    """In such a group, pairs and chains at 0.8 and more are still all found, also next to nodes like the head."""
    dice = random.Random(12)
    base = [f"w{dice.randrange(5000)}" for _ in range(200)]
    texts = [" ".join(base)] + far_copies(dice, base, 6, 1) + far_copies(dice, base, 40, 5)
    for text in dice.sample(texts, 25):
        words = text.split()
        for _ in range(dice.choice([1, 2, 3])):
            words[dice.randrange(200)] = f"f{dice.randrange(10**9)}"
            texts.append(" ".join(words))
    passage = [f"p{n}" for n in range(40)]
    texts += [" ".join([f"q{dice.randrange(10**6)}" for _ in range(20)] + passage) for _ in range(60)]  # one shared passage
    dice.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id for r in corpus_pipeline.near_stage(spark, frame(spark, rows, SCHEMA), "").collect()}
    assert got == brute(rows) and len(got) < len(rows) - 10


def test_odd_rows(spark):
    long = " ".join(f"v{n % 70000}" for n in range(300_000))
    rows = [(1, None), (2, ""), (3, " \n"), (None, "one two three four five six"), (4, "one two three four five six"), (4, "one two three four five six"), (5, long), (6, long + " end"), (None, None)]
    got = sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, frame(spark, rows, SCHEMA), "").collect())
    assert got == [1, 4, 5]
    assert corpus_pipeline.near_stage(spark, frame(spark, [], SCHEMA), "").collect() == []
