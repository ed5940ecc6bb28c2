"""Quality rules and the n-gram model against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from helpers import awkward, clashing, frame, plain

from tablewright.llm import perplexity

ORDER = perplexity.ORDER


def rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = {i + n for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for n in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)
    )


def half(text):
    return xxhash.xxh64_intdigest(text.encode(), 5) & 1


def line(text):
    return " ".join(re.findall(r"[^\x20\x09-\x0D]+", text)).replace("\0", "�") + "\n"


class Model:
    """Interpolated modified Kneser-Ney, one n-gram at a time."""

    def __init__(self, texts, order):
        self.counts, self.order = {order: Counter()}, order
        for text in texts:
            padded = "\n" * (order - 1) + line(text)
            self.counts[order].update(padded[i : i + order] for i in range(len(padded) - order + 1))
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.discounts, self.contexts = {}, {}
        for n, counts in self.counts.items():
            often = Counter(counts.values())
            y = often[1] / (often[1] + 2 * often[2]) if often[1] + often[2] else None
            made = {k: k - (k + 1) * y * often[k + 1] / often[k] if often[k] and y is not None else 0 for k in (1, 2, 3)}
            self.discounts[n] = [min(k, d) if d > 0 else k / 2 for k, d in made.items()]
            contexts = self.contexts[n] = defaultdict(lambda: [0, 0.0])
            for g, c in counts.items():
                contexts[g[:-1]][0] += c
                contexts[g[:-1]][1] += self.discounts[n][min(c, 3) - 1]

    def prob(self, gram):
        if not gram:
            return 1 / (len(self.counts[1]) + 1)
        n, lower = len(gram), self.prob(gram[1:])
        if gram[:-1] not in self.contexts[n]:
            return lower
        total, left = self.contexts[n][gram[:-1]]
        c = self.counts[n][gram]
        return max(c - self.discounts[n][min(c, 3) - 1], 0) / total * (c > 0) + left / total * lower

    def bits(self, text):
        padded = "\n" * (self.order - 1) + line(text)
        grams = [padded[i : i + self.order] for i in range(len(padded) - self.order + 1)]
        return -sum(math.log2(self.prob(g)) for g in grams) / len(grams)


def expected(rows, order=ORDER, reach=perplexity.REACH):
    texts = defaultdict(list)
    for _, text, lang, *_ in rows:
        if line(text or "") != "\n":
            texts[lang or "und", half(text)].append(text)
    models = {key: Model(found, order) for key, found in texts.items()}
    out = []
    for doc, text, lang, *_ in rows:
        lang = lang or "und"
        other = models.get((lang, 1 - half(text or "")))
        bits = other.bits(text) if other and line(text or "") != "\n" else None
        own = rules(text)
        out.append((doc, *own, own[0] < 50 or 100 * own[4] > 50 * own[0], lang, bits))
    limits = {}
    for lang in {r[7] for r in out}:
        found = sorted(math.floor(r[8] * 100 + 0.5) for r in out if r[7] == lang and not r[6] and r[8] is not None)
        if found:
            q = [next(b for n, b in enumerate(found, 1) if n >= len(found) * part) / 100 for part in (0.25, 0.75)]
            wide = max(perplexity.LEAST_REACH, reach * (q[1] - q[0]))
            limits[lang] = (q[0] - wide, q[1] + wide)
    judged = []
    for *row, failed, lang, bits in out:
        low, high = limits.get(lang, (None, None))
        kept = not failed and (bits is None or low is None or low <= bits <= high)
        judged.append((*row, failed, kept, bits))
    return judged


def key(row):
    return repr(row[:-1])


def same(got, wanted):
    assert len(got) == len(wanted)
    for a, b in zip(sorted(got, key=key), sorted(wanted, key=key)):
        assert a[:-1] == b[:-1]
        assert (a[-1] is None and b[-1] is None) or a[-1] == pytest.approx(b[-1], rel=1e-5)


NAMES = ["doc_id", *perplexity.RULES, "base_failed", "kept", "bits"]


@pytest.fixture(scope="module")
def rows():
    dice, made = random.Random(8), awkward()
    words = {"en": "the of and that was from with water house river".split(), "fr": "été le très où être deux maison rivière".split()}
    for n in range(240):
        lang = dice.choice(["en", "fr", "fr", None])
        made.append((2000 + n, " ".join(dice.choices(words[lang or "en"], k=dice.randint(30, 120))), lang, "a"))
    for n in range(6):  # unlike its language, and too much like itself
        made.append((3000 + n, " ".join("".join(dice.choices("qxzjkvwy#%0123456789", k=7)) for _ in range(90)), "en", "a"))
    made += [(4000, "a\nb c\n\na\nb c\nA\n \n \na #|<>$%&*", "en", "a"), (4001, "only text of its kind " * 40, "xx", "a"), (4002, "x\0y " * 60, "en", "a")]
    return made + [(5000 + n, "many copies of one text with just enough words to be looked at " * 6, "de", "a") for n in range(200)]


@pytest.mark.parametrize("order, block_bytes, part, codes", [(ORDER, 1 << 23, 1 << 20, 1 << 24), (2, 4000, 50, 0), (4, 20000, 3000, 1 << 24)])
def test_equals_plain_python(spark, rows, order, block_bytes, part, codes, monkeypatch):
    monkeypatch.setattr(perplexity, "PART", part)
    monkeypatch.setattr(perplexity, "MOST_CODES", codes)
    docs = clashing(frame(spark, rows), ["bits", "low", "gram", "half", "block", "id", "n_words", "prob"])
    got = perplexity.quality(docs, order=order, block_bytes=block_bytes)
    same(plain(got.select(*NAMES)), expected(rows, order))


def test_odd_documents_are_rejected(spark, rows):
    found = {r.doc_id: r for r in perplexity.quality(frame(spark, [r for r in rows if (r[0] or 0) >= 2000])).collect()}
    odd, clean = [found[3000 + n] for n in range(6)], [found[2000 + n] for n in range(240)]
    assert not any(r.kept for r in odd) and all(r.bits > r.high for r in odd)
    assert all(r.kept or r.base_failed for r in clean) and sum(r.kept for r in clean) > 60


def test_probabilities_sum_to_one(spark, rows):
    """The even share of the empty n-gram leaves one share to characters never seen."""
    texts = [r[1] for r in rows if r[2] == "en" and r[1] and line(r[1]) != "\n"]
    counts = Model(texts, 3).counts[3]
    table = spark.createDataFrame([("en", 0, g, c) for g, c in counts.items()], "lang string, half int, gram string, c long")
    held = {r.gram: r for r in perplexity.kneser_ney(table, 3).collect()}
    letters = [g for g in held if len(g) == 1]

    def prob(gram):
        if gram in held and held[gram].prob is not None:
            return held[gram].prob
        weight = held[gram[:-1]].backoff if gram[:-1] in held and held[gram[:-1]].backoff is not None else 1.0
        return weight * prob(gram[1:])

    for context in ("th", "\n\n", "e ", "qq"):
        unknown = prob(context + "一")
        assert sum(prob(context + c) for c in letters) + unknown == pytest.approx(1, abs=1e-9)


def test_given_bands(spark, rows):
    bands = spark.createDataFrame([("en", 0.0, 0.1), ("fr", 0.0, 99.0)], "lang string, low double, high double")
    found = perplexity.quality(frame(spark, rows), given=bands).where("NOT base_failed AND bits IS NOT NULL")
    assert {(r.high, r.kept) for r in found.collect()} == {(0.1, False), (99.0, True), (None, True)}


def test_empty(spark):
    assert perplexity.quality(frame(spark, [])).collect() == []
    one = perplexity.quality(frame(spark, [(1, None, None, None), (None, "", "en", "a")])).collect()
    assert [(r.kept, r.bits, r.n_words) for r in one] == [(False, None, 0)] * 2


def test_documents_that_come_in_another_order_are_an_error():
    import pyarrow as pa

    block = pa.table({"block": [1], "digest": [7], "data": [b""]})
    answers = pa.table([[1], [8], ["en"], [0], [0], [b""], [b""]], names=perplexity._names(perplexity.ANSWER))
    with pytest.raises(RuntimeError, match="store them first"):
        perplexity._scorer(3, 1)(block, answers)
