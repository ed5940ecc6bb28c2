"""Ranked search against scoring every document in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, clashing, frame, plain

from tablewright.llm import blocks, lexical

ITEMS = "item_id long, text string"


def split(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def expected(docs, items, best=20):
    counted = [(doc, Counter(split(text)), len(split(text))) for doc, text, *_ in docs]
    counted = [c for c in counted if c[2]]
    total = sum(c[2] for c in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for doc, counts, n in counted:
            m = 75 + 25 * n * len(counted) // total
            score = 0
            for t in split(text):
                if t in counts:
                    w = math.floor(1000 * math.log((2.0 * len(counted) + 2) / (2.0 * df[t] + 1)))
                    score += w * (1000000000 * counts[t] // (1000 * counts[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if null else doc, -s) for rank, (s, null, doc) in enumerate(sorted(scored)[:best], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def docs():
    dice, rows = random.Random(5), awkward()
    names = [f"t{int(dice.paretovariate(0.7))}" for _ in range(3000)] + ["naïve", "漢字", "x_y", "Zürich"]
    for n in range(500):
        rows.append((2000 + n, " ".join(dice.choices(names, k=dice.randint(1, 200))), "en", "a"))
    rows += [(n, "t1 t2 copied passage t3", "en", "a") for n in range(4000, 4300)]  # one hot text
    rows += [(9000, "t5 " * 5000 + "t1 " * 900, "en", "a")] * 2
    return rows


@pytest.fixture(scope="module")
def items(docs):
    dice = random.Random(6)
    made = [(n, " ".join(dice.choices(docs[200 + n][1].split(), k=dice.randint(1, 12)))) for n in range(40)]
    made += [(50, "Copied PASSAGE"), (51, None), (52, ""), (53, "nowhere to be-found"), (54, "t1 t1 t1 t5"), (54, "t2"), (54, "t2")]
    return made + [(55, "ZÜrich x_y 漢字"), (None, "t3 t4")]


@pytest.mark.parametrize("entries, block_bytes, docs_a_row", [(1 << 14, 1 << 23, 1024), (30, 3000, 7)])
def test_equals_scoring_everything(spark, docs, items, entries, block_bytes, docs_a_row, monkeypatch):
    monkeypatch.setattr(lexical, "DOCS", docs_a_row)
    table = clashing(frame(spark, docs), ["id", "block", "term", "item", "score"])
    index = lexical.Index(table, block_bytes=block_bytes)
    found = lexical.search(index, clashing(frame(spark, items, ITEMS), ["item", "weight"]), entries=entries)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert plain(found) == expected(docs, items)


def test_few_bits_still_bound(spark, docs, items, monkeypatch):
    """Signatures that are nearly full exclude less, results stay."""
    monkeypatch.setattr(lexical, "BITS", 0)
    index = lexical.Index(frame(spark, docs))
    assert plain(lexical.search(index, frame(spark, items, ITEMS), best=3)) == expected(docs, items, 3)


def test_bounds_are_upper_and_close(spark, docs, items):
    index = lexical.Index(frame(spark, docs))
    rows = lexical.weights(frame(spark, items, ITEMS), index, "item_id", "text").collect()
    chunk, exact, above, checked = lexical.Chunk(rows, index.docs, index.terms), 0, 0, 0
    texts = {b.block: blocks.unpacked(b.data).column("text").to_pylist() for b in index.blocks.collect()}
    for row in index.rows.collect():
        for item, bound in chunk.bounds(row.asDict()):
            for doc, high in zip(row.docs, bound.tolist()):
                found = lexical.terms(texts[row.block][doc])
                score = chunk.score(item, Counter(found), len(found))
                assert high >= score
                checked, exact, above = checked + 1, exact + (high == score), above + (high > 2 * score + 1)
    assert checked > 10_000 and exact > 0.5 * checked and above < 0.2 * checked


def test_empty(spark, docs):
    none = lexical.Index(frame(spark, []))
    assert lexical.search(none, frame(spark, [(1, "t1")], ITEMS)).collect() == []
    some = lexical.Index(frame(spark, docs[:40]))
    assert lexical.search(some, frame(spark, [], ITEMS)).collect() == []


def test_positions_stay_inside():
    hashes = np.arange(1000, dtype=np.uint64) * np.uint64(0x123456789ABCDEF)
    for width in (64, 1 << 20):
        at = lexical.positions(hashes, 3, width)
        assert at.min() >= 0 and at.max() < width and at.shape == (1000, lexical.HASHES)
