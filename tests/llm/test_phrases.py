"""Phrase collocations against counting every phrase in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import awkward, clashing, frame, plain

from tablewright.llm import blocks, phrases


def expected(rows, least=10, inside=50, top=2000, longest=3):
    counts, totals = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            found = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(found)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(found[i : i + k]) for i in range(len(found) - k + 1))
    out = []
    for lang, f in counts.items():
        kept = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for s in range(len(p) - k + 1):
                    longer[p[s : s + k]] = max(longer[p[s : s + k]], a)
        for p, a in candidates.items():
            if p in longer and 100 * longer[p] >= inside * a:
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out, key=repr)


def corpus(seed=1, extra=400):
    dice, rows = random.Random(seed), awkward()
    names = [f"W{n}" for n in range(40)] + ["É", "漢字", "x\x00y", "N.Y", "tab\tbed", "\x1f", " ", "a,b"]
    for n in range(extra):
        text = ["New York City" if dice.random() < 0.1 else dice.choice(names) for _ in range(dice.randint(0, 80))]
        rows.append((5000 + n, dice.choice([" ", "  ", "\t"]).join(text) + dice.choice(["", ".", "\r\n", "\x0b"]), dice.choice(["en", "fr", "und", None]), "a"))
    rows += [(9000, "same words here again. " * 3000, "de", "a")] * 2
    return rows


@pytest.mark.parametrize("bits, part_bytes, block_bytes", [(32, 1 << 23, 1 << 23), (32, 5000, 20000), (6, 1 << 23, 9000), (0, 40000, 30000)])
def test_equals_counting(spark, bits, part_bytes, block_bytes):
    """Also where fingerprints collide all the time, and for any cut into blocks and parts."""
    rows = corpus()
    docs = clashing(frame(spark, rows), ["block", "phrase", "data", "count", "n", "part"])
    got = phrases.collocations(docs, bits=bits, part_bytes=part_bytes, block_bytes=block_bytes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert plain(got) == expected(rows) and len(expected(rows)) > 150


def test_longer_phrases_and_few_ranks(spark):
    rows = corpus(2, 200)
    got = phrases.collocations(frame(spark, rows), least=300, inside=80, top=7, longest=4)
    assert plain(got) == expected(rows, 300, 80, 7, 4)


def test_one_copied_text_is_many_rows(spark):
    """A third of the rows are one text; a very long text is a block of its own."""
    rows = [(n, "hot cold warm hot cold" if n % 3 else f"a{n} b{n}", "en", "a") for n in range(3000)]
    rows.append((1, "very long " * 200_000, "en", "a"))
    assert plain(phrases.collocations(frame(spark, rows), block_bytes=4096)) == expected(rows)


def test_empty(spark):
    assert phrases.collocations(frame(spark, [])).collect() == []
    assert phrases.collocations(frame(spark, [(1, None, None, None), (2, "", "en", "a")])).collect() == []


def test_large_numbers(spark):
    """Products beyond 64 bits."""
    a, left, right = 4_000_000_000_000, 5_000_000_000_000, 6_000_000_000_001
    row = spark.sql(f"SELECT cast({a} AS decimal(18,0)) a, cast({left} AS decimal(18,0)) l, cast({right} AS decimal(18,0)) r")
    assert row.selectExpr("cast(((a * a * 1000000BD) div (l * r)) AS bigint) s").first().s == 1000000 * a * a // (left * right)


def test_prefix_polynomials_depend_on_words_only():
    one, two = phrases.Grams([b"a b c", b"x b c"], "en"), phrases.Grams([b"q q q q b c"], "en")
    pick = lambda g, p: [int(h) for h, f in zip(g.prints[2], g.first[2]) if g.phrases(2, np.array([f]))[0].as_py() == p]
    assert pick(one, b"b c") == pick(two, b"b c") and len(pick(one, b"b c")) == 1
    assert pick(phrases.Grams([b"b c"], "fr"), b"b c") != pick(one, b"b c")
    assert len(np.unique(np.concatenate([one.prints[n] for n in one.prints]))) == sum(map(len, one.prints.values()))


def test_blocks_hold_every_row(spark):
    from pyspark.sql import functions as F

    docs = frame(spark)
    held = blocks.stored(docs, F.col("text"), 1000, id=F.col("doc_id")).collect()
    back = [(r["id"], r["text"]) for b in held for r in blocks.unpacked(b.data).to_pylist()]
    assert sorted(back, key=repr) == sorted(((r[0], None if r[1] is None else r[1].encode()) for r in awkward()), key=repr)
    assert sum(b.rows for b in held) == len(back) and len({b.block for b in held}) == len(held) > 5
