import math
import random
from fractions import Fraction

import numpy as np
from helpers import clashing

from tablewright.llm import metric_search as search

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20, every=20):
    fit = []
    for vec, emb, _ in rows:
        if emb is None or any(x is None or not np.isfinite(x) for x in emb):
            continue
        # Embeddings may be floats or doubles; either way the components are whole 64ths.
        fit.append((vec, [math.floor(Fraction(float(x)) * 64) for x in emb]))
    out, seen = [], set()
    for vec, v in fit:
        if vec is None or vec % every or (vec, tuple(v)) in seen:
            continue
        seen.add((vec, tuple(v)))
        long = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
        scored = sorted(((-long(sum(a * b for a, b in zip(v, w))), -(1 << 63) if i is None else i) for i, w in fit if i != vec))[:k]
        out += [(vec, n + 1, None if i == -(1 << 63) else i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out, key=repr)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "PAGE", 90)
    monkeypatch.setattr(search, "LEAF", 8)
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    dice = random.Random(2)
    centres = [[dice.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(n, [c + dice.gauss(0, 0.2) for c in dice.choice(centres)], n) for n in range(600)]
    rows += [(n, centres[0], 0) for n in range(600, 800)]  # one very common vector
    rows += [(900, None, 1), (920, [1.0, None], 1), (940, [float("nan")], 1), (960, [float("inf")] * 6, 1), (980, [1e30], 1)]
    rows += [(1000, [0.5, -0.5], 1), (1020, [], 1), (None, centres[1], 1), (1040, centres[2], 1), (1040, centres[2], 1), (1060, [3e4] * 6, 1)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], n) for i, v, n in rows]
    vectors = clashing(spark.createDataFrame(rows, SCHEMA), ["cell", "page", "q", "rank", "score"])
    got = search.top_products(vectors)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_bounds_save_computations():
    dice = np.random.default_rng(1)
    centres = dice.normal(0, 40, (12, 16))
    rows = np.round(np.repeat(centres, 100, axis=0) + dice.normal(0, 4, (1200, 16)))
    space = search.Space(int((rows * rows).sum(axis=1).max()))
    leaves = search.split_leaves(rows, space)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(1200)) and max(map(len, leaves)) <= search.LEAF
    pivot = rows[:1]
    routing = np.concatenate([rows[leaf[:1]] for leaf in leaves])
    far = [space.between(rows[leaf], rows[leaf[:1]])[:, 0] for leaf in leaves]
    every = np.concatenate(leaves)
    page = search.Page(
        routing, np.array([d.max() for d in far]), space.between(routing, pivot)[:, 0],
        np.array([len(leaf) for leaf in leaves]), every, rows[every], np.concatenate(far),
    )
    query = rows[5]
    to_pivot = float(space.from_scores(float(query @ query), float(pivot[0] @ query)))
    scores, ids, computed = search.search_page(page, query, 5, None, to_pivot, 20, space)
    wanted = sorted((-int(rows[i] @ query), i) for i in range(1200) if i != 5)[:20]
    assert list(zip((-scores).tolist(), ids.tolist())) == wanted
    assert computed < 700


def test_few_rows_and_empty(spark):
    rows = [(0, [1.0], 0), (20, [2.0], 0)]
    assert sorted(tuple(r) for r in search.top_products(spark.createDataFrame(rows, SCHEMA)).collect()) == brute(rows)
    assert search.top_products(spark.createDataFrame([(0, [1.0], 0)], SCHEMA)).collect() == []
    assert search.top_products(spark.createDataFrame([], SCHEMA)).collect() == []


def test_wide_vectors_take_part(spark, monkeypatch):
    """Components of 1e6 and more, as candidates and as queries, next to small ones; and nothing but such."""
    monkeypatch.setattr(search, "WIDE_BLOCK", 9)
    monkeypatch.setattr(search, "QUERY_BLOCK", 5)
    dice = random.Random(3)
    rows = [(n, [dice.gauss(0, 1) for _ in range(4)], 0) for n in range(200)]
    wide = [(n, [dice.choice([1e6, -1e6, 262144.0, 2.5e5, 0.3]) * dice.choice([1, 0.5]) for _ in range(4)], 0) for n in range(300, 360)]
    wide += [(400, [1e6, 1.0], 0), (401, [1e6, 1.0], 0), (401, [1e6, 1.0], 0), (420, [4194304.5, 1 / 3], 0), (None, [1e6] * 4, 0)]
    for some in (rows + wide, wide, rows + wide[:1]):
        vectors = spark.createDataFrame(some, "vec_id long, embedding array<double>, label int")
        assert sorted((tuple(r) for r in search.top_products(vectors).collect()), key=repr) == brute(some)


def test_scores_beyond_64_bits(spark):
    rows = [(n, [float(n), 1.0], 0) for n in range(1, 60)] + [(60, [1e30, 1.0], 0), (61, [-1e30, 0.0], 0), (80, [1e308, -1e308], 0)]
    got = {}
    for r in search.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    top = (1 << 63) - 1
    assert got[20][0] == (60, top) and got[20][1] == (80, top) and len(got[20]) == 20 and len(got[60]) == 20
    assert [s for _, s in got[60]] == [top] * 20
