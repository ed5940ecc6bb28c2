import re

import numpy as np
import xxhash
from helpers import SCHEMA, WORDS, awkward, clashing, frame, plain

from tablewright.llm import simhash
from tablewright.llm.components import components


def brute_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(x) for x in range(n)]


def brute_groups(rows):
    prints = [brute_print(text) for _, text, *_ in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    found = roots(len(rows), near)
    low = {}
    for (doc, *_), root in zip(rows, found):
        low[root] = min(filter(lambda x: x is not None, (doc, low.get(root))), default=None)
    return sorted(((r[0], f"{p:016x}", low[g]) for r, p, g in zip(rows, prints, found)), key=repr)


def test_fingerprint_in_slices(monkeypatch):
    for chars, slice_ in ((1 << 20, 1 << 15), (40, 3)):
        monkeypatch.setattr(simhash, "CHARS", chars)
        monkeypatch.setattr(simhash, "SLICE", slice_)
        for _, text, *_ in awkward():
            assert simhash.fingerprint((text or "")[:5000]) == brute_print((text or "")[:5000])


def test_groups_equal_brute_force(spark):
    rows = awkward()
    base = [WORDS[n % 20] + str(n % 37) for n in range(400)]
    for n in range(40):  # near copies: one word changed in a long text
        words = list(base)
        words[n * 7] = f"changed{n}"
        rows.append((5000 + n, " ".join(words), "en", "a"))
    docs = clashing(frame(spark, rows), ["print", "fingerprint", "component_id", "low"])
    wanted = brute_groups(rows)
    assert len({c for _, _, c in wanted}) < len({p for _, p, _ in wanted})
    assert plain(simhash.near_groups(docs)) == wanted
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, _, c in wanted if c is not None})
    assert ids.count(None) == 1


def test_links_equal_brute_force(spark):
    """Clusters around a few centres: all links of up to two bits, across any segments."""
    dice = np.random.default_rng(8)
    values = []
    for centre in dice.integers(0, 1 << 63, size=6, dtype=np.uint64):
        for _ in range(150):
            flips = dice.choice(64, size=dice.integers(0, 5), replace=False)
            values.append(int(centre) ^ sum(1 << int(b) for b in flips))
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    near = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    wanted = roots(len(values), near)
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "print long"))
    at = {v: n for n, v in enumerate(signed)}
    assert roots(len(values), [(at[r.a], at[r.b]) for r in links.collect()]) == wanted


def test_buckets_cut_between_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(simhash, "LINKS_AT_ONCE", 3)
    key = np.array([1, 1, 1, 2, 2, 3, 4, 4, 4, 4])
    rest = np.array([0, 3, 28, 5, 5 ^ 7, 9, 1, 2, 4, 1])
    raised = np.array([False] * 9 + [True])
    label = np.arange(10)
    rows = [pa.array(key), pa.array(rest), pa.array(label), pa.array(raised)]
    batches = [pa.RecordBatch.from_arrays([c.slice(n, 2) for c in rows], names=list("krlu")) for n in range(0, 10, 2)]
    found = [(a, b) for out in simhash._link_batches(batches) for a, b in zip(*out.to_pydict().values())]
    assert roots(10, found) == [0, 0, 2, 3, 4, 5, 6, 6, 6, 6]


def test_components_of_a_chain_and_empty(spark):
    chain = spark.createDataFrame([(n, n + 1) for n in range(64)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in components(chain).collect()}
    assert found == {n: 0 for n in range(65)} | {100: 100, 101: 100, 102: 100}
    assert simhash.near_groups(frame(spark, [], SCHEMA)).collect() == []
    assert simhash.drop_near_copies(frame(spark, [], SCHEMA)).collect() == []
