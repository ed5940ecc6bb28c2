import re
from collections import defaultdict

import numpy as np
import pytest
from helpers import SCHEMA, awkward, clashing, frame, plain

from tablewright.llm import mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(3, 1, 2), budget=1.5, epochs=2):
    """Repeated sharing of what is left until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    capped, total = set(), budget * sum(sizes.values())
    while True:
        left = total - sum(epochs * sizes[s] for s in capped)
        share = sum(weight[s] for s in sizes if s not in capped)
        new = {s for s in sizes if s not in capped and left * weight[s] / share > epochs * sizes[s]}
        if not new:
            return {s: epochs * sizes[s] if s in capped else left * weight[s] / share for s in sizes}
        capped |= new


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 20, None: 5}, {"x": 7}, {"s1": 0, "s2": 50, "s3": 3}])
def test_targets(spark, sizes):
    rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    found = {r.source: r.target for r in rows.collect()}
    assert found == pytest.approx(targets(sizes))


def test_time_inverts_the_integral(spark):
    from pyspark.sql import functions as F

    for a, b in [(1.5, 0.5), (1.0, 1.0), (0.5, 1.5), (3.0, 0.1)]:
        rows = spark.createDataFrame([(x / 20,) for x in range(21)], "share double")
        got = rows.select("share", mixing.demand_time(F.col("share"), F.array(F.lit(a), F.lit(b))).alias("t")).collect()
        for r in got:
            assert (a * r.t + (b - a) * r.t**2 / 2) / ((a + b) / 2) == pytest.approx(r.share, abs=1e-9)


def test_mix_of_documents(spark):
    rows = awkward()
    got = mixing.training_mix(clashing(frame(spark, rows), ["size", "taken", "before", "_order"])).collect()
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += words(text)
    wanted = targets(sizes)
    assert sorted(((r.doc_id, r.size) for r in got), key=repr) == sorted(((i, words(t)) for i, t, *_ in rows), key=repr)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source])
        assert r.taken in (0, r.size, 2 * r.size) and len(r.positions) * r.size == r.taken
        assert all(0 <= p <= 1 for p in r.positions) and r.positions == sorted(r.positions)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for source in sizes:
        assert abs(taken[source] - wanted[source]) <= largest[source] / 2
    first = [r.positions[0] if r.positions else 2 for r in got]
    assert first == sorted(first)


def test_partitioning_does_not_matter(spark):
    docs = frame(spark)
    one = plain(mixing.training_mix(docs.repartition(1)).drop("positions"))
    assert one == plain(mixing.training_mix(docs.repartition(7, "lang")).drop("positions"))


def test_stream_takes_what_the_mix_says(spark):
    docs = clashing(frame(spark), ["size", "_tw_at", "target"])
    stream = mixing.mixed_documents(docs)
    assert stream.columns == docs.columns
    met = defaultdict(int)
    for r in stream.collect():
        met[(r.doc_id, r.text)] += 1
    wanted = defaultdict(int)
    for doc, size, taken in mixing.training_mix(docs).select("doc_id", "size", "taken").collect():
        wanted[doc] += taken // size if size else 0
    by_id = defaultdict(int)
    for (doc, _), n in met.items():
        by_id[doc] += n
    assert by_id == {k: v for k, v in wanted.items() if v}


def test_rates_change_over_time(spark):
    rows = [(n, "w " * 10, "en", "a" if n % 2 else "b") for n in range(2000)]
    plan = mixing.Plan(weights=(1, 1), budget=1.0, schedules=((1.8, 0.2), (0.2, 1.8)))
    early = np.mean([r.source == "a" for r in mixing.training_mix(frame(spark, rows), plan=plan).collect()[:500]])
    assert early > 0.75


def test_empty(spark):
    assert mixing.training_mix(frame(spark, [], SCHEMA)).collect() == []
    assert mixing.mixed_documents(frame(spark, [], SCHEMA)).collect() == []
