import math
import zlib

import numpy as np
import pytest
from helpers import SCHEMA, awkward, clashing, frame
from pyspark.sql import functions as F

from tablewright.llm import sharding


@pytest.mark.parametrize("rows,good,taken", [(20, 7, 9), (100, 4, 50), (60, 60, 10), (5, 0, 3), (1000, 300, 400)])
def test_draws_have_the_law(spark, rows, good, taken):
    """Quantiles of the inverted distribution: each value gets its own part of (0, 1)."""
    n = 4000
    grid = spark.range(n).selectExpr(f"{rows}L AS r", f"{good}L AS g", f"{taken}L AS t", f"(id + 0.5D) / {n} AS u")
    found = grid.select(F.expr(sharding.draw("r", "g", "t", "u")).alias("k")).groupBy("k").count().collect()
    for r in found:
        chance = math.comb(good, r.k) * math.comb(rows - good, taken - r.k) / math.comb(rows, taken)
        assert r["count"] / n == pytest.approx(chance, abs=1.5 / n)
    assert sum(r["count"] for r in found) == n


def test_large_draws_stay_in_range(spark):
    rows, good, taken = 10**11, 4 * 10**9, 5 * 10**10
    grid = spark.range(40).selectExpr(f"{rows}L AS r", f"{good}L AS g", f"{taken}L AS t", "(id + 0.5D) / 40 AS u")
    found = [r.k for r in grid.select(F.expr(sharding.draw("r", "g", "t", "u")).alias("k")).collect()]
    spread = math.sqrt(taken * (good / rows) * (1 - good / rows) * (rows - taken) / (rows - 1))
    assert abs(np.mean(found) - taken * good / rows) < spread / 2 and 0.8 < np.std(found) / spread < 1.2


@pytest.mark.parametrize("sizes", [[5], [3, 0, 9, 1, 1, 40, 7], [1000, 2000, 1]])
def test_matrix_sums(spark, sizes):
    counts = spark.createDataFrame([(b, n) for b, n in enumerate(sizes)], "block long, n long")
    for seed in (1, 2):
        found = {r.block: r.sends for r in sharding.communication_matrix(counts, 6, seed).collect()}
        assert {b: sum(s) for b, s in found.items()} == dict(enumerate(sizes))
        total = sum(sizes)
        assert [sum(s[i] for s in found.values()) for i in range(6)] == [total // 6 + (i < total % 6) for i in range(6)]


def test_matrix_has_the_law(spark):
    """Means and variances over seeds are those of a random arrangement."""
    counts = spark.createDataFrame([(0, 30), (1, 10), (2, 20)], "block long, n long")
    drawn = np.array([[r.sends for r in sharding.communication_matrix(counts, 4, s).orderBy("block").collect()] for s in range(30)])
    for b, n in enumerate((30, 10, 20)):
        variance = 15 * (n / 60) * (1 - n / 60) * 45 / 59
        assert drawn[:, b].mean() == pytest.approx(n / 4) and drawn[:, b, 0].std() ** 2 == pytest.approx(variance, rel=0.8)


def test_shards_of_documents(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 3)
    rows = awkward() + [(7000 + n % 3, "same row", "en", "a") for n in range(400)]
    docs = clashing(frame(spark, rows).repartition(5), ["slot", "_tw_key", "block", "n"])
    made = sharding.uniform_shards(docs).collect()
    assert sorted(((r.doc_id, r.text) for r in made), key=repr) == sorted(((i, t) for i, t, *_ in rows), key=repr)
    slots = {}
    for r in made:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_few_rows_and_empty(spark):
    few = sharding.uniform_shards(frame(spark, awkward()[:3])).collect()
    assert sorted((r.shard, r.slot) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert sharding.uniform_shards(frame(spark, [], SCHEMA)).collect() == []


def test_size_and_checksum(spark):
    docs = frame(spark).select("text", sharding.text_size(F.col("text")).alias("s"), sharding.text_crc32(F.col("text")).alias("c"))
    for r in docs.collect():
        data = (r.text or "").encode()
        assert (r.s, r.c) == (len(data) + 8, zlib.crc32(data))
