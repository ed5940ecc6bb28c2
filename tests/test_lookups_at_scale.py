"""As-of lookups, minute bitmaps and searches for many texts against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tablewright.functions import hours as H
from tablewright.operators import ordering as O
from tablewright.operators import search as S
from tablewright.operators import timetable as T


@pytest.mark.parametrize("partitions", ["1", "4", "13"])
def test_first_after(spark, partitions):
    dice = random.Random(int(partitions))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    settings = {"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        key = lambda: dice.choice(["hot", "hot", "hot", "a", "b", None])
        entries = [(key(), dice.choice([None, *range(40)]), n) for n in range(300)]  # many at one time
        rows = [(n, key(), dice.choice([None, *range(-1, 42)]), "x") for n in range(300)]
        made = O.first_after(
            spark.createDataFrame(rows, "n int, k string, t int, value string"), spark.createDataFrame(entries, "k string, u int, e int"),
            ["k"], "t", "u", F.struct("e"), "found",
        )
        assert made.columns == ["n", "k", "t", "value", "found"]
        got = {r["n"]: r["found"] and r["found"]["e"] for r in made.collect()}
        later = lambda k, t: [e for x, u, e in entries if x == k and None not in (k, t, u) and u > t]
        assert got == {n: min(later(k, t), default=None) for n, k, t, _ in rows}
        none = spark.createDataFrame([], "k string, u int, e int")
        empty = O.first_after(spark.createDataFrame(rows, "n int, k string, t int, value string"), none, ["k"], "t", "u", F.struct("e"), "found")
        assert {r["found"] for r in empty.collect()} == {None}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_day_with_thousands_of_entries(spark):
    base = dt.datetime(2024, 3, 10, 6, 0)
    entries = spark.range(4000).select(F.lit("hall").alias("place"), F.timestamp_seconds(F.lit(int(base.replace(tzinfo=dt.timezone.utc).timestamp())) + F.col("id") * 13).alias("utc_ts"), F.col("id").alias("no"))
    asked = entries.where("no % 500 = 250").select("place", F.col("utc_ts").alias("ts"), F.col("no").alias("mine"))
    found = T.next_entry(asked, "ts", entries, ["place"], F.struct("no"), minutes=1).collect()
    # One is over 60 seconds after its start: four earlier ones still go on.
    assert {(r["mine"], r["next"]["no"]) for r in found} == {(n, n - 4) for n in range(250, 4000, 500)}


def test_minute_bits(spark):
    dice = random.Random(2)
    days = [None, [], [(0, 1440)], [(63, 64)], [(64, 65)], [(0, 64), (64, 128)], [(1320, 120)], [(700, 800), (750, 900)]]
    days += [[tuple(sorted(dice.sample(range(1441), 2))) for _ in range(dice.randint(1, 4))] for _ in range(25)]
    minutes = [0, 63, 64, 127, 719, 720, 1320, 1439, *dice.sample(range(1440), 12)]
    table = spark.createDataFrame([(n, d) for n, d in enumerate(days)], "n int, r array<struct<start_min:int,end_min:int>>")
    table = table.withColumn("b", H.minute_bits("r")).crossJoin(spark.createDataFrame([(m,) for m in minutes], "m int"))
    lengths = (1, 5, 64, 130)
    got = table.select("n", "m", H.is_open("r", "m").alias("o"), H.is_open_bits("b", "m").alias("p"), H.open_minutes("b").alias("c"), *[H.is_open_for("b", "m", k).alias(f"f{k}") for k in lengths])
    for r in got.collect():
        day = days[r["n"]]
        assert r["o"] == r["p"]
        if day is None:
            assert r["p"] is None and r["c"] is None and all(r[f"f{k}"] is None for k in lengths)
            continue
        opened = {m for a, b in day for m in range(a, b)}
        assert r["p"] == (r["m"] in opened) and r["c"] == len(opened)
        for k in lengths:
            assert r[f"f{k}"] == all(m in opened for m in range(r["m"], r["m"] + k))


def test_search_many(spark):
    dice = random.Random(4)
    words = ["Soup", "ÉCLAIR", "Tea", "tea", "a", None, "x y", "Sou", "", "Chai"]
    rows = [(n, " ".join(filter(None, dice.choices(words, k=2))), dice.choice(words), dice.choice(words)) for n in range(80)]
    items = spark.createDataFrame(rows, "item int, meal string, category string, restaurant string")
    texts = ["soup", " SOUP ", "é", "ea", "a t", "zzz", "o", "upx", "", None, "  ", "éclair", "soup tea", "ou"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    found = S.search_many(items, asked)
    assert found.columns == ["query_id", "item", "meal", "category", "restaurant"]
    got = {q: set() for q in range(len(texts))}
    for r in found.collect():
        assert r["item"] not in got[r["query_id"]]
        got[r["query_id"]].add(r["item"])
    for q, text in enumerate(texts):
        wanted = {r["item"] for r in S.search_menu(items, text).collect()} if text and text.strip() else set()
        assert got[q] == wanted, text
    assert "Cartesian" not in found._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
