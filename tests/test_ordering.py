"""Order-dependent operators against plain Python, with one hot key and small blocks."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators import joins
from tablewright.operators import ordering as O


def naive_carry(rows):
    out, heads = [], {}
    for stream, pos, kind, text in sorted(rows):
        outer, inner = heads.get(stream, (None, None))
        if kind == "outer":
            outer, inner = text, None
        if kind == "inner":
            inner = text
        heads[stream] = (outer, inner)
        out.append((stream, pos, outer, inner))
    return out


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_carry_forward(spark, block):
    pick = random.Random(block)
    rows = []
    for stream, size in (("hot", 120), ("a", 11), ("b", 1), ("c", 25)):
        for pos in sorted(pick.sample(range(size * 3), size)):
            kind = pick.choices(["outer", "inner", "item"], [1, 2, 12])[0]
            rows.append((stream, pos, kind, f"{kind}{pos}"))
    frame = spark.createDataFrame(rows, "stream string, pos int, kind string, text string").repartition(3)
    headers = [("outer", F.col("kind") == "outer", F.col("text")), ("inner", F.col("kind") == "inner", F.col("text"))]
    got = O.carry_forward(frame, ["stream"], "pos", headers, block).select("stream", "pos", "outer", "inner").collect()
    assert sorted(map(tuple, got)) == naive_carry(rows)


def test_with_position_on_a_hot_key(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"),
        (F.col("id") * 7919 % 50).alias("v"),
        "id",
    )
    placed = O.with_position(rows, ["k"], ["v", "id"], "place", F.floor(F.col("v") / 3)).collect()
    groups = {}
    for r in placed:
        groups.setdefault(r["k"], []).append((r["v"], r["id"], r["place"]))
    assert len(placed) == 3000
    for group in groups.values():
        assert [p for _, _, p in sorted(group)] == list(range(1, len(group) + 1))


@pytest.fixture()
def many_partitions(spark):
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def hot_events(spark):
    """Half of all events have one start, a sixth has none; the parts lie in any order."""
    start = F.when(F.col("id") % 2 == 0, F.lit(7200)).when(F.col("id") % 3 == 0, None).otherwise(F.col("id") * 7919 % 500_000)
    rows = spark.range(0, 24_000, 1, 7).select(F.timestamp_seconds(start).alias("start"), (F.col("id") * 7 % 24_000).alias("ord"))
    return rows.withColumn("end", F.col("start"))


@pytest.mark.parametrize("way", ["sort_events", "unparseable_last", "past_desc"])
def test_a_hot_start_is_numbered_by_many_tasks(spark, many_partitions, way):
    from tablewright.operators import calendar as C

    events = hot_events(spark)
    clock = lambda r: r.start.timestamp() if r.start else -1
    made, order, key = {
        "sort_events": (C.event_positions, ["start", "ord"], lambda r: (clock(r), r.ord)),
        "unparseable_last": (C.event_positions_unparseable_last, [F.asc_nulls_last("start"), "ord"], lambda r: (r.start is None, clock(r), r.ord)),
        "past_desc": (C.past_positions, [F.desc("start"), "ord"], lambda r: (-clock(r), r.ord)),
    }[way]
    assert O.largest_range(events, [], order) < 2 * 24_000 / 16
    placed = sorted(made(events).collect(), key=key)
    assert [r.position for r in placed] == list(range(1, 24_001))


def test_days_and_their_hot_starts(spark, many_partitions):
    from tablewright.operators import calendar as C

    events = hot_events(spark)
    assert O.largest_range(C.with_day(events), ["date_key"], ["start", "ord"]) < 2 * 24_000 / 16
    days = {}
    for r in C.events_by_day(events).collect():
        days.setdefault(r.date_key, []).append((r.start.timestamp() if r.start else -1, r.ord, r.day_position))
    assert sum(map(len, days.values())) == 24_000 and None in days and len(days) > 5
    for rows in days.values():
        assert [p for _, _, p in sorted(rows)] == list(range(1, len(rows) + 1))


def test_range_positions_of_nothing_and_of_equal_rows(spark):
    none = spark.range(0).select(F.col("id").alias("k"), "id")
    assert O.range_positions(none, ["k"], ["id"], "place").collect() == []
    same = spark.range(100).select(F.lit(None).cast("string").alias("k"), F.lit(1).alias("v"), F.lit("x").alias("position"))
    assert sorted(r.place for r in O.range_positions(same, ["k"], ["v"], "place").collect()) == list(range(1, 101))


def test_keyed_dedup(spark):
    rows = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), ("a", 9, "w")], "k string, o int, v string")
    assert {tuple(r) for r in O.first_wins(rows, ["k"], F.col("o"), ["v"]).collect()} == {("a", "y"), ("b", "z")}
    assert {tuple(r) for r in O.last_wins(rows, ["k"], F.col("o"), ["v"]).collect()} == {("a", "w"), ("b", "z")}
    assert {tuple(r) for r in O.dedup_first_seen(rows, ["k"], "o").collect()} == {("a", 1), ("b", 2)}


def test_top_k_keeps_input_order_of_ties(spark):
    rows = spark.createDataFrame([(n, n % 2, n) for n in range(20)], "name int, v int, ord int")
    assert [r["name"] for r in O.top_k(rows, "v", "ord", 4).collect()] == [1, 3, 5, 7]


def test_first_k_limits_before_the_shuffle(spark):
    rows = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    plan = O.first_k_per_key(rows, ["k"], ["id"], 3, "rank")
    assert sorted(r["id"] for r in plan.collect()) == [0, 1, 2, 3, 4, 5]
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_join_lookup(spark):
    rows = spark.range(200).select((F.col("id") % 10).alias("k"), "id")
    lookup = spark.range(5).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"))
    got = {(r["id"], r["v"]) for r in joins.join_lookup(rows, lookup, ["k"]).collect()}
    assert got == {(n, f"v{n % 10}" if n % 10 < 5 else None) for n in range(200)}
    odd = spark.createDataFrame([(None, 1), ("a", 2)], "k string, n int")
    names = spark.createDataFrame([(None, "x")], "k string, w string")
    assert {tuple(r) for r in joins.join_lookup(odd, names, ["k"], null_safe=True).collect()} == {(None, 1, "x"), ("a", 2, None)}


@pytest.mark.parametrize("block", [1, 2, 100])
def test_a_stream_without_a_key_is_carried_over_blocks(spark, block):
    rows = spark.createDataFrame([(None, n, n == 0) for n in range(4)], "k string, pos int, head boolean")
    got = O.carry_forward(rows, ["k"], "pos", [("h", F.col("head"), F.lit("x"))], block).collect()
    assert [r["h"] for r in got] == ["x"] * 4


def test_building_a_plan_runs_nothing(spark):
    rows = spark.range(50).select((F.col("id") % 5).cast("string").alias("k"), "id")
    tracker, group = spark.sparkContext.statusTracker(), "plan-only"
    spark.sparkContext.setJobGroup(group, group)
    O.with_position(rows, ["k"], ["id"], "place", F.col("id"))
    O.carry_forward(rows, ["k"], "id", [("h", F.col("id") == 0, F.col("k"))])
    joins.join_lookup(rows, rows.withColumnRenamed("id", "n"), ["k"])
    assert not tracker.getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_hot_keys_of_a_large_lookup_join_are_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 200_000, 1, 8).select(F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id") % 1000).alias("k"), F.md5(F.col("id").cast("string")).alias("v"))
        lookup = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
        joined = joins.join_lookup(rows, lookup, ["k"])
        assert joined.where("w = k * 2").count() == 200_000
        joined.write.format("noop").mode("overwrite").save()
        plan = joined._jdf.queryExecution().executedPlan()
        joined.collect()
        assert "skew=true" in plan.toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
