"""Current tables in buckets and the index kept on them, against recomputing from scratch."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators import stats
from tablewright.streaming.current import CurrentTable
from tablewright.streaming.index import KeptIndex, keep_index

SCHEMA = "k long, v string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def held(path):
    return {p: p.stat().st_size for p in path.rglob("*.parquet") if p.is_file()}


def read(table, **how):
    return {r.k: r.v for r in table.read(**how).collect()}


@pytest.mark.parametrize("buckets", [1, 8])
def test_any_batches_give_the_newest_rows(spark, tmp_path, buckets):
    dice, wanted = random.Random(buckets), {}
    table = CurrentTable(spark, str(tmp_path / "t"), ["k"], buckets=buckets)
    for number in range(9):
        rows = {dice.choice([None, *range(40)]): f"{number}" for _ in range(dice.choice([0, 1, 30]))}
        wanted.update(rows)
        table.merge(number, frame(spark, list(rows.items())))
        assert read(table) == wanted and table.versions()[-1] == number
    assert len(table.versions()) == 2


def test_a_batch_writes_its_own_rows(spark, tmp_path):
    """What a batch writes does not grow with the table, and all batches together write a fixed multiple of their rows."""
    path = tmp_path / "t"
    written = {}
    for size in (2_000, 40_000):
        table = CurrentTable(spark, str(path / str(size)), ["k"], buckets=8)
        table.merge(0, spark.range(size).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("v")))
        before = held(path)
        table.merge(1, frame(spark, [(n * 17, "new") for n in range(40)]))
        written[size] = sum(n for p, n in held(path).items() if p not in before)
        assert {k: v for k, v in read(table).items() if v == "new"} == {n * 17: "new" for n in range(40)}
        assert table.read().count() == size
    assert written[40_000] < 1.5 * written[2_000] and written[40_000] < 0.05 * sum(held(path / "40000").values())
    # Each row is written once in its batch, and at most about twice more by rewriting of buckets.
    table = CurrentTable(spark, str(path / "many"), ["k"], buckets=2)
    total = 0
    for number in range(12):
        before = held(path / "many")
        table.merge(number, spark.range(number * 500, number * 500 + 500).select(F.col("id").alias("k"), F.lit("x").alias("v")))
        new = [p for p in held(path / "many") if p not in before]
        total += spark.read.parquet(*map(str, new)).count()
    assert table.read().count() == 6_000 and 6_000 <= total <= 3 * 6_000


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    table = CurrentTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    table.merge(0, frame(spark, [(1, "a"), (2, "b"), (3, "c")]))
    for rows in ([(2, "half"), (9, "lost")], [(2, "x"), (4, "d")]):  # the second run counts
        table.merge(1, frame(spark, rows))
    assert read(table) == {1: "a", 2: "x", 3: "c", 4: "d"}
    assert read(table, before=1) == {1: "a", 2: "b", 3: "c"}  # readers of the version before
    table.merge(2, frame(spark, [(5, "e")]))
    assert read(table) == {1: "a", 2: "x", 3: "c", 4: "d", 5: "e"}


def test_an_unfinished_version_is_not_read(spark, tmp_path):
    table = CurrentTable(spark, str(tmp_path / "t"), ["k"])
    assert table.read() is None
    table.merge(0, frame(spark, [(1, "a")]))
    table.merge(1, frame(spark, [(1, "b")]))
    (tmp_path / "t" / "version-1" / "_SUCCESS").rename(tmp_path / "t" / "version-1" / "gone")
    assert read(table) == {1: "a"}
    table.merge(1, frame(spark, [(1, "c")]))
    assert read(table) == {1: "c"}


def test_rows_that_are_not_live_go(spark, tmp_path):
    table = CurrentTable(spark, str(tmp_path / "t"), ["k"], live="v <> 'gone'", buckets=1)
    table.merge(0, frame(spark, [(1, "a"), (2, "b")]))
    table.merge(1, frame(spark, [(1, "gone")]))
    assert read(table) == {2: "b"}
    table.merge(2, frame(spark, [(2, "gone"), (3, "c")]))  # as many rows as the first layer: rewritten
    assert read(table) == {3: "c"} and len(table._load(None)["layers"]["0"]) == 1
    assert sum(spark.read.parquet(str(p)).count() for p in held(tmp_path / "t") if "b000000000002-1" in str(p)) == 1


# --- index ----------------------------------------------------------------------------------

ITEMS = "restaurant string, category string, is_halal boolean, item_ord long, snapshot_ts long, snapshot_id string"


def snapshot(dice, number):
    """Sections of some restaurants; names and categories may be null, categories come back."""
    rows, ord_ = [], 0
    for name in dice.sample(["Ann", "Bob", "Cy's", "Dee", None], dice.randint(0, 4)):
        for _ in range(dice.randint(1, 12)):
            rows.append((name, dice.choice(["Soup", "Bread", "Tea", None]), dice.choice([True, False, None]), ord_, number, f"s{number}"))
            ord_ += 1
    return rows


def from_scratch(spark, rows):
    newest = {}
    for r in rows:
        newest[r[0]] = max(newest.get(r[0], (-1, "")), (r[4], r[5]))
    items = frame(spark, [r for r in rows if newest[r[0]] == (r[4], r[5])], ITEMS)
    index = stats.restaurant_index(items)
    return index, stats.summary_stats(index), items


def check(spark, kept, rows):
    index, summary, items = from_scratch(spark, rows)
    assert {tuple(r) for r in kept.restaurant_index().select(*index.columns).collect()} == {tuple(r) for r in index.collect()}
    assert kept.summary_stats().select(*summary.columns).first() == summary.first()
    wanted = items.groupBy("category").agg(F.count("*"), F.count_if(F.coalesce("is_halal", F.lit(False))), F.count_distinct(F.coalesce("restaurant", F.lit("null"))))
    got = kept.category_totals().select("category", "total_items", "halal_items", "restaurants")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in wanted.collect()}


def test_index_equals_one_from_scratch_after_every_batch(spark, tmp_path):
    dice, rows = random.Random(7), []
    kept = KeptIndex(spark, str(tmp_path / "kept"), buckets=4)
    for number in range(5):
        # Two snapshots in one batch; a late one now and then.
        batch = snapshot(dice, 10 * number) + snapshot(dice, 10 * number + 1) + (snapshot(dice, 3) if number == 3 else [])
        rows += batch
        if number == 2:  # a first run that died
            kept.sections.merge(2, frame(spark, [("Ann", "Soup", 99, 9, 0, (1, "x"))], "restaurant string, category string, total_items long, halal_items long, ord long, stamp struct<snapshot_ts:long,snapshot_id:string>"))
        kept.add(frame(spark, batch, ITEMS), number)
        check(spark, kept, rows)
    kept.add(frame(spark, batch, ITEMS), 4)  # again
    check(spark, kept, rows)


def test_index_kept_by_a_stream(spark, tmp_path):
    dice, rows = random.Random(8), []
    path, inbox = str(tmp_path / "kept"), tmp_path / "in"
    for number in range(3):
        rows += snapshot(dice, number) or [("Ann", "Soup", True, 0, number, f"s{number}")]
        frame(spark, [r for r in rows if r[4] == number], ITEMS).coalesce(1).write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema(ITEMS).parquet(str(inbox))
        keep_index(stream, path, str(tmp_path / "state"), buckets=2).awaitTermination()
        check(spark, KeptIndex(spark, path), rows)
