"""Ordered steps on streams against the same steps on all rows at once."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators import ordering as O
from tablewright.streaming import ordered as S

START = 1_700_000_000
ROWS = "stream string, pos long, kind string, text string"


def headers():
    kind = F.col("kind")
    return [("outer", kind.isin("outer", "both"), F.col("text")), ("inner", kind.isin("inner", "both"), F.col("text"))]


def run(spark, frame, schema, batches, folder, build, name):
    """Feed batches one after the other; rows of the result, and the states kept after each."""
    inbox, states = folder / "in", []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(inbox))
        read = spark.readStream.schema(schema).parquet(str(inbox))
        writer = build(frame(read)).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state"))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        states.append(sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]) if query.lastProgress else 0)
    return spark.read.parquet(str(folder / "out")).collect(), states


@pytest.mark.parametrize("cuts", [1, 4])
def test_any_cut_gives_the_batch_result(spark, tmp_path, cuts):
    dice, rows = random.Random(cuts), []
    for pos in range(90):
        key = dice.choice(["hot", "hot", "hot", "a", None])
        rows.append((key, pos, dice.choices(["outer", "inner", "both", "item", None], [1, 2, 0.5, 9, 1])[0], dice.choice([f"t{pos}", None])))
    borders = sorted(dice.sample(range(1, 90), cuts - 1))
    batches = [rows[a:b] for a, b in zip([0, *borders], [*borders, 90])]
    for batch in batches:
        dice.shuffle(batch)
    got, states = run(spark, lambda r: r, ROWS, batches, tmp_path, lambda r: S.carry_forward_stream(r, ["stream"], "pos", headers()), "carried")
    names = ["stream", "pos", "kind", "text", "outer", "outer_pos", "inner", "inner_pos"]
    wanted = O.carry_forward(spark.createDataFrame(rows, ROWS), ["stream"], "pos", headers(), 7).select(*names).collect()
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got))) == sorted(map(repr, map(tuple, wanted)))
    assert not any(r["late"] for r in got) and states[-1] == 3  # one state for each key


def test_late_rows_say_so(spark, tmp_path):
    batches = [[("a", 1, "outer", "x"), ("a", 5, "item", "i")], [("a", 3, "outer", "late"), ("a", 6, "item", "j"), ("b", 2, "item", "k")]]
    got, _ = run(spark, lambda r: r, ROWS, batches, tmp_path, lambda r: S.carry_forward_stream(r, ["stream"], "pos", headers()), "late")
    assert {(r["stream"], r["pos"], r["outer"], r["late"]) for r in got} == {
        ("a", 1, "x", False), ("a", 5, "x", False), ("a", 3, None, True), ("a", 6, "x", False), ("b", 2, None, False)
    }


def test_state_goes_with_its_snapshot(spark, tmp_path):
    dice, batches = random.Random(3), []
    for snapshot in range(6):
        rows = [(dice.choice("abcde"), n, f"v{n}", START + snapshot * 1800) for n in range(40)]
        batches.append(rows)
    schema = "k string, n long, v string, s long"
    timed = lambda r: r.select("k", "n", "v", F.timestamp_seconds("s").alias("snapshot_ts"))
    every = timed(spark.createDataFrame([r for b in batches for r in b], schema))
    delay = "10 minutes"
    (tmp_path / "1").mkdir(), (tmp_path / "2").mkdir()
    seen, states = run(spark, timed, schema, batches, tmp_path / "1", lambda r: S.first_seen_stream(r, ["k"], "n", delay=delay), "seen")
    done = every.where(F.col("snapshot_ts") < F.timestamp_seconds(F.lit(START + 5 * 1800)))
    wanted = O.dedup_first_seen(done, ["k", "snapshot_ts"], "n").collect()
    assert {(r["k"], r["snapshot_ts"], r["n"]) for r in seen} == {(r["k"], r["snapshot_ts"], r["n"]) for r in wanted}
    assert max(states) <= 2 * 5 and states[-1] <= 5  # keys of the open snapshot only
    first, _ = run(spark, timed, schema, batches, tmp_path / "2", lambda r: S.first_wins_stream(r, ["k"], F.col("n"), ["v"], delay=delay), "first")
    wanted = O.first_wins(done, ["k", "snapshot_ts"], F.col("n"), ["v"]).collect()
    assert {(r["k"], r["snapshot_ts"], r["v"]) for r in first} == {(r["k"], r["snapshot_ts"], r["v"]) for r in wanted}
