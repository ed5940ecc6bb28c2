import json
import os

from pyspark.sql import functions as F

from tablewright.sources import menus
from tablewright.streaming import snapshots as streams


def put(folder, name, text, stamp):
    path = folder / name
    path.write_text(text, newline="")
    os.utime(path, (stamp, stamp))


def drain(frame, name, mode, folder):
    query = (
        frame.writeStream.format("memory")
        .queryName(name)
        .outputMode(mode)
        .option("checkpointLocation", str(folder))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return frame.sparkSession.table(name)


def test_latest_menus_survive_empty_fetches(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    put(inbox, "1.txt", "A - 8 am - 9 am\n  C:\n    - old\n\nB\n  C:\n    - keep\n", 1_700_000_000)
    put(inbox, "2.txt", "A - 9 am - 10 am\n  C:\n    - new\n    - more\n", 1_700_000_900)
    put(inbox, "3.txt", "", 1_700_001_800)
    rows = drain(streams.stream_latest_menus(spark, str(inbox)), "latest_menus", "complete", tmp_path / "c1")
    got = {r["restaurant"]: (r["hours"], r["item_count"], r["categories"][0]["meals"]) for r in rows.collect()}
    assert got == {"A": ("9 am - 10 am", 2, ["new", "more"]), "B": ("", 1, ["keep"])}


def test_streamed_rows_equal_batch_rows(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    put(inbox, "1.txt", "A\n  C:\n    - x\n    - y\n", 1_700_000_000)
    rows = drain(streams.stream_menu_snapshots(spark, str(inbox)), "menu_rows", "append", tmp_path / "c1")
    assert [(r["restaurant"], r["category"], r["meal"]) for r in rows.orderBy("item_ord").collect()] == [("A", "C", "x"), ("A", "C", "y")]


def test_streamed_documents_and_calendars(spark, tmp_path):
    docs, cals = tmp_path / "docs", tmp_path / "cals"
    docs.mkdir(), cals.mkdir()
    document = {"restaurants": [{"name": "R", "categories": [{"name": "C", "meals": [{"name": "M", "is_halal": True}]}]}]}
    put(docs, "1.json", json.dumps(document, indent=1), 1_700_000_000)
    rows = drain(streams.stream_menu_documents(spark, str(docs)), "menu_docs", "append", tmp_path / "c1").collect()
    assert [(r["restaurant"], r["meal"], r["is_halal"]) for r in rows] == [("R", "M", True)]
    put(cals, "1.ics", "BEGIN:VEVENT\r\nSUMMARY:T\r\n alk\r\nDTSTART:20240101T000000Z\r\nEND:VEVENT\r\n", 1_700_000_000)
    events = drain(streams.stream_calendars(spark, str(cals)), "cal_events", "append", tmp_path / "c2").collect()
    assert [e["title"] for e in events] == ["Talk"]


def test_latest_snapshot_on_a_batch(spark):
    rows = spark.createDataFrame([("a", 1, "x", "p"), ("a", 3, "y", "q"), ("b", 2, "z", "r")], "k string, snapshot_ts int, snapshot_id string, v string")
    got = {tuple(r) for r in streams.latest_snapshot(rows, ["k"], ["v"]).select("k", "v").collect()}
    assert got == {("a", "q"), ("b", "r")}
    assert {tuple(r) for r in streams.latest_snapshot(rows, ["k"], ["v"], F.col("snapshot_ts")).collect()} == {("a", "q"), ("b", "r")}


def test_current_table_equals_the_batch_after_each_trigger(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    path, state = str(tmp_path / "table"), str(tmp_path / "state")
    rounds = [
        {"1.txt": "A - 8 am - 9 am\n  C:\n    - old\n\nB\n  C:\n    - keep\n"},
        {"2.txt": "A - 9 am - 10 am\n  C:\n    - new\n"},
        {"3.txt": "D\n  C:\n    - first\n"},
        {"4.txt": "D\n  C:\n    - second\n"},
    ]
    for n, files in enumerate(rounds):
        for name, text in files.items():
            put(inbox, name, text, 1_700_000_000 + n * 900)
        latest = streams.stream_latest_menus(spark, str(inbox))
        streams.write_latest(latest, path, state, ["restaurant"]).awaitTermination()
        rows = streams.read_latest(spark, path)
        batch = menus.parse_menu_restaurants(menus.read_snapshot_texts(spark, str(inbox)))
        wanted = streams.latest_snapshot(batch, ["restaurant"], ["hours", "item_count"])
        assert {tuple(r) for r in rows.select("restaurant", "hours", "item_count").collect()} == {tuple(r) for r in wanted.collect()}
        versions = [p.name for p in (tmp_path / "table").iterdir() if p.name.startswith("version-")]
        assert len(rows.inputFiles()) > 0 and len(versions) <= 2


def test_newest_documents_and_events(spark, tmp_path):
    docs, cals = tmp_path / "docs", tmp_path / "cals"
    docs.mkdir(), cals.mkdir()
    meal = lambda name: {"restaurants": [{"name": "R", "categories": [{"name": "C", "meals": [{"name": name}]}]}, {"name": "Q"}]}
    for n, name in enumerate(("old", "new")):
        put(docs, f"{n}.json", json.dumps(meal(name)), 1_700_000_000 + n)
        text = f"BEGIN:VEVENT\r\nUID:u\r\nSUMMARY:{name}\r\nDTSTART:20240101T000000Z\r\nEND:VEVENT\r\n"
        put(cals, f"{n}.ics", text, 1_700_000_000 + n)
    put(docs, "2.json", json.dumps({"restaurants": [{"name": "R", "categories": []}]}), 1_700_000_002)
    rows = drain(streams.stream_latest_documents(spark, str(docs)), "new_docs", "complete", tmp_path / "c1").collect()
    assert [(r["restaurant"], r["categories"][0]["meals"][0]["name"]) for r in rows] == [("R", "new")]
    events = drain(streams.stream_latest_events(spark, str(cals)), "new_events", "complete", tmp_path / "c2").collect()
    assert [(e["id"], e["title"]) for e in events] == [("u", "new")]
