import datetime as dt
import json

from pyspark.sql import functions as F

from tablewright.operators import calendar as C
from tablewright.operators import timetable as T
from tablewright.sinks import writers as W
from tablewright.sources import timetable as source

FEED = T.Feed("t.example.org", "-//E//T//EN", "Times", "All, times", "1 Main, Town", " time; now")


def stored(day, hijri=True, **times):
    timings = {"Fajr": "05:03 (EDT)", "Dhuhr": "12:01 (EDT)", "Asr": "15:40", "Maghrib": "18:10", "Isha": "19:30", "Sunrise": "06:20 (EDT)"}
    timings.update(times)
    timings = {k: v for k, v in timings.items() if v}
    date = {"gregorian": {"date": day}}
    if hijri:
        date["hijri"] = {"day": "8", "year": "1448", "month": {"en": "Safar"}}
    return {"timings": timings, "date": date}


def days(spark, folder):
    data = [stored("09-03-2024"), stored("10-03-2024", False, Asr=None, Sunrise=None), stored("31-12-2024", Isha="late")]
    (folder / "month.json").write_text(json.dumps({"code": 200, "data": data}))
    return T.timetable_day(source.read_timetable_json(spark, str(folder / "month.json")))


def test_days_and_slots(spark, tmp_path):
    rows = days(spark, tmp_path).orderBy("date").collect()
    assert rows[0]["hijri"] == "Safar 8, 1448 AH" and rows[0]["Fajr"] == "05:03" and rows[0]["sunrise"] == "06:20"
    assert rows[1]["hijri"] is None and rows[1]["Asr"] == "" and rows[1]["sunrise"] is None
    slots = T.unpivot_slots(days(spark, tmp_path), sunrise=True)
    got = {(str(r["date"]), r["slot"]): r for r in slots.collect()}
    assert len(got) == 17 and got[("2024-03-09", "Sunrise")]["slot_ord"] == 1
    assert got[("2024-03-09", "Fajr")]["utc_ts"] == dt.datetime(2024, 3, 9, 10, 3)
    assert got[("2024-03-10", "Fajr")]["utc_ts"] == dt.datetime(2024, 3, 10, 9, 3)
    assert got[("2024-03-10", "Asr")]["utc_ts"] is None and got[("2024-12-31", "Isha")]["display"] is None
    assert T.valid_slots(slots).count() == 15


def test_next_slot(spark, tmp_path):
    slots = T.unpivot_slots(days(spark, tmp_path), sunrise=True)
    stamps = ["2024-03-09 10:07:59", "2024-03-09 10:08:00", "2024-03-10 17:00:00", "2024-03-10 23:34:59", "2024-06-01 12:00:00", "2025-01-01 04:00:00"]
    instants = spark.createDataFrame([(n, s) for n, s in enumerate(stamps)], "n int, s string").select("n", F.col("s").cast("timestamp").alias("ts"))
    found = {r["n"]: (r["next_index"], r["next_name"]) for r in T.next_slot(instants, "ts", slots).collect()}
    assert found == {0: (0, "Fajr"), 1: (2, "Dhuhr"), 2: (4, "Maghrib"), 3: (5, "Isha"), 4: (-1, None), 5: (-1, None)}


def test_today_and_months(spark, tmp_path):
    table = days(spark, tmp_path)
    assert T.today_row(table, F.lit("2024-03-10 04:30:00").cast("timestamp")).count() == 1
    assert T.today_row(table, F.lit("2024-03-11 04:30:00").cast("timestamp")).count() == 0
    december = F.lit("2024-12-05 00:00:00").cast("timestamp")
    assert T.feed_months(table, december).count() == 1
    assert T.union_months(table, table).count() == 6


def test_feed_round_trip(spark, tmp_path):
    slots = T.unpivot_slots(days(spark, tmp_path))
    twice = slots.unionByName(slots).withColumn("place", F.lit("x"))
    feed = T.ics_feed(twice, F.lit("2024-03-05 00:00:00").cast("timestamp"), FEED, ["place"])
    text = feed.first()["value"]
    assert text.startswith("BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//E//T//EN\r\n") and text.endswith("END:VEVENT\r\nEND:VCALENDAR\r\n")
    assert text.count("BEGIN:VEVENT") == 9
    assert "UID:fajr-2024-03-09@t.example.org\r\nDTSTAMP:20240305T000000Z\r\nDTSTART:20240309T100300Z\r\nDTEND:20240309T100800Z\r\nSUMMARY:Fajr\r\nDESCRIPTION:Fajr time\\; now\r\nLOCATION:1 Main\\, Town\r\nTRANSP:TRANSPARENT\r\n" in text
    events = C.parse_events(feed, ["place"]).orderBy("start").collect()
    assert [e["title"] for e in events[:3]] == ["Fajr", "Dhuhr", "Asr"] and events[0]["location"] == "1 Main, Town"
    W.write_ics_feed(feed.select("value"), str(tmp_path / "feed"))
    empty = T.ics_feed(slots, F.lit("2020-01-01 00:00:00").cast("timestamp"), FEED).first()["value"]
    assert "VEVENT" not in empty and empty.endswith("X-PUBLISHED-TTL:PT12H\r\nEND:VCALENDAR\r\n")
