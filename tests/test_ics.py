import datetime as dt

from pyspark.sql import functions as F

from tablewright.functions import ics
from tablewright.operators import calendar as C

CALENDAR = "\r\n".join(
    [
        "BEGIN:VCALENDAR",
        "BEGIN:VEVENT",
        "UID:a-1",
        "SUMMARY;LANGUAGE=en:Tea\\, cake\\; talk",
        "DESCRIPTION:Come by . . . soon..now\\n\\n\\n\\nhttps://groups.example.org/rsvp?id=5\\n---\\nfoot",
        "LOCATION:Room",
        "  12",
        "URL:https://x.example.org",
        "DTSTART:20240722T210500Z",
        "DTEND:20240722T220000Z",
        "END:VEVENT",
        "BEGIN:VEVENT",
        "SUMMARY:Local",
        "DTSTART;TZID=America/New_York:20240722T170500",
        "END:VEVENT",
        "BEGIN:VEVENT",
        "SUMMARY:Day",
        "X-SUMMARY:no",
        "DTSTART;VALUE=DATE:20241103",
        "URL:https://y.example.org",
        "END:VEVENT",
        "BEGIN:VEVENT",
        "UID:bad",
        "SUMMARY:Bad",
        "DTSTART:tomorrow",
        "END:VEVENT",
        "BEGIN:VEVENT",
        "UID:none",
        "DTSTART:20240722T210500Z",
        "END:VEVENT",
        "END:VCALENDAR",
    ]
)


def calendars(spark):
    return spark.createDataFrame([("c", CALENDAR)], "snapshot_id string, value string")


def test_strict_events(spark):
    rows = C.parse_events(calendars(spark), ["snapshot_id"]).orderBy("ord").collect()
    assert [r["ord"] for r in rows] == [0, 1, 2]
    first, local, day = rows
    assert first["id"] == "a-1" and first["title"] == "Tea, cake; talk" and first["location"] == "Room 12"
    assert first["description"] == "Come by\n\nsoon\n\nnow\n\nhttps://groups.example.org/rsvp?id=5"
    assert first["rsvp_url"] == "https://groups.example.org/rsvp?id=5"
    assert local["id"] == "20240722T170500-Local" and local["start"] == first["start"] == local["end"]
    assert local["rsvp_url"] is None and local["description"] == ""
    assert day["start"] == dt.datetime(2024, 11, 3, 4) and day["rsvp_url"] == "https://y.example.org"


def test_lenient_events_keep_everything(spark):
    fields = C.raw_fields(C.event_blocks(calendars(spark), ["snapshot_id"], dialect="lenient"), ["snapshot_id"], "lenient")
    rows = C.event_report_rows(fields).collect()
    assert [r["title"] for r in rows] == ["Tea\\, cake\\; talk", "", "Local", "Day", "Bad"]
    assert rows[0]["where"] == "Room"
    assert rows[0]["when"] == "Monday, July 22, 2024 09:05 PM to Monday, July 22, 2024 10:00 PM"
    assert rows[4]["when"] == "tomorrow to " and rows[4]["rsvp"] is None and rows[4]["description"] is None


def test_timestamps_roll_over(evaluate):
    rows = [("20241301T000000Z",), ("20240230",), ("20240101T250000Z",), ("2024-01-01",), ("20240101T000000z",), ("",)]
    out = evaluate(rows, "v string", lambda d: F.date_format(ics.parse_ics_ts("v"), "yyyy-MM-dd HH:mm"))
    assert out == ["2025-01-01 00:00", "2024-03-01 05:00", "2024-01-02 01:00", None, None, None]


def test_lenient_timestamps(evaluate):
    rows = [("20240722T210500Z",), ("20240722T210500",), ("20241301T000000Z",), ("20240722",)]
    out = evaluate(rows, "v string", lambda d: ics.format_event_ts("v"))
    assert out == ["Monday, July 22, 2024 09:05 PM", "20240722T210500", "20241301T000000Z", "20240722"]


def test_unescape_order_and_escape(evaluate):
    rows = [(r"a\\nb\,c\;d\Ne",)]
    assert evaluate(rows, "v string", lambda d: ics.ics_unescape("v")) == ["a\\\nb,c;d\ne"]
    assert evaluate([("a\\b;c,d\n",)], "v string", lambda d: ics.ics_escape("v")) == ["a\\\\b\\;c\\,d\n"]


def test_field_absent_and_anchored(evaluate):
    rows = [("X-URL:no\nURL;P=1:yes \r\nURL:later",), ("none",), ("URL:",)]
    assert evaluate(rows, "v string", lambda d: ics.ics_field("v", "URL")) == ["yes", None, ""]
    assert evaluate(rows, "v string", lambda d: ics.ics_field("v", "URL", "lenient")) == ["no", "", ""]


def test_field_without_value_separator_is_no_match(evaluate):
    rows = [("URL" + ";" * 5000 + "\nURL;a;b=c:yes",)]
    assert evaluate(rows, "v string", lambda d: ics.ics_field("v", "URL")) == ["yes"]


def test_description_dialects(evaluate):
    rows = [(r"one . . two...three\n\n\nfour\, five .  .  .  . six --- x",), (". . . .",), ("   ",)]
    strict = evaluate(rows, "v string", lambda d: ics.clean_description("v"))
    assert strict == ["one\n\ntwo\n\nthree\n\nfour, five\n\n. six", ".", ""]
    lenient = evaluate(rows, "v string", lambda d: ics.clean_description("v", "lenient"))
    assert lenient == ["one\ntwo\nthree\nfour\\, five\n. six", ".", ""]


def test_calendar_views(spark):
    rows = [(n, f"2024-01-{d:02d} {h:02d}:00:00", f"2024-01-{d:02d} {h + 1:02d}:00:00") for n, (d, h) in enumerate([(20, 3), (10, 12), (20, 14), (20, 14), (20, 15), (20, 16)])]
    events = spark.createDataFrame(rows, "ord int, start string, end string")
    events = events.withColumns({"start": F.col("start").cast("timestamp"), "end": F.col("end").cast("timestamp")})
    as_of = F.lit("2024-01-15 00:00:00").cast("timestamp")
    upcoming, past = C.split_upcoming_past(events, as_of)
    assert [r["ord"] for r in C.next3_events(upcoming).collect()] == [0, 2, 3]
    assert [r["ord"] for r in C.sort_past_desc(past).collect()] == [1]
    placed = {r["ord"]: (r["date_key"], r["day_position"]) for r in C.events_by_day(events).collect()}
    assert placed[0] == ("2024-01-19", 1) and placed[3] == ("2024-01-20", 2) and placed[5] == ("2024-01-20", 4)
    assert {r["ord"] for r in C.first3_per_day(events).collect()} == {0, 1, 2, 3, 4}
    months = spark.sql("SELECT DATE '2024-01-01' AS month")
    cells = {r["date_key"]: r for r in C.calendar_join(C.month_grid(months), events, as_of, "2024-01-20").collect() if r["date_key"]}
    assert len(cells) == 31 and cells["2024-01-20"]["n_events"] == 4 and cells["2024-01-20"]["markers"] == 3
    assert cells["2024-01-20"]["is_selected"] and cells["2024-01-14"]["is_today"] and not cells["2024-01-15"]["is_today"]
    assert C.initial_month(events, as_of).first()["month"] == dt.date(2024, 1, 1)
    late = F.lit("2025-05-01 02:00:00").cast("timestamp")
    assert C.initial_month(events, late).first()["month"] == dt.date(2025, 4, 1)
