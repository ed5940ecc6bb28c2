import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.functions import hours, times

UTC = dt.timezone.utc


@pytest.mark.parametrize(
    "value, ranges",
    [
        ("8 am - 2:30 pm", [(480, 870)]),
        ("10 am - Midnight", [(600, 1440)]),
        ("Midnight - 6 am", [(0, 360)]),
        ("6 am - 7 am, Noon – 1 pm", [(360, 420), (720, 780)]),
        ("12 am - 12 pm", [(0, 720)]),
        ("9 pm - 2 am", [(1260, 120)]),
        ("8 am - 9 am - 10 am", [(480, 540)]),
        ("13 pm - 14:75 PM", [(780, 915)]),
        ("7 am", None),
        ("x - 3 pm", None),
        ("7 am - 8 am, soon", None),
        ("7 am - ", None),
        ("", None),
        ("Hours NOT available", None),
    ],
)
def test_parse_hours(evaluate, value, ranges):
    out = evaluate([(value,)], "v string", lambda d: hours.parse_hours("v"))[0]
    assert (out and [tuple(r) for r in out]) == ranges


def test_fix_separators(evaluate):
    rows = [("7 am - 9 am11 am - 2 pmNoon - 1 pm",), ("8 am - Noon2 pm - 3 pm",)]
    out = evaluate(rows, "v string", lambda d: hours.fix_hours_separators("v"))
    assert out == ["7 am - 9 am, 11 am - 2 pm, Noon - 1 pm", "8 am - Noon2 pm - 3 pm"]


def test_is_open(evaluate):
    rows = [("6 am - 7 am", 360), ("6 am - 7 am", 420), ("9 pm - 2 am", 1300), ("closed", 10)]
    out = evaluate(rows, "v string, m int", lambda d: hours.is_open(hours.parse_hours("v"), "m"))
    assert out == [True, False, False, None]


def two_pass(wall):
    def offset(instant):
        return ZoneInfo("America/New_York").utcoffset(instant.astimezone(ZoneInfo("America/New_York")))

    naive = wall.replace(tzinfo=UTC)
    return naive - offset(naive - offset(naive))


WALLS = st.datetimes(dt.datetime(1990, 1, 1), dt.datetime(2035, 1, 1)).map(lambda d: d.replace(microsecond=0))


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(WALLS, min_size=40, max_size=60))
def test_local_to_utc_agrees_with_two_pass_rule(evaluate, walls):
    walls += [dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 11, 3, 1, 30), dt.datetime(2024, 11, 3, 0, 59)]
    rows = [(int(w.replace(tzinfo=UTC).timestamp()),) for w in walls]
    out = evaluate(rows, "v long", lambda d: F.unix_seconds(times.local_to_utc(F.timestamp_seconds("v"))))
    for wall, seconds in zip(walls, out):
        assert seconds == int(two_pass(wall).timestamp()), wall


def test_spring_gap_rules(evaluate):
    def shown(rule):
        wall = F.lit("2024-03-10 02:30:00").cast("timestamp")
        return evaluate([(1,)], "v int", lambda d: F.date_format(times.local_to_utc(wall, rule=rule), "HH:mm"))

    assert shown("two_pass") == ["06:30"] and shown("native") == ["07:30"]


def test_month_cells(evaluate):
    out = evaluate([("2024-02-11",), ("2015-02-01",)], "v string", lambda d: times.month_cells(F.to_date("v")))
    assert out[0] == [None] * 4 + list(range(1, 30)) + [None] * 2
    assert out[1] == list(range(1, 29))


def test_next_month_wraps(evaluate):
    out = evaluate([("2024-12-31",)], "v string", lambda d: times.next_month(F.to_date("v")).cast("string"))
    assert out == ["2025-01-01"]


def test_to_12h(evaluate):
    rows = [("17:11",), ("00:05",), ("12:00",), ("9:30",), ("late",), ("",), ("10:00\n",)]
    out = evaluate(rows, "v string", lambda d: times.to_12h("v"))
    assert out == ["5:11 PM", "12:05 AM", "12:00 PM", "9:30 AM", None, None, None]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(0, 1e7), min_size=50, max_size=80), st.lists(st.integers(0, 100000), min_size=50, max_size=80))
def test_round1_agrees_with_python(evaluate, values, twentieths):
    values = values + [n / 20 for n in twentieths] + [0.15, 110.25, 0.25, 0.35, 2.675]
    out = evaluate([(v,) for v in values], "v double", lambda d: times.round1("v"))
    assert out == [round(v, 1) for v in values]


def test_labels(evaluate):
    stamp = F.lit("2024-07-22 21:05:00").cast("timestamp")
    out = evaluate(
        [(1,)],
        "v int",
        lambda d: F.array(
            times.local_date_key(stamp), times.local_time_label(stamp), times.day_heading(stamp), times.month_label(stamp)
        ),
    )
    assert out == [["2024-07-22", "5:05 PM", "Monday, July 22", "July 2024"]]
