"""Zone-aware dates and labels. Wall clocks are timestamps read in a UTC session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import ZONE
from .text import col


def tz_offset(instant: Column | str, zone: str = ZONE) -> Column:
    """Seconds the zone is ahead of UTC at an instant."""
    instant = col(instant)
    return F.unix_seconds(F.from_utc_timestamp(instant, zone)) - F.unix_seconds(instant)


def local_to_utc(wall: Column | str, zone: str = ZONE, rule: str = "two_pass") -> Column:
    """Instant of a wall clock. ``two_pass`` differs from Spark only in the spring gap."""
    wall = col(wall)
    if rule == "native":
        return F.to_utc_timestamp(wall, zone)

    # With w the wall clock read as UTC and f(x) the local clock at x, the first guess is
    # w - (f(w) - w) and the result w minus the offset at that guess.
    micros = F.unix_micros(wall)
    guess = micros * 2 - F.unix_micros(F.from_utc_timestamp(wall, zone))
    there = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(guess), zone))
    return F.timestamp_micros(micros + guess - there)


def local_date_key(instant: Column | str, zone: str = ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(col(instant), zone), "yyyy-MM-dd")


def local_time_label(instant: Column | str, zone: str = ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(col(instant), zone), "h:mm a")


def day_heading(instant: Column | str, zone: str = ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(col(instant), zone), "EEEE, MMMM d")


def date_key_heading(key: Column | str) -> Column:
    return F.date_format(F.to_date(col(key), "yyyy-MM-dd"), "EEEE, MMMM d")


def local_year(instant: Column | str, zone: str = ZONE) -> Column:
    return F.year(F.from_utc_timestamp(col(instant), zone))


def month_label(day: Column | str) -> Column:
    return F.date_format(col(day), "MMMM yyyy")


def date_key_of(year: Column | str, month: Column | str, day: Column | str) -> Column:
    pad = lambda part: F.lpad(col(part).cast("string"), 2, "0")
    return F.concat_ws("-", col(year).cast("string"), pad(month), pad(day))


def next_month(day: Column | str, step: int = 1) -> Column:
    """First day of the month ``step`` months away, across year ends."""
    return F.add_months(F.trunc(col(day), "MM"), step)


def month_cells(day: Column | str) -> Column:
    """Sunday-first day numbers of the month, null-padded at both ends to whole weeks."""
    first = F.trunc(col(day), "MM")
    lead = F.dayofweek(first) - 1
    length = F.dayofmonth(F.last_day(first))
    cells = F.ceil((lead + length) / 7) * 7
    return F.transform(
        F.sequence(F.lit(1), cells.cast("int")),
        lambda cell: F.when(cell.between(lead + 1, lead + length), cell - lead),
    )


def clean_time(raw: Column | str) -> Column:
    return F.substring_index(col(raw), " ", 1)


def valid_hhmm(value: Column | str) -> Column:
    return col(value).rlike(r"^\d{1,2}:\d{2}\z")


def to_12h(hhmm: Column | str) -> Column:
    """``17:11`` as ``5:11 PM``; null when the text is no clock time."""
    hhmm = col(hhmm)
    hour = F.substring_index(hhmm, ":", 1).try_cast("int")
    shown = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    half = F.when(hour >= 12, "PM").otherwise("AM")
    text = F.concat(shown.cast("string"), F.lit(":"), F.substring_index(hhmm, ":", -1), F.lit(" "), half)
    return F.when(valid_hhmm(hhmm), text)


def wall_clock(day: Column | str, hhmm: Column | str) -> Column:
    """Wall-clock timestamp of a date (or ``yyyy-MM-dd`` key) and an ``HH:MM`` text."""
    hhmm = col(hhmm)
    seconds = (
        F.unix_date(col(day).cast("date")).cast("long") * 86400
        + F.substring_index(hhmm, ":", 1).try_cast("long") * 3600
        + F.substring_index(hhmm, ":", -1).try_cast("long") * 60
    )
    return F.when(valid_hhmm(hhmm), F.timestamp_seconds(seconds))


def slot_to_utc(day: Column | str, hhmm: Column | str, zone: str = ZONE) -> Column:
    return local_to_utc(wall_clock(day, hhmm), zone)


def hijri_label(month: Column | str, day: Column | str, year: Column | str) -> Column:
    return F.concat(col(month), F.lit(" "), col(day), F.lit(", "), col(year), F.lit(" AH"))


def round1(value: Column | str) -> Column:
    """One decimal, rounding the exact binary value half to even.

    Ten times the value is kept as a rounded sum plus its error term (8x and 2x are exact), so
    a decimal tie that is no tie in binary rounds to the side it is really on.
    """
    value = col(value).cast("double")
    eight, two = value * 8, value * 2
    total = eight + two
    back = total - eight
    error = (eight - (total - back)) + (two - back)
    low = F.floor(total)
    part = total - low
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (low % 2 != 0))))
    return F.when(up, low + 1).otherwise(low) / F.lit(10.0)
