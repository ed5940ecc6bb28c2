"""Opening hours: text to minute ranges, and open-at tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import ZONE
from .text import BLANK, col, trim_ws

_JS = BLANK["js"]
_CLOCK = rf"^(\d{{1,2}})(?::(\d{{2}}))?{_JS}*(am|pm)\z"


def fix_hours_separators(raw: Column | str) -> Column:
    """Insert ``, `` where a range ending in am/pm is glued to the next one."""
    return F.regexp_replace(col(raw), r"(?<=[ap]m)(?=\p{Nd}|Noon|Midnight)", ", ")


def parse_time_minutes(token: Column | str, is_end: bool = False) -> Column:
    """Minutes from midnight of ``noon``, ``midnight`` or ``h[:mm] am/pm``; else null."""
    text = F.lower(trim_ws(token))
    hour = F.try_element_at(F.regexp_extract_all(text, F.lit(_CLOCK), F.lit(1)), F.lit(1))
    minute = F.regexp_extract(text, _CLOCK, 2)
    half = F.when(F.endswith(text, F.lit("pm")), 720).otherwise(0)
    return (
        F.when(text == "noon", 720)
        .when(text == "midnight", 1440 if is_end else 0)
        .when(
            hour.isNotNull(),
            (hour.cast("int") % 12) * 60
            + half
            + F.when(minute == "", 0).otherwise(minute.try_cast("int")),
        )
        .cast("int")
    )


def parse_hours(hours: Column | str) -> Column:
    """``array<struct<start_min,end_min>>``; null when any part cannot be read."""
    hours = col(hours)

    def one(part: Column) -> Column:
        ends = F.split(part, rf"{_JS}*[-–]{_JS}*")
        return F.struct(
            parse_time_minutes(F.get(ends, 0)).alias("start_min"),
            parse_time_minutes(F.get(ends, 1), is_end=True).alias("end_min"),
        )

    ranges = F.transform(F.split(hours, ","), one)
    broken = F.exists(ranges, lambda r: r["start_min"].isNull() | r["end_min"].isNull())
    readable = (hours != "") & ~F.contains(F.lower(hours), F.lit("not available"))
    return F.when(readable & ~broken, ranges)


def now_minutes_local(instant: Column | str, zone: str = ZONE) -> Column:
    local = F.from_utc_timestamp(col(instant), zone)
    return F.hour(local) * 60 + F.minute(local)


def is_open(ranges: Column | str, minute: Column | str) -> Column:
    """Null for null ranges; a range that ends before it starts is never open."""
    minute = col(minute)
    return F.exists(
        col(ranges), lambda r: (minute >= r["start_min"]) & (minute < r["end_min"])
    )


# --- minutes of the day as bits -------------------------------------------------------------

WORDS = 23  # of 64 minutes each, for 1440 minutes


def _mask(word: Column, start: Column, end: Column) -> Column:
    """Bits of the minutes from ``start`` up to ``end`` that lie in a word."""
    edge = lambda minute: F.greatest(F.lit(0), F.least(F.lit(64), minute - word * 64))
    # Ones below a bit; a shift by 64 would be a shift by 0.
    ones = F.lit(-1).cast("long")
    below = lambda n: F.when(n >= 64, ones).otherwise(F.bitwise_not(F.call_function("shiftleft", ones, n.cast("int"))))
    return below(edge(end)).bitwiseAND(F.bitwise_not(below(edge(start))))


def _words() -> Column:
    return F.sequence(F.lit(0), F.lit(WORDS - 1))


def minute_bits(ranges: Column | str) -> Column:
    """The minutes of the day inside any of the ranges, as an array of longs; null for null ranges."""
    zero = F.lit(0).cast("long")
    word = lambda w: F.aggregate(col(ranges), zero, lambda bits, r: bits.bitwiseOR(_mask(w, r["start_min"], r["end_min"])))
    return F.when(col(ranges).isNotNull(), F.transform(_words(), word))


def is_open_bits(bits: Column | str, minute: Column | str) -> Column:
    """As ``is_open``, by shift and mask."""
    minute = col(minute)
    word = F.get(col(bits), F.floor(minute / 64).cast("int"))
    return F.call_function("shiftright", word, (minute % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def is_open_for(bits: Column | str, minute: Column | str, n: Column | int) -> Column:
    """Whether all of the next ``n`` minutes are open. Nothing is open beyond the end of the day."""
    start = col(minute)
    end = start + (F.lit(n) if isinstance(n, int) else n)
    wanted = F.forall(F.transform(_words(), lambda w: F.struct(_mask(w, start, end).alias("m"), F.get(col(bits), w).alias("b"))), lambda x: x["m"].bitwiseAND(x["b"]) == x["m"])
    return F.when(col(bits).isNotNull() & start.isNotNull(), wanted & (end <= 1440))


def open_minutes(bits: Column | str) -> Column:
    """Open minutes of the day; ranges that overlap count once."""
    return F.aggregate(col(bits), F.lit(0), lambda n, b: n + F.bit_count(b))
