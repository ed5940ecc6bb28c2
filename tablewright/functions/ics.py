"""Calendar (ICS) text functions. ``strict`` is the default dialect, ``lenient`` the older one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import RSVP_PATTERN, ZONE
from .text import BLANK, EOL_CLASS, col, trim_ws
from .times import local_to_utc

_JS = BLANK["js"]
_PY = BLANK["python"]
_BLOCK = r"(?s)BEGIN:VEVENT(.*?)END:VEVENT"
_STAMP = r"^\d{8}(?:T\d{6}Z?)?\z"


def ics_unfold(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"\r?\n[ \t]", "")


def ics_unescape(value: Column | str) -> Column:
    """Decode in the fixed order newline, comma, semicolon, backslash."""
    out = col(value)
    for coded, plain in ((r"\n", "\n"), (r"\N", "\n"), (r"\,", ","), (r"\;", ";"), (r"\\", "\\")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def ics_escape(value: Column | str) -> Column:
    out = col(value)
    for plain, coded in (("\\", r"\\"), (";", r"\;"), (",", r"\,")):
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def ics_blocks(text: Column | str, dialect: str = "strict") -> Column:
    """Array of event blocks. Only the strict dialect joins continuation lines first."""
    if dialect == "strict":
        return F.regexp_extract_all(ics_unfold(text), F.lit(_BLOCK), F.lit(0))
    return F.regexp_extract_all(col(text), F.lit(_BLOCK), F.lit(1))


def ics_field(block: Column | str, name: str, dialect: str = "strict") -> Column:
    """Value of a field. Strict: line-anchored, null when absent. Lenient: anywhere, else ''."""
    if dialect == "strict":
        # The name comes first and its line start is looked back for, so that blocks are
        # searched for a literal.
        pattern = rf"{name}(?<=^{name}|[{EOL_CLASS}]{name})(?:;[^:\r\n]*+)?+:([^{EOL_CLASS}]*)"
        found = F.get(F.regexp_extract_all(col(block), F.lit(pattern), F.lit(1)), 0)
        return trim_ws(found)
    return trim_ws(F.regexp_extract(col(block), rf"{name}(?:;[^:]*+)?+:([^\n]*)", 1), "python")


def _dots(blank: str, count: int, more: str = "") -> str:
    # A run of blanks is entered only at its start, which keeps long blank runs linear.
    lead = rf"(?:(?={blank})(?<!{blank}){blank}++)?"
    return lead + rf"\.{blank}*+" * count + more


def clean_description(raw: Column | str, dialect: str = "strict") -> Column:
    """Cut the footer after ``---``, decode, and turn dotted separators into line breaks."""
    text = F.substring_index(col(raw), "---", 1)
    if dialect == "strict":
        text = ics_unescape(text)
        text = F.regexp_replace(text, _dots(_JS, 2, rf"(?:\.{_JS}*+)?+"), "\n\n")
        text = F.regexp_replace(text, r"\n{3,}", "\n\n")
        return trim_ws(text)
    text = F.replace(text, F.lit(r"\n"), F.lit("\n"))
    text = F.regexp_replace(text, _dots(_PY, 3), "\n\n")
    text = F.regexp_replace(text, _dots(_PY, 2), "\n\n")
    text = F.regexp_replace(text, r"\n+", "\n")
    return trim_ws(text, "python")


def rsvp_url(raw_description: Column | str, url: Column | str, pattern: str = RSVP_PATTERN) -> Column:
    """First matching link in the raw description, else the URL field, else null."""
    linked = F.regexp_extract(col(raw_description), pattern, 0)
    return F.coalesce(F.nullif(linked, F.lit("")), F.nullif(col(url), F.lit("")))


def event_id(uid: Column | str, start_raw: Column | str, summary: Column | str) -> Column:
    return F.coalesce(
        F.nullif(col(uid), F.lit("")),
        F.concat_ws("-", F.coalesce(col(start_raw), F.lit("")), F.coalesce(col(summary), F.lit(""))),
    )


def parse_ics_ts(raw: Column | str, dialect: str = "strict", zone: str = ZONE) -> Column:
    """Instant of a date or date-time.

    Strict: without ``Z`` the value is a wall clock in ``zone``; parts beyond their range roll
    over into the next larger unit. Lenient: only full ``...Z`` values, else null.
    """
    raw = col(raw)
    if dialect == "lenient":
        return F.try_to_timestamp(
            F.regexp_extract(raw, r"^\d{8}T\d{6}Z\z", 0), F.lit("yyyyMMdd'T'HHmmss'Z'")
        )

    return ics_instant(ics_wall(raw), raw, zone)


def ics_instant(wall: Column | str, raw: Column | str, zone: str = ZONE) -> Column:
    """Instant of a clock reading whose text ``raw`` ends in ``Z`` or is local."""
    wall = col(wall)
    return F.when(F.endswith(col(raw), F.lit("Z")), wall).otherwise(local_to_utc(wall, zone))


def ics_wall(raw: Column | str) -> Column:
    """Clock reading of a strict date or date-time, zone mark ignored; null when unreadable."""
    raw = col(raw)

    def part(start: int, length: int) -> Column:
        return F.coalesce(F.substring(raw, start, length).try_cast("int"), F.lit(0))

    # Two-digit years count from 1900.
    year = F.when(part(1, 4) < 100, part(1, 4) + 1900).otherwise(part(1, 4))
    month_start = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), part(5, 2) - 1)
    days = F.unix_date(month_start).cast("long") + part(7, 2) - 1
    seconds = days * 86400 + part(10, 2) * 3600 + part(12, 2) * 60 + part(14, 2)
    return F.when(raw.rlike(_STAMP), F.timestamp_seconds(seconds))


def format_event_ts(raw: Column | str) -> Column:
    """Long label of a ``...Z`` value on the UTC clock; the raw text when unreadable."""
    stamp = parse_ics_ts(raw, "lenient")
    return F.coalesce(F.date_format(stamp, "EEEE, MMMM dd, yyyy hh:mm a"), col(raw))


def ics_utc(instant: Column | str) -> Column:
    return F.date_format(col(instant), "yyyyMMdd'T'HHmmss'Z'")


def slot_uid(slot: Column | str, day_key: Column | str, domain: str) -> Column:
    return F.concat(F.lower(col(slot)), F.lit("-"), col(day_key), F.lit("@" + domain))
