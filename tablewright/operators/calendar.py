"""Calendar events: parse, clean, split, sort and bucket by local day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import RSVP_PATTERN, ZONE
from ..functions.ics import (
    clean_description,
    event_id,
    format_event_ts,
    ics_blocks,
    ics_field,
    ics_instant,
    ics_unescape,
    ics_wall,
    parse_ics_ts,
    rsvp_url,
)
from ..functions.text import col
from ..functions.times import date_key_of, local_date_key, month_cells
from .ordering import first_k_per_key, range_positions


def event_blocks(calendars: DataFrame, keep: Sequence[str], text: str = "value", dialect: str = "strict") -> DataFrame:
    """``keep, ord, block`` rows of calendar texts, cut inside each text's own row."""
    return calendars.select(*keep, F.posexplode(ics_blocks(text, dialect)).alias("ord", "block"))


def raw_fields(blocks: DataFrame, keep: Sequence[str], dialect: str = "strict") -> DataFrame:
    """The text fields of each block; absent ones are empty."""

    def field(name: str) -> Column:
        return F.coalesce(ics_field("block", name, dialect), F.lit(""))

    names = {
        "uid": "UID",
        "summary": "SUMMARY",
        "raw_description": "DESCRIPTION",
        "raw_location": "LOCATION",
        "url": "URL",
        "start_raw": "DTSTART",
        "end_raw": "DTEND",
    }
    return blocks.select(*keep, "ord", _once(**{out: field(name) for out, name in names.items()}))


def _once(**columns: Column) -> Column:
    """Columns of a one-row generator: later filters on them are not pushed into the patterns
    behind them, which would match every pattern once more per use."""
    return F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()])))


def event_projection(
    fields: DataFrame,
    keep: Sequence[str],
    dialect: str = "strict",
    zone: str = ZONE,
    rsvp_pattern: str = RSVP_PATTERN,
) -> DataFrame:
    """Typed events; the end defaults to the start. Nothing is dropped here."""
    plain = ics_unescape if dialect == "strict" else col
    projected = fields.select(
        *keep,
        "ord",
        event_id("uid", "start_raw", "summary").alias("id"),
        plain("summary").alias("title"),
        clean_description("raw_description", dialect).alias("description"),
        plain("raw_location").alias("location"),
        rsvp_url("raw_description", "url", rsvp_pattern).alias("rsvp_url"),
        "summary",
        "start_raw",
        "end_raw",
    )
    if dialect == "strict":
        walls = projected.select("*", _once(_start=ics_wall("start_raw"), _end=ics_wall("end_raw")))
        start, end = ics_instant("_start", "start_raw", zone), ics_instant("_end", "end_raw", zone)
    else:
        walls = projected
        start, end = parse_ics_ts("start_raw", dialect), parse_ics_ts("end_raw", dialect)
    typed = walls.select(*projected.columns, _once(start=start, end=end))
    return typed.withColumn("end", F.coalesce("end", "start"))


def is_valid_event() -> Column:
    return F.col("start").isNotNull() & (F.col("summary") != "")


def valid_events(events: DataFrame) -> DataFrame:
    return events.where(is_valid_event())


def parse_events(
    calendars: DataFrame,
    keep: Sequence[str],
    text: str = "value",
    dialect: str = "strict",
    zone: str = ZONE,
    rsvp_pattern: str = RSVP_PATTERN,
) -> DataFrame:
    """Events of calendar texts. The lenient dialect keeps events without a readable start."""
    fields = raw_fields(event_blocks(calendars, keep, text, dialect), keep, dialect)
    events = event_projection(fields, keep, dialect, zone, rsvp_pattern)
    return valid_events(events) if dialect == "strict" else events


def sort_events(events: DataFrame) -> DataFrame:
    return events.orderBy("start", "ord")


def event_positions(events: DataFrame) -> DataFrame:
    """Events with their 1-based ``position`` in the order of ``sort_events``."""
    return range_positions(events, [], ["start", "ord"], "position")


def sort_events_unparseable_last(events: DataFrame) -> DataFrame:
    return events.orderBy(F.asc_nulls_last("start"), "ord")


def event_positions_unparseable_last(events: DataFrame) -> DataFrame:
    return range_positions(events, [], [F.asc_nulls_last("start"), "ord"], "position")


def split_upcoming_past(events: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(not yet ended at ``as_of``, ended before it)."""
    return events.where(F.col("end") >= as_of), events.where(F.col("end") < as_of)


def sort_past_desc(past: DataFrame) -> DataFrame:
    return past.orderBy(F.desc("start"), "ord")


def past_positions(past: DataFrame) -> DataFrame:
    """Past events with their ``position`` in the order of ``sort_past_desc``."""
    return range_positions(past, [], [F.desc("start"), "ord"], "position")


def next3_events(upcoming: DataFrame, k: int = 3) -> DataFrame:
    return upcoming.orderBy("start", "ord").limit(k)


def with_day(events: DataFrame, zone: str = ZONE) -> DataFrame:
    return events.withColumn("date_key", local_date_key("start", zone))


def events_by_day(events: DataFrame, zone: str = ZONE) -> DataFrame:
    """Events with their local day and exact place in it; a day is never gathered into a list or one task."""
    return range_positions(with_day(events, zone), ["date_key"], ["start", "ord"], "day_position")


def day_counts(events: DataFrame, zone: str = ZONE) -> DataFrame:
    """Events per local day with the first start."""
    days = with_day(events, zone).groupBy("date_key")
    return days.agg(F.count("*").alias("n_events"), F.min("start").alias("first_start"))


def first3_per_day(events: DataFrame, zone: str = ZONE, k: int = 3) -> DataFrame:
    return first_k_per_key(with_day(events, zone), ["date_key"], ["start", "ord"], k, "day_position")


def month_grid(months: DataFrame, month: str = "month", keep: Sequence[str] = ()) -> DataFrame:
    """Cells of each month: ``cell`` from 0, ``week``, ``weekday`` (Sunday 0), ``day`` or null."""
    named = months.withColumnRenamed(month, "month")
    cells = named.select(*keep, "month", F.posexplode(month_cells("month")).alias("cell", "day"))
    week, weekday = F.floor(F.col("cell") / 7).cast("int"), F.col("cell") % 7
    key = date_key_of(F.year("month"), F.month("month"), "day")
    return cells.select(
        *keep,
        "month",
        "cell",
        week.alias("week"),
        weekday.alias("weekday"),
        "day",
        F.when(F.col("day").isNotNull(), key).alias("date_key"),
    )


def calendar_join(grid: DataFrame, events: DataFrame, as_of: Column, selected: str | None = None, zone: str = ZONE) -> DataFrame:
    """Grid cells with event counts, marker counts and today/selected flags.

    Events are counted per day before the join, so it moves one row per day.
    """
    joined = grid.join(day_counts(events, zone), ["date_key"], "left")
    n = F.coalesce("n_events", F.lit(0))
    chosen = F.lit(False) if selected is None else F.coalesce(F.col("date_key") == selected, F.lit(False))
    return joined.withColumns(
        {
            "n_events": n,
            "markers": F.least(n, F.lit(3)),
            "is_today": F.coalesce(F.col("date_key") == local_date_key(as_of, zone), F.lit(False)),
            "is_selected": chosen,
        }
    )


def initial_month(events: DataFrame, as_of: Column, zone: str = ZONE) -> DataFrame:
    """First day of the local month of the first event not ended, else of ``as_of``."""
    first = events.agg(F.min(F.when(F.col("end") >= as_of, F.col("start"))).alias("_s"))
    shown = F.coalesce("_s", as_of)
    return first.select(F.trunc(F.from_utc_timestamp(shown, zone), "MM").alias("month"))


def event_report_rows(fields: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Row set of the printed calendar, from lenient raw fields, in start order.

    An empty link or description is null: those rows are not printed. ``start_raw`` is the start
    as the calendar has it.
    """
    rows = fields.select(
        *keep,
        "ord",
        "start_raw",
        parse_ics_ts("start_raw", "lenient").alias("start"),
        F.col("summary").alias("title"),
        F.concat(format_event_ts("start_raw"), F.lit(" to "), format_event_ts("end_raw")).alias("when"),
        F.col("raw_location").alias("where"),
        rsvp_url("raw_description", "url").alias("rsvp"),
        F.nullif(clean_description("raw_description", "lenient"), F.lit("")).alias("description"),
    )
    return sort_events_unparseable_last(rows)
