"""Daily timetables: unpivot, local to UTC, next slot, calendar feed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import SLOT_MINUTES, SLOTS, SUNRISE, ZONE
from ..functions.ics import ics_escape, ics_utc, slot_uid
from ..functions.text import col
from ..functions.times import clean_time, hijri_label, local_date_key, next_month, slot_to_utc, to_12h, valid_hhmm
from .joins import join_lookup
from .ordering import first_after


def timetable_day(days: DataFrame, keep: Sequence[str] = (), slots: Sequence[str] = SLOTS, sunrise: str = SUNRISE) -> DataFrame:
    """One wide row per stored day: date, hijri label, one column per slot, sunrise.

    A missing slot is an empty text, a missing sunrise is null.
    """
    hijri = F.col("date.hijri")
    label = hijri_label(hijri["month"]["en"], hijri["day"], hijri["year"])
    times = [F.coalesce(clean_time(F.col("timings")[slot]), F.lit("")).alias(slot) for slot in slots]
    return days.select(
        *keep,
        F.try_to_date("date.gregorian.date", "dd-MM-yyyy").alias("date"),
        F.when(hijri.isNotNull(), label).alias("hijri"),
        *times,
        F.nullif(clean_time(F.col("timings")[sunrise]), F.lit("")).alias("sunrise"),
    )


def unpivot_slots(
    days: DataFrame, keep: Sequence[str] = ("date", "hijri"), slots: Sequence[str] = SLOTS, zone: str = ZONE, sunrise: bool = False
) -> DataFrame:
    """``keep, slot_ord, slot, kind, local_hhmm, utc_ts`` rows; only readable times have an instant.

    With ``sunrise`` the informational row is second, where the day has one. All slots of a
    day come from one pass over its row.
    """
    entries = [(slot, "prayer", F.col(slot)) for slot in slots]
    if sunrise:
        entries.insert(1, (SUNRISE, "sunrise", F.col("sunrise")))
    listed = F.array(
        *[
            F.struct(
                F.lit(n).alias("slot_ord"), F.lit(slot).alias("slot"), F.lit(kind).alias("kind"), hhmm.alias("local_hhmm")
            )
            for n, (slot, kind, hhmm) in enumerate(entries)
        ]
    )
    rows = days.select(*keep, F.inline(listed)).where("kind = 'prayer' OR local_hhmm IS NOT NULL")
    return rows.withColumns({"display": to_12h("local_hhmm"), "utc_ts": slot_to_utc("date", "local_hhmm", zone)})


def valid_slots(slots: DataFrame) -> DataFrame:
    return slots.where(valid_hhmm("local_hhmm"))


def today_row(days: DataFrame, as_of: Column, zone: str = ZONE) -> DataFrame:
    return days.where(F.col("date") == F.to_date(local_date_key(as_of, zone)))


def union_months(current: DataFrame, following: DataFrame) -> DataFrame:
    return current.unionByName(following)


def feed_months(days: DataFrame, as_of: Column) -> DataFrame:
    """Days of the UTC month of ``as_of`` and of the next one."""
    first = F.trunc(as_of, "MM")
    return days.where((F.col("date") >= first) & (F.col("date") < next_month(first, 2)))


def next_slot(instants: DataFrame, instant: str, slots: DataFrame, zone: str = ZONE, minutes: int = SLOT_MINUTES) -> DataFrame:
    """Add the next slot of the instant's local day: ``next_index`` (-1 if none) and ``next_name``.

    The slots of a day are one small array (one entry per slot name), so this is an equality
    join on the day and a search inside the row.
    """
    one = slots.groupBy("date", "slot", "slot_ord", "kind").agg(F.max("utc_ts").alias("utc_ts"))
    entry = F.struct("slot_ord", "slot", "kind", "utc_ts")
    per_day = one.groupBy("date").agg(F.array_sort(F.collect_list(entry)).alias("_slots"))
    per_day = per_day.select(F.date_format("date", "yyyy-MM-dd").alias("_day"), "_slots")
    joined = join_lookup(instants.withColumn("_day", local_date_key(instant, zone)), per_day, ["_day"])
    wait = F.make_dt_interval(mins=F.lit(minutes))
    later = F.filter("_slots", lambda s: (s["kind"] == "prayer") & (s["utc_ts"] + wait > F.col(instant)))
    found = F.get(later, 0)
    index = F.coalesce(found["slot_ord"], F.lit(-1))
    return joined.withColumns({"next_index": index, "next_name": found["slot"]}).drop("_day", "_slots")


def next_entry(instants: DataFrame, instant: str, entries: DataFrame, keys: Sequence[str], order: Column, zone: str = ZONE, minutes: int = SLOT_MINUTES) -> DataFrame:
    """Add ``next``: the first entry (by ``order``, an orderable struct) of the instant's local day that is not over,
    where a day may have any number of entries.

    ``entries`` have ``utc_ts``; one is over ``minutes`` after its start. ``keys`` are further columns
    that both sides share (a place, a room); null if the day has no such entry.
    """
    over = entries.withColumns({"_over": F.col("utc_ts") + F.make_dt_interval(mins=F.lit(minutes)), "_day": local_date_key("utc_ts", zone)})
    asked = instants.withColumn("_day", local_date_key(instant, zone))
    return first_after(asked, over, [*keys, "_day"], instant, "_over", order, "next").drop("_day")


@dataclass(frozen=True)
class Feed:
    """Texts of a published calendar."""

    domain: str
    product: str
    name: str
    description: str
    location: str
    detail: str
    zone: str = ZONE
    refresh: str = "PT12H"


def ics_event_block(slot: Column | str, day_key: Column | str, start: Column | str, stamp: Column, feed: Feed, minutes: int = SLOT_MINUTES) -> Column:
    """Ten lines of one slot event, joined by CRLF."""
    slot, start = col(slot), col(start)
    lines = [
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), slot_uid(slot, day_key, feed.domain)),
        F.concat(F.lit("DTSTAMP:"), ics_utc(stamp)),
        F.concat(F.lit("DTSTART:"), ics_utc(start)),
        F.concat(F.lit("DTEND:"), ics_utc(start + F.make_dt_interval(mins=F.lit(minutes)))),
        F.concat(F.lit("SUMMARY:"), slot),
        F.concat(F.lit("DESCRIPTION:"), ics_escape(F.concat(slot, F.lit(feed.detail)))),
        F.concat(F.lit("LOCATION:"), ics_escape(F.lit(feed.location))),
        F.lit("TRANSP:TRANSPARENT"),
        F.lit("END:VEVENT"),
    ]
    return F.concat_ws("\r\n", *lines)


def feed_header(feed: Feed) -> str:
    return "\r\n".join(
        [
            "BEGIN:VCALENDAR",
            "VERSION:2.0",
            f"PRODID:{feed.product}",
            "CALSCALE:GREGORIAN",
            "METHOD:PUBLISH",
            f"X-WR-CALNAME:{feed.name}",
            f"X-WR-CALDESC:{feed.description}",
            f"X-WR-TIMEZONE:{feed.zone}",
            f"REFRESH-INTERVAL;VALUE=DURATION:{feed.refresh}",
            f"X-PUBLISHED-TTL:{feed.refresh}",
        ]
    )


def feed_blocks(slots: DataFrame, stamp: Column, feed: Feed, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, date, slot_ord, block``: one event block per readable slot."""
    block = ics_event_block("slot", F.date_format("date", "yyyy-MM-dd"), "utc_ts", stamp, feed)
    prayers = valid_slots(slots).where("kind = 'prayer'")
    return prayers.select(*keys, "date", "slot_ord", block.alias("block"))


def ics_feed(slots: DataFrame, as_of: Column, feed: Feed, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, value``: the whole calendar text of the current and next month.

    Two months and one block per (day, slot) bound the text of a calendar, however many
    snapshots list the same day.
    """
    window = feed_months(slots, as_of)
    blocks = feed_blocks(window, as_of, feed, keys)
    single = blocks.groupBy(*keys, "date", "slot_ord").agg(F.max("block").alias("block"))
    listed = F.array_sort(F.collect_list(F.struct("date", "slot_ord", "block")))
    texts = single.groupBy(*keys).agg(F.transform(listed, lambda b: b["block"]).alias("_blocks"))
    parts = F.concat(F.array(F.lit(feed_header(feed))), "_blocks", F.array(F.lit("END:VCALENDAR")))
    return texts.select(*keys, F.concat(F.array_join(parts, "\r\n"), F.lit("\r\n")).alias("value"))
