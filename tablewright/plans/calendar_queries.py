"""Calendar, timetable and date queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import SLOTS, ZONE
from ..functions import ics, times
from ..operators import calendar as C
from ..operators import timetable as T
from .inputs import AS_OF, CALENDAR, TIMETABLE, as_of, calendar, iso, sql_iso, sql_local, sql_utc, timetable
from .registry import Tables, query

NOW = f"TIMESTAMP '{AS_OF}'"

# --- events ---------------------------------------------------------------------------------


def _shown(events, *more):
    return events.select("ord", "title", iso("start").alias("start"), iso("end").alias("end"), *more)


EVENT_SQL = f"""ord, title, {sql_iso('start')} AS start, {sql_iso('"end"')} AS "end" """


def _placed(order: str) -> str:
    return f"CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS position"


@query(f"WITH {CALENDAR} SELECT {EVENT_SQL}, {_placed('calendar.start, ord')} FROM calendar")
def sort_events(t: Tables):
    return _shown(C.sort_events(C.event_positions(calendar(t))), "position")


@query(f"""WITH {CALENDAR} SELECT ord, title, CASE WHEN ord % 10 <> 0 THEN {sql_iso('start')} END AS start,
       {_placed('CASE WHEN ord % 10 <> 0 THEN calendar.start END NULLS LAST, ord')} FROM calendar""")
def sort_events_unparseable_last(t: Tables):
    raw = F.when(F.col("ord") % 10 != 0, ics.ics_utc("start")).otherwise("soon")
    events = calendar(t).select("ord", "title", ics.parse_ics_ts(raw, "lenient").alias("start"))
    ordered = C.sort_events_unparseable_last(C.event_positions_unparseable_last(events))
    return ordered.select("ord", "title", iso("start").alias("start"), "position")


@query(f'WITH {CALENDAR} SELECT {EVENT_SQL}, "end" >= {NOW} AS is_upcoming FROM calendar')
def split_upcoming_past(t: Tables):
    upcoming, past = C.split_upcoming_past(calendar(t), as_of())
    upcoming = upcoming.withColumn("is_upcoming", F.lit(True))
    both = upcoming.unionByName(past.withColumn("is_upcoming", F.lit(False)))
    return both.select("ord", "title", iso("start").alias("start"), iso("end").alias("end"), "is_upcoming")


@query(f"""WITH {CALENDAR} SELECT count(*) FILTER (WHERE "end" >= {NOW}) AS upcoming, count(*) FILTER (WHERE "end" < {NOW}) AS past FROM calendar""")
def event_counts(t: Tables):
    end = F.col("end")
    return calendar(t).agg(F.count_if(end >= as_of()).alias("upcoming"), F.count_if(end < as_of()).alias("past"))


@query(f"""WITH {CALENDAR} SELECT {EVENT_SQL}, {_placed('calendar.start DESC, ord')} FROM calendar WHERE "end" < {NOW}""")
def sort_past_desc(t: Tables):
    past = C.split_upcoming_past(calendar(t), as_of())[1]
    return _shown(C.sort_past_desc(C.past_positions(past)), "position")


@query(f'WITH {CALENDAR} SELECT {EVENT_SQL} FROM calendar WHERE "end" >= {NOW} ORDER BY calendar.start, ord LIMIT 3')
def next3_events(t: Tables):
    return _shown(C.next3_events(C.split_upcoming_past(calendar(t), as_of())[0]))


@query(f"""WITH {CALENDAR} SELECT ord, strftime({sql_local('start')}, '%Y-%m-%d') AS date_key,
  row_number() OVER (PARTITION BY CAST({sql_local('start')} AS DATE) ORDER BY start, ord) AS day_position FROM calendar""")
def events_by_day(t: Tables):
    return C.events_by_day(calendar(t)).select("ord", "date_key", "day_position")


@query(f"""WITH {CALENDAR} SELECT strftime({sql_local('start')}, '%Y-%m-%d') AS date_key, count(*) AS n_events,
  {sql_iso('min(start)')} AS first_start FROM calendar GROUP BY 1""")
def local_day_counts(t: Tables):
    return C.day_counts(calendar(t)).withColumn("first_start", iso("first_start"))


@query(f"""WITH {CALENDAR} SELECT * FROM (SELECT ord, strftime({sql_local('start')}, '%Y-%m-%d') AS date_key,
  CAST(row_number() OVER (PARTITION BY CAST({sql_local('start')} AS DATE) ORDER BY start, ord) AS INTEGER) AS day_position FROM calendar)
WHERE day_position <= 3""")
def first3_per_day(t: Tables):
    return C.first3_per_day(calendar(t)).select("ord", "date_key", "day_position")


MONTHS = """months AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders),
cells AS (
  SELECT month, cell, cell - dayofweek(month) + 1 AS n, dayofmonth(last_day(month)) AS size FROM months,
         LATERAL (SELECT unnest(generate_series(0, CAST(ceil((dayofweek(month) + dayofmonth(last_day(month))) / 7.0) * 7 AS INTEGER) - 1)) AS cell)),
grid AS (
  SELECT month, CAST(cell AS INTEGER) AS cell, CAST(cell // 7 AS INTEGER) AS week, CAST(cell % 7 AS INTEGER) AS weekday,
         CASE WHEN n BETWEEN 1 AND size THEN CAST(n AS INTEGER) END AS day,
         CASE WHEN n BETWEEN 1 AND size THEN strftime(month + CAST(n - 1 AS INTEGER), '%Y-%m-%d') END AS date_key FROM cells)"""


@query(f"WITH {MONTHS} SELECT strftime(month, '%Y-%m-%d') AS month, cell, week, weekday, day, date_key FROM grid")
def month_grid(t: Tables):
    months = t.orders.select(F.trunc("o_orderdate", "MM").alias("month")).distinct()
    return C.month_grid(months).withColumn("month", F.date_format("month", "yyyy-MM-dd"))


@query(f"""WITH {CALENDAR}, {MONTHS.replace('o_orderdate', 'ts').replace('FROM orders', 'FROM events')},
per_day AS (SELECT strftime({sql_local('start')}, '%Y-%m-%d') AS date_key, count(*) AS n FROM calendar GROUP BY 1)
SELECT cell, week, weekday, day, grid.date_key, coalesce(n, 0) AS n_events, least(coalesce(n, 0), 3) AS markers,
       coalesce(grid.date_key = '2024-01-15', false) AS is_today, coalesce(grid.date_key = '2024-01-20', false) AS is_selected
FROM grid LEFT JOIN per_day USING (date_key)""")
def calendar_join(t: Tables):
    months = t.events.select(F.trunc("ts", "MM").alias("month")).distinct()
    joined = C.calendar_join(C.month_grid(months), calendar(t), as_of(), "2024-01-20")
    columns = ["cell", "week", "weekday", "day", "date_key", "n_events", "markers", "is_today", "is_selected"]
    return joined.select(*columns)


@query(f"""WITH {CALENDAR}
SELECT strftime(date_trunc('month', {sql_local(f"coalesce((SELECT min(start) FROM calendar WHERE " + chr(34) + "end" + chr(34) + f" >= {NOW}), {NOW})")}), '%Y-%m-%d') AS month""")
def initial_month(t: Tables):
    return C.initial_month(calendar(t), as_of()).select(F.date_format("month", "yyyy-MM-dd").alias("month"))


# --- dates and zones ------------------------------------------------------------------------


def _offset(instant: str) -> str:
    return f"(epoch({sql_local(instant)}) - epoch({instant}))"


@query(f"""SELECT o_orderkey, {sql_iso('wall - to_seconds(CAST(second AS BIGINT))')} AS utc FROM (
  SELECT *, {_offset('wall - to_seconds(CAST(first AS BIGINT))')} AS second FROM (
    SELECT *, {_offset('wall')} AS first FROM (
      SELECT o_orderkey, o_orderdate + to_seconds(CAST(o_orderkey * 613 % 86400 AS BIGINT)) AS wall FROM orders)))""")
def local_to_utc(t: Tables):
    seconds = F.col("o_orderkey") * 613 % 86400
    wall = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + seconds)
    return t.orders.select("o_orderkey", iso(times.local_to_utc(wall)).alias("utc"))


# Of the two instants an autumn wall clock can mean, Spark takes the earlier one.
@query(f"""SELECT o_orderkey, CASE WHEN {sql_local('utc - INTERVAL 1 HOUR')} = wall THEN {sql_iso('utc - INTERVAL 1 HOUR')} ELSE {sql_iso('utc')} END AS utc
FROM (SELECT o_orderkey, wall, {sql_utc('wall')} AS utc FROM (
  SELECT o_orderkey, o_orderdate + to_seconds(CAST(o_orderkey * 613 % 86400 AS BIGINT)) AS wall FROM orders))""")
def local_to_utc_native(t: Tables):
    seconds = F.col("o_orderkey") * 613 % 86400
    wall = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + seconds)
    return t.orders.select("o_orderkey", iso(times.local_to_utc(wall, rule="native")).alias("utc"))


@query(f"""SELECT event_id, CAST({_offset('ts')} AS BIGINT) AS tz_offset, strftime({sql_local('ts')}, '%-I:%M %p') AS time_label,
  strftime({sql_local('ts')}, '%A, %B %-d') AS day_heading, CAST(year({sql_local('ts')}) AS INTEGER) AS local_year,
  strftime({sql_local('ts')}, '%B %Y') AS month_label,
  CAST(hour({sql_local('ts')}) * 60 + minute({sql_local('ts')}) AS INTEGER) AS local_minutes,
  strftime(ts, '%Y%m%dT%H%M%SZ') AS ics_utc
FROM events""")
def event_date_labels(t: Tables):
    from ..functions.hours import now_minutes_local

    ts = F.col("ts").cast("timestamp")
    return t.events.select(
        "event_id",
        times.tz_offset(ts).alias("tz_offset"),
        times.local_time_label(ts).alias("time_label"),
        times.day_heading(ts).alias("day_heading"),
        times.local_year(ts).alias("local_year"),
        times.month_label(F.from_utc_timestamp(ts, ZONE)).alias("month_label"),
        now_minutes_local(ts).alias("local_minutes"),
        ics.ics_utc(ts).alias("ics_utc"),
    )


@query("""SELECT o_orderkey, year(o_orderdate) || '-' || lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '-' || lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0') AS date_key,
  strftime(o_orderdate, '%A, %B %-d') AS heading,
  strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month,
  strftime(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH, '%Y-%m-%d') AS previous_month
FROM orders""")
def date_keys(t: Tables):
    day = F.col("o_orderdate").cast("date")
    key = times.date_key_of(F.year(day), F.month(day), F.dayofmonth(day))
    return t.orders.select(
        "o_orderkey",
        key.alias("date_key"),
        times.date_key_heading(key).alias("heading"),
        F.date_format(times.next_month(day), "yyyy-MM-dd").alias("next_month"),
        F.date_format(times.next_month(day, -1), "yyyy-MM-dd").alias("previous_month"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE strftime(ts, '%-I:%M %p') END AS shown, event_id % 9 <> 0 AS valid FROM events""")
def to_12h(t: Tables):
    hhmm = F.when(F.col("event_id") % 9 == 0, "now").otherwise(F.date_format("ts", "HH:mm"))
    return t.events.select("event_id", times.to_12h(hhmm).alias("shown"), times.valid_hhmm(hhmm).alias("valid"))


# --- ICS round trips ------------------------------------------------------------------------

# Calendars are runs of consecutive event ids, so a calendar text has a fixed largest size.
CALENDAR_EVENTS = 500


def _ics_texts(t: Tables):
    """Calendar texts with folded lines, local and all-day starts, and fields left out."""
    key, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    local = F.date_format(F.from_utc_timestamp(ts, ZONE), "yyyyMMdd'T'HHmmss")
    stamp = ics.ics_utc(ts)
    start = (
        F.when(key % 13 == 0, F.lit("DTSTART:soon"))
        .when(key % 7 == 0, F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(ts, "yyyyMMdd")))
        .when(key % 3 == 1, F.concat(F.lit(f"DTSTART;TZID={ZONE}:"), local))
        .otherwise(F.concat(F.lit("DTSTART:"), stamp))
    )
    end = F.concat(F.lit("DTEND:"), ics.ics_utc(F.timestamp_micros(F.unix_micros(ts) + 3_600_000_000)))
    name = F.concat("event_type", F.lit(", no; "), key.cast("string"))
    about = F.concat(
        F.lit(r"Bring "), ics.ics_escape("props"), F.lit(r"\nDoors . . . open .. late"),
        F.when(key % 6 == 0, F.lit("\r\n  at https://groups.example.org/rsvp?id=77")).otherwise(""), F.lit(r"\n---\nfooter"),
    )
    lines = F.array(
        F.lit("BEGIN:VEVENT"),
        F.when(key % 4 != 0, F.concat(F.lit("UID:u-"), key.cast("string"))),
        F.when(key % 11 != 0, F.concat(F.lit("SUMMARY:"), ics.ics_escape(name))),
        F.concat(F.lit("DESCRIPTION:"), about),
        F.lit("LOCATION:Hall\\, room\r\n  4"),
        F.when(key % 5 == 0, F.concat(F.lit("URL:https://x.example.org/"), key.cast("string"))),
        start,
        F.when(key % 5 != 0, end),
        F.lit("END:VEVENT"),
    )
    block = F.array_join(F.array_compact(lines), "\r\n")
    blocks = t.events.select(F.floor(key / CALENDAR_EVENTS).alias("calendar_id"), key.alias("k"), block.alias("block"))
    listed = F.array_sort(F.collect_list(F.struct("k", "block")))
    texts = blocks.groupBy("calendar_id").agg(F.transform(listed, lambda b: b["block"]).alias("_b"))
    whole = F.concat(F.lit("BEGIN:VCALENDAR\r\n"), F.array_join("_b", "\r\n"), F.lit("\r\nEND:VCALENDAR\r\n"))
    return texts.select("calendar_id", whole.alias("value"))


ICS = f"""source AS (
  SELECT event_id AS k, event_id // {CALENDAR_EVENTS} AS calendar_id, event_id % {CALENDAR_EVENTS} AS ord, ts,
         event_type || ', no; ' || event_id AS name,
         CASE WHEN event_id % 6 = 0 THEN 'https://groups.example.org/rsvp?id=77'
              WHEN event_id % 5 = 0 THEN 'https://x.example.org/' || event_id END AS rsvp_url,
         CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 7 = 0 THEN {sql_utc("date_trunc('day', ts)")}
              ELSE date_trunc('second', ts) END AS start,
         CASE WHEN event_id % 5 <> 0 THEN date_trunc('second', ts + INTERVAL 1 HOUR) END AS stop,
         CASE WHEN event_id % 13 = 0 THEN 'soon' WHEN event_id % 7 = 0 THEN strftime(ts, '%Y%m%d')
              WHEN event_id % 3 = 1 THEN strftime({sql_local('ts')}, '%Y%m%dT%H%M%S') ELSE strftime(ts, '%Y%m%dT%H%M%SZ') END AS start_raw,
         CASE WHEN event_id % 6 = 0 THEN ' at https://groups.example.org/rsvp?id=77' ELSE '' END AS link, props
  FROM events)"""

_ESCAPED = r"replace(replace(name, ';', '\;'), ',', '\,')"


ICS_EVENTS = rf"""WITH {ICS}
SELECT calendar_id, CAST(ord AS INTEGER) AS ord, CASE WHEN k % 4 <> 0 THEN 'u-' || k ELSE start_raw || '-' || {_ESCAPED} END AS id, name AS title,
  'Bring ' || props || chr(10) || 'Doors' || chr(10) || chr(10) || 'open' || chr(10) || chr(10) || 'late' || link AS description,
  'Hall, room 4' AS location, rsvp_url, {sql_iso('start')} AS start, {sql_iso('coalesce(stop, start)')} AS "end"
FROM source WHERE k % 11 <> 0 AND start IS NOT NULL"""


@query(ICS_EVENTS)
def ics_roundtrip(t: Tables):
    events = C.parse_events(_ics_texts(t), ["calendar_id"])
    columns = ["calendar_id", "ord", "id", "title", "description", "location", "rsvp_url"]
    return events.select(*columns, iso("start").alias("start"), iso("end").alias("end"))


@query(rf"""WITH {ICS}
SELECT calendar_id, CAST(ord AS INTEGER) AS ord, CASE WHEN k % 11 <> 0 THEN {_ESCAPED} ELSE '' END AS title, start_raw AS start_text,
  'Hall\, room' AS location, CASE WHEN start_raw LIKE '%Z' THEN strftime(ts, '%A, %B %d, %Y %I:%M %p') ELSE start_raw END
    || ' to ' || CASE WHEN stop IS NULL THEN '' ELSE strftime(stop, '%A, %B %d, %Y %I:%M %p') END AS "when",
  CASE WHEN k % 5 = 0 THEN 'https://x.example.org/' || k END AS rsvp,
  'Bring ' || replace(replace(props, ';', '\;'), ',', '\,') || chr(10) || 'Doors' || chr(10) || 'open' || chr(10) || 'late' AS description
FROM source""")
def event_report_rows(t: Tables):
    fields = C.raw_fields(C.event_blocks(_ics_texts(t), ["calendar_id"], dialect="lenient"), ["calendar_id"], "lenient")
    rows = C.event_report_rows(fields, ["calendar_id"])
    return rows.select(
        "calendar_id", "ord", "title", F.col("start_raw").alias("start_text"), F.col("where").alias("location"), "when", "rsvp", "description"
    )


@query("SELECT event_id // 500 AS calendar_id, count(*) AS n_blocks, count(*) FILTER (WHERE event_id % 11 <> 0 AND event_id % 13 <> 0) AS n_valid FROM events GROUP BY 1")
def ics_block_counts(t: Tables):
    fields = C.raw_fields(C.event_blocks(_ics_texts(t), ["calendar_id"]), ["calendar_id"])
    events = C.event_projection(fields, ["calendar_id"])
    return events.groupBy("calendar_id").agg(
        F.count("*").alias("n_blocks"), F.count_if(C.is_valid_event()).alias("n_valid")
    )


# --- timetable ------------------------------------------------------------------------------


def _days(t: Tables):
    return T.timetable_day(timetable(t))


@query(f"WITH {TIMETABLE} SELECT strftime(date, '%Y-%m-%d') AS date, hijri, {', '.join(SLOTS)}, sunrise FROM days")
def timetable_day(t: Tables):
    return _days(t).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


SLOT_SQL = f"strftime(date, '%Y-%m-%d') AS date, CAST(slot_ord AS INTEGER) AS slot_ord, slot, kind, local_hhmm, {sql_iso('utc_ts')} AS utc"


def _slot_rows(slots):
    key = F.date_format("date", "yyyy-MM-dd").alias("date")
    return slots.select(key, "slot_ord", "slot", "kind", "local_hhmm", iso("utc_ts").alias("utc"))


@query(f"WITH {TIMETABLE} SELECT {SLOT_SQL} FROM slots")
def unpivot_slots(t: Tables):
    return _slot_rows(T.unpivot_slots(_days(t)))


@query(f"WITH {TIMETABLE} SELECT {SLOT_SQL} FROM slots WHERE utc_ts IS NOT NULL")
def valid_slots(t: Tables):
    return _slot_rows(T.valid_slots(T.unpivot_slots(_days(t))))


@query(f"""WITH {TIMETABLE}, shown AS (
  SELECT date, CASE WHEN slot_ord = 0 THEN 0 ELSE slot_ord + 1 END AS slot_ord, slot, kind, local_hhmm, utc_ts FROM slots
  UNION ALL SELECT date, 1, 'Sunrise', 'sunrise', sunrise,
    {sql_utc("date + to_seconds(60 * (60 * CAST(split_part(sunrise, ':', 1) AS INTEGER) + CAST(split_part(sunrise, ':', 2) AS INTEGER)))")} FROM days WHERE sunrise IS NOT NULL)
SELECT {SLOT_SQL} FROM shown""")
def insert_sunrise(t: Tables):
    return _slot_rows(T.unpivot_slots(_days(t), sunrise=True))


@query(f"WITH {TIMETABLE} SELECT strftime(date, '%Y-%m-%d') AS date, hijri, {', '.join(SLOTS)} FROM days WHERE date = DATE '2024-01-15'")
def today_row(t: Tables):
    return T.today_row(_days(t), as_of()).withColumn("date", F.date_format("date", "yyyy-MM-dd")).drop("sunrise")


@query(f"WITH {TIMETABLE} SELECT strftime(date, '%Y-%m-%d') AS date, month(date) = 1 AS current_month FROM days WHERE date >= DATE '2023-12-01' AND date < DATE '2024-02-01'")
def union_months(t: Tables):
    months = F.trunc("date", "MM")
    days = _days(t).select("date", (F.month("date") == 1).alias("current_month"))
    first, second = days.where(months == F.lit("2023-12-01").cast("date")), days.where(months == F.lit("2024-01-01").cast("date"))
    return T.union_months(first, second).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(f"""WITH {TIMETABLE}, hits AS (
  SELECT event_id, min(slot_ord) AS n FROM events JOIN slots ON slots.date = CAST({sql_local('ts')} AS DATE) AND utc_ts + INTERVAL 5 MINUTE > ts GROUP BY event_id)
SELECT event_id, CAST(coalesce(n, -1) AS INTEGER) AS next_index, ([{', '.join(f"'{s}'" for s in SLOTS)}])[CAST(n AS INTEGER) + 1] AS next_name
FROM events LEFT JOIN hits USING (event_id)""")
def next_slot(t: Tables):
    instants = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    found = T.next_slot(instants, "ts", T.unpivot_slots(_days(t)))
    return found.select("event_id", "next_index", "next_name")


@query(f"""SELECT event_id, min(event_id) OVER (PARTITION BY event_type, CAST({sql_local('ts')} AS DATE)
  ORDER BY ts RANGE BETWEEN INTERVAL 299999999 MICROSECOND PRECEDING AND UNBOUNDED FOLLOWING) AS next_id FROM events""")
def next_entry(t: Tables):
    """Of all events of a type and day that are not over, the one with the smallest number."""
    events = t.events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    entries = events.withColumnRenamed("ts", "utc_ts")
    found = T.next_entry(events, "ts", entries, ["event_type"], F.struct("event_id"))
    return found.select("event_id", F.col("next.event_id").alias("next_id"))


FEED = T.Feed(
    domain="times.example.org",
    product="-//Example//Times//EN",
    name="Times",
    description="Daily times, updated often.",
    location="1 Main Street, Springfield",
    detail=" time; see example.org (method A, B)",
)


@query(rf"""WITH {TIMETABLE}, blocks AS (
  SELECT date, slot_ord, concat_ws(chr(13) || chr(10), 'BEGIN:VEVENT', 'UID:' || lower(slot) || '-' || strftime(date, '%Y-%m-%d') || '@times.example.org',
    'DTSTAMP:20240115T120000Z', 'DTSTART:' || strftime(utc_ts, '%Y%m%dT%H%M%SZ'), 'DTEND:' || strftime(utc_ts + INTERVAL 5 MINUTE, '%Y%m%dT%H%M%SZ'),
    'SUMMARY:' || slot, 'DESCRIPTION:' || slot || ' time\; see example.org (method A\, B)', 'LOCATION:1 Main Street\, Springfield', 'TRANSP:TRANSPARENT', 'END:VEVENT') AS block
  FROM slots WHERE utc_ts IS NOT NULL)
SELECT strftime(date, '%Y-%m-%d') AS date, CAST(slot_ord AS INTEGER) AS slot_ord, block FROM blocks""")
def ics_event_blocks(t: Tables):
    blocks = T.feed_blocks(T.unpivot_slots(_days(t)), as_of(), FEED)
    return blocks.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(rf"""WITH {TIMETABLE}, blocks AS (
  SELECT date, slot_ord, concat_ws(chr(13) || chr(10), 'BEGIN:VEVENT', 'UID:' || lower(slot) || '-' || strftime(date, '%Y-%m-%d') || '@times.example.org',
    'DTSTAMP:20240115T120000Z', 'DTSTART:' || strftime(utc_ts, '%Y%m%dT%H%M%SZ'), 'DTEND:' || strftime(utc_ts + INTERVAL 5 MINUTE, '%Y%m%dT%H%M%SZ'),
    'SUMMARY:' || slot, 'DESCRIPTION:' || slot || ' time\; see example.org (method A\, B)', 'LOCATION:1 Main Street\, Springfield', 'TRANSP:TRANSPARENT', 'END:VEVENT') AS block
  FROM slots WHERE utc_ts IS NOT NULL AND date >= DATE '2024-01-01' AND date < DATE '2024-03-01')
SELECT concat_ws(chr(13) || chr(10), 'BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//Example//Times//EN', 'CALSCALE:GREGORIAN', 'METHOD:PUBLISH',
  'X-WR-CALNAME:Times', 'X-WR-CALDESC:Daily times, updated often.', 'X-WR-TIMEZONE:{ZONE}', 'REFRESH-INTERVAL;VALUE=DURATION:PT12H', 'X-PUBLISHED-TTL:PT12H',
  string_agg(block, chr(13) || chr(10) ORDER BY date, slot_ord), 'END:VCALENDAR') || chr(13) || chr(10) AS value FROM blocks""")
def ics_feed(t: Tables):
    return T.ics_feed(T.unpivot_slots(_days(t)), as_of(), FEED)
