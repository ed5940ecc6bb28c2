"""Menu, hours, calendar and timetable inputs derived from the benchmark tables.

Each comes twice: as a Spark plan and as the SQL common table expression that gives the same
rows to the checking engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import ZONE
from .registry import Tables

# --- menus: brand is the restaurant, type the category, name the meal ----------------------


def menu(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_brand").alias("restaurant"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("meal"),
        (F.col("p_size") % 3 == 0).alias("is_halal"),
        F.col("p_partkey").alias("item_ord"),
    )


MENU = """menu AS (
  SELECT p_brand AS restaurant, p_type AS category, p_name AS meal,
         p_size % 3 = 0 AS is_halal, p_partkey AS item_ord
  FROM part)"""

# Menu snapshots are runs of consecutive ordinals, so a snapshot has a fixed largest size.
SNAPSHOT_ITEMS = 1000


def menu_snapshots(t: Tables) -> DataFrame:
    return menu(t).withColumn("snapshot_id", F.floor(F.col("item_ord") / SNAPSHOT_ITEMS))


MENU_SNAPSHOTS = f"""{MENU},
snapshots AS (SELECT *, item_ord // {SNAPSHOT_ITEMS} AS snapshot_id FROM menu)"""


def nutrition(t: Tables) -> DataFrame:
    """Menu rows with a nutrition document; some have none, some have gaps."""
    size = F.col("p_size").cast("double")

    def fact(amount: Column, unit: str, daily: Column) -> Column:
        return F.struct(
            amount.alias("amount"), F.lit(unit).alias("unit"), daily.alias("daily_value_percent")
        )

    none = F.lit(None).cast("double")
    facts = F.create_map(
        F.lit("Total Fat"), fact(size, "g", size * 2), F.lit("Sodium"), fact(size * 10, "mg", none)
    )
    serving = F.struct(
        F.lit(1).alias("servings_per_container"), F.format_string("%d oz", "p_size").alias("serving_size")
    )
    document = F.struct(
        F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.col("p_name")).alias("item_name"),
        F.when(F.col("p_size") % 4 != 0, serving).alias("serving_info"),
        F.floor("p_retailprice").cast("string").alias("calories"),
        F.when(F.col("p_size") % 2 == 0, facts).alias("nutrition_facts"),
        F.create_map(F.lit("Potas."), fact(size * 5, "mg", none)).alias("secondary_nutrients"),
        F.when(F.col("p_size") % 7 != 0, F.concat(F.lit("made of "), "p_name")).alias("ingredients"),
        F.lit(None).cast("string").alias("allergens"),
    )
    return t.part.select(
        F.col("p_brand").alias("restaurant"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("meal"),
        (F.col("p_size") % 3 == 0).alias("is_halal"),
        F.col("p_partkey").alias("item_ord"),
        F.when(F.col("p_partkey") % 6 != 5, document).alias("nutrition"),
    )


NUTRITION = """nutrition AS (
  SELECT p_brand AS restaurant, p_type AS category, p_name AS meal,
         p_size % 3 = 0 AS is_halal, p_partkey AS item_ord, p_partkey % 6 <> 5 AS has_nutrition,
         replace(lower(p_brand), '#', ' ') AS rest_key, lower(p_name) AS item_key,
         p_name AS item,
         CASE WHEN p_size % 4 <> 0 THEN p_size || ' oz' END AS serving_size,
         CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) AS calories,
         CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS total_fat,
         CAST(p_size * 5 AS DOUBLE) AS potassium,
         CASE WHEN p_size % 7 <> 0 THEN 'made of ' || p_name END AS ingredients
  FROM part)"""

# --- opening hours of suppliers -------------------------------------------------------------

# shape -> (raw text, text after separators are fixed, ranges in minutes as SQL)
_SHAPES = {
    "none": ("Hours not available", "Hours not available", []),
    "past": ("{c} pm - 2 am", "{c} pm - 2 am", [("720 + 60 * c", "120")]),
    "bad": ("{o} am", "{o} am", []),
    "mid": ("{o} am - Midnight", "{o} am - Midnight", [("60 * o", "1440")]),
    "noon": ("Noon - {c} pm", "Noon - {c} pm", [("720", "720 + 60 * c")]),
    "multi": (
        "{o} am - 11:30 amNoon - 2 pm5 pm - 9:15 pm",
        "{o} am - 11:30 am, Noon - 2 pm, 5 pm - 9:15 pm",
        [("60 * o", "690"), ("720", "840"), ("1020", "1275")],
    ),
    "dash": ("{o}:30 am – {c} pm", "{o}:30 am – {c} pm", [("60 * o + 30", "720 + 60 * c")]),
    "plain": ("{o} am - {c} pm", "{o} am - {c} pm", [("60 * o", "720 + 60 * c")]),
}
_SHAPE_OF = (("none", 13), ("past", 17), ("bad", 19), ("mid", 11), ("noon", 7), ("multi", 5), ("dash", 3))


def _sql_text(index: int) -> str:
    cases = []
    for shape, texts in _SHAPES.items():
        text = "'" + texts[index].replace("{o}", "' || o || '").replace("{c}", "' || c || '") + "'"
        cases.append(f"WHEN '{shape}' THEN {text}")
    return "CASE shape " + " ".join(cases) + " END"


def hours_raw(t: Tables) -> DataFrame:
    """``pos, name, raw_hours``: several suppliers share a name, so the last one counts."""
    key = F.col("s_suppkey")
    opening, closing = (6 + key % 5).cast("string"), (1 + key % 9).cast("string")
    shape = F.lit("plain")
    for name, every in reversed(_SHAPE_OF):
        shape = F.when(key % every == 0, F.lit(name)).otherwise(shape)
    raw = F.element_at(F.create_map(*[F.lit(v) for s, texts in _SHAPES.items() for v in (s, texts[0])]), shape)
    raw = F.replace(F.replace(raw, F.lit("{o}"), opening), F.lit("{c}"), closing)
    return t.supplier.select(
        key.alias("pos"), F.concat(F.lit("Brand#"), (key % 40).cast("string")).alias("name"), raw.alias("raw_hours")
    )


HOURS = f"""hour_shapes AS (
  SELECT s_suppkey AS pos, 'Brand#' || (s_suppkey % 40) AS name, 6 + s_suppkey % 5 AS o, 1 + s_suppkey % 9 AS c,
         CASE {' '.join(f"WHEN s_suppkey % {n} = 0 THEN '{s}'" for s, n in _SHAPE_OF)} ELSE 'plain' END AS shape
  FROM supplier),
hours AS (SELECT pos, name, shape, o, c, {_sql_text(0)} AS raw_hours, {_sql_text(1)} AS hours FROM hour_shapes),
hours_last AS (SELECT * FROM hours WHERE pos IN (SELECT max(pos) FROM hours GROUP BY name)),
hour_ranges AS ({' UNION ALL '.join(
    f"SELECT pos, name, {n} AS range_pos, CAST({a} AS INTEGER) AS start_min, CAST({b} AS INTEGER) AS end_min FROM hour_shapes WHERE shape = '{s}'"
    for s, (_, _, ranges) in _SHAPES.items() for n, (a, b) in enumerate(ranges))})"""

# --- calendar events ------------------------------------------------------------------------

AS_OF = "2024-01-15 12:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def calendar(t: Tables) -> DataFrame:
    """``ord, title, start, end``: an event lasts ``value`` minutes."""
    start = F.col("ts").cast("timestamp")
    seconds = F.floor(F.col("value") * 60)
    return t.events.select(
        F.col("event_id").alias("ord"),
        F.col("event_type").alias("title"),
        start.alias("start"),
        F.timestamp_micros(F.unix_micros(start) + seconds * 1_000_000).alias("end"),
    )


CALENDAR = """calendar AS (
  SELECT event_id AS ord, event_type AS title, ts AS start,
         ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) AS "end"
  FROM events)"""


def sql_local(instant: str) -> str:
    return f"timezone('{ZONE}', timezone('UTC', {instant}))"


def sql_utc(wall: str) -> str:
    return f"timezone('UTC', timezone('{ZONE}', {wall}))"


def iso(instant: Column | str) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss")


def sql_iso(instant: str) -> str:
    return f"strftime({instant}, '%Y-%m-%dT%H:%M:%S')"


# --- timetable ------------------------------------------------------------------------------

_SLOT_TIMES = {
    "Fajr": ("05", "10 + d"),
    "Dhuhr": ("12", "10 + d"),
    "Asr": ("15", "d"),
    "Maghrib": ("17", "20 + d"),
    "Isha": ("19", "d"),
}


def timetable(t: Tables) -> DataFrame:
    """Stored timetable days (``timings``, ``date``) for every local day that has events.

    Some days miss a slot, the sunrise, the hijri date, or have an unreadable time.
    """
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), ZONE)
    days = t.events.select(F.to_date(local).alias("day")).distinct()
    d = F.dayofmonth("day")

    def clock(hour: str, minute: Column) -> Column:
        return F.concat(F.lit(hour + ":"), F.lpad(minute.cast("string"), 2, "0"), F.lit(" (EST)"))

    minutes = {slot: F.expr(rule.replace("d", "dayofmonth(day)")) for slot, (_, rule) in _SLOT_TIMES.items()}
    times = {slot: clock(hour, minutes[slot]) for slot, (hour, _) in _SLOT_TIMES.items()}
    times["Asr"] = F.when(d % 7 != 0, times["Asr"])
    times["Isha"] = F.when(d % 8 == 0, F.lit("late")).otherwise(times["Isha"])
    times["Sunrise"] = F.when(d % 5 != 0, clock("07", 10 + d % 20))
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), v.alias("v")) for n, v in times.items()])
    stored = F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
    hijri = F.struct(
        d.cast("string").alias("day"), F.lit("1445").alias("year"), F.struct(F.lit("Rajab").alias("en")).alias("month")
    )
    date = F.struct(
        F.struct(F.date_format("day", "dd-MM-yyyy").alias("date")).alias("gregorian"),
        F.when(d % 9 != 0, hijri).alias("hijri"),
    )
    return days.select(stored.alias("timings"), date.alias("date"))


def _sql_clock(hour: str, minute: str) -> str:
    return f"'{hour}:' || lpad(CAST({minute} AS VARCHAR), 2, '0')"


_SQL_TIMES = {slot: _sql_clock(hour, rule) for slot, (hour, rule) in _SLOT_TIMES.items()}
_SQL_TIMES["Asr"] = f"CASE WHEN d % 7 <> 0 THEN {_SQL_TIMES['Asr']} ELSE '' END"
_SQL_TIMES["Isha"] = f"CASE WHEN d % 8 = 0 THEN 'late' ELSE {_SQL_TIMES['Isha']} END"
_SQL_SUNRISE = f"CASE WHEN d % 5 <> 0 THEN {_sql_clock('07', '10 + d % 20')} END"

TIMETABLE = f"""local_days AS (
  SELECT DISTINCT CAST({sql_local('ts')} AS DATE) AS date FROM events),
numbered AS (SELECT date, CAST(day(date) AS INTEGER) AS d FROM local_days),
days AS (
  SELECT date, d, CASE WHEN d % 9 <> 0 THEN 'Rajab ' || d || ', 1445 AH' END AS hijri,
         {', '.join(f'{sql} AS {slot}' for slot, sql in _SQL_TIMES.items())}, {_SQL_SUNRISE} AS sunrise
  FROM numbered),
listed AS ({' UNION ALL '.join(
    f"SELECT date, hijri, {n} AS slot_ord, '{slot}' AS slot, 'prayer' AS kind, {slot} AS local_hhmm FROM days"
    for n, slot in enumerate(_SLOT_TIMES))}),
slots AS (
  SELECT *, CASE WHEN regexp_full_match(local_hhmm, '[0-9]{{1,2}}:[0-9]{{2}}')
                 THEN {sql_utc("date + to_seconds(60 * (60 * TRY_CAST(split_part(local_hhmm, ':', 1) AS INTEGER) + TRY_CAST(split_part(local_hhmm, ':', 2) AS INTEGER)))")}
            END AS utc_ts
  FROM listed)"""
