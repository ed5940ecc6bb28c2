"""Readers and writers: whole tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import HOURS_MISSING
from ..operators import calendar as C
from ..operators import menu as M
from ..operators import nutrition as N
from ..operators import stats
from ..operators import timetable as T
from ..sinks import writers
from ..sources.calendars import read_ics
from ..sources.lines import read_calendar_blocks, read_menu_lines
from ..sources.lookups import read_nutrition_lookup
from ..sources.menus import read_index, read_menu_documents, read_menu_json, read_menu_text, read_restaurant_jsons
from ..sources.timetable import read_timetable_json
from ..streaming.snapshots import stream_menu_snapshots
from .calendar_queries import FEED, ICS_EVENTS, _ics_texts
from .inputs import HOURS, MENU, TIMETABLE, as_of, iso, menu, nutrition, timetable
from .menu_queries import BLOCK, INDEX, INFO_SQL, LOOKUP, ROUND_TRIP, _hours, _info, _snapshot_texts
from .registry import Tables, query

STAMP = "2024-01-15T12:00:00"


def _stamp():
    return F.date_format(as_of(), "yyyy-MM-dd'T'HH:mm:ss")


def _written_menu(t: Tables) -> str:
    """Nested documents in blocks so small that most restaurants go on in further lines."""
    path = f"{t.scratch()}/menu"
    items = M.attach_hours(menu(t), _hours(t))
    writers.write_menu_json(items, path, _stamp(), block=BLOCK)
    return path


FIRSTS = f"""{MENU}, {HOURS}, firsts AS (
  SELECT menu.*, coalesce(h.hours, '{HOURS_MISSING}') AS hours, min(item_ord) OVER (PARTITION BY restaurant) AS restaurant_ord,
         min(item_ord) OVER (PARTITION BY restaurant, category) AS category_ord
  FROM menu LEFT JOIN hours_last h ON h.name = restaurant)"""


@query(f"WITH {FIRSTS} SELECT * FROM firsts")
def read_menu_json_written(t: Tables):
    return read_menu_json(t.spark, _written_menu(t), multi_line=False).drop("snapshot_id", "nutrition")


@query(f"""WITH {INDEX} SELECT restaurant, coalesce(h.hours, '{HOURS_MISSING}') AS hours, total_items, halal_items, categories_count, ord
FROM idx LEFT JOIN hours_last h ON h.name = restaurant""")
def index_of_written_documents(t: Tables):
    documents = read_menu_documents(t.spark, _written_menu(t), multi_line=False)
    return stats.restaurant_index_documents(documents).drop("safe_name", "filename")


@query(f"WITH {INDEX} SELECT restaurant, total_items AS value, CAST(row_number() OVER (ORDER BY total_items DESC, ord) AS INTEGER) AS rank FROM idx ORDER BY rank LIMIT 10")
def top10_of_written_menu(t: Tables):
    """Ties are settled by the ordinals the reader gives."""
    return stats.top10_items(stats.restaurant_index(read_menu_json(t.spark, _written_menu(t), multi_line=False)))


@query(f"""WITH {MENU}, {HOURS}, cats AS (SELECT restaurant, category, min(item_ord) AS c FROM menu GROUP BY ALL),
rests AS (SELECT restaurant, min(c) AS r FROM cats GROUP BY restaurant)
SELECT r AS restaurant_ord, CAST(-1 AS BIGINT) AS category_ord, CAST(-1 AS BIGINT) AS line_ord, restaurant AS line FROM rests
UNION ALL SELECT r, c, -1, '  ' || category || ':' FROM cats JOIN rests USING (restaurant)
UNION ALL SELECT r, c, item_ord, '    - ' || meal FROM menu JOIN cats USING (restaurant, category) JOIN rests USING (restaurant)
UNION ALL SELECT r, {2**62}, 0, '' FROM rests""")
def report_of_written_menu(t: Tables):
    return M.menu_report_lines(read_menu_json(t.spark, _written_menu(t), multi_line=False))


@query(f"WITH {FIRSTS} SELECT * FROM firsts")
def read_restaurant_jsons_written(t: Tables):
    path = f"{t.scratch()}/restaurants"
    items = M.attach_hours(menu(t), _hours(t))
    index = stats.restaurant_index(items, _hours(t))
    writers.write_restaurant_parts(items.drop("hours"), index, path, _stamp(), block=BLOCK)
    return read_restaurant_jsons(t.spark, path, multi_line=False).drop("file_name", "nutrition")


@query(f"WITH {INDEX} SELECT restaurant, total_items, halal_items, categories_count, ord, '{STAMP}' AS created_at FROM idx")
def write_index_written(t: Tables):
    path = f"{t.scratch()}/index"
    writers.write_index(stats.restaurant_index(menu(t)), path, _stamp())
    return t.spark.read.json(path).drop("safe_name", "filename")


@query(f"""WITH {INDEX} SELECT restaurant, replace(lower(restaurant), '#', '') AS safe_name, total_items, halal_items, categories_count,
       CAST(row_number() OVER (ORDER BY ord) - 1 AS INTEGER) AS ord FROM idx""")
def read_index_written(t: Tables):
    """An index document with one entry per restaurant of the table."""
    path = f"{t.scratch()}/index.json"
    index = stats.restaurant_index(menu(t))
    entry = F.struct("filename", "safe_name", F.lit(HOURS_MISSING).alias("hours"), "total_items", "halal_items", "categories_count")
    listed = F.array_sort(F.collect_list(F.struct("ord", F.struct(F.col("restaurant"), entry))))
    entries = F.map_from_entries(F.transform(listed, lambda e: e["col2"]))
    whole = index.agg(_stamp().alias("created_at"), F.count("*").alias("total_restaurants"), entries.alias("restaurants"))
    whole.select(F.to_json(F.struct("created_at", "total_restaurants", "restaurants")).alias("value")).write.text(path)
    return read_index(t.spark, path).drop("filename", "hours")


@query(f"""WITH {INDEX}, tops AS (SELECT restaurant, unnest(['top_restaurants_by_items', 'top_restaurants_by_halal', 'restaurants_by_category_count']) AS list,
       unnest([total_items, halal_items, categories_count]) AS value, ord FROM idx),
ranked AS (SELECT list, restaurant, value, row_number() OVER (PARTITION BY list ORDER BY value DESC, ord) AS rank FROM tops)
SELECT * FROM ranked WHERE rank <= 10 UNION ALL SELECT 'summary', NULL, CAST(sum(total_items) AS BIGINT), NULL FROM idx""")
def write_summary_written(t: Tables):
    path = f"{t.scratch()}/summary"
    writers.write_summary(stats.restaurant_index(menu(t)), path)
    names = ("top_restaurants_by_items", "top_restaurants_by_halal", "restaurants_by_category_count")
    found = None
    for name in names:
        rows = t.spark.read.json(f"{path}/{name}").select(F.lit(name).alias("list"), "restaurant", "value", F.col("rank").cast("long"))
        found = rows if found is None else found.unionByName(rows)
    none = F.lit(None)
    total = t.spark.read.json(f"{path}/summary").select(
        F.lit("summary").alias("list"), none.cast("string").alias("restaurant"), F.col("total_items").alias("value"), none.cast("long").alias("rank")
    )
    return found.unionByName(total)


def _text_files(t: Tables) -> str:
    """A text file per snapshot."""
    path = f"{t.scratch()}/texts"
    _snapshot_texts(t).repartition("snapshot_id").write.partitionBy("snapshot_id").text(path)
    return path


TEXT_ROWS = f"""WITH {ROUND_TRIP}
SELECT CAST(snapshot_id AS VARCHAR) AS snapshot, restaurant, hours, category, meal, r AS restaurant_ord, c AS category_ord,
       r * {2**42} + c * {2**21} + i AS item_ord FROM placed"""


def _text_rows(rows):
    snapshot = F.regexp_extract("snapshot_id", "snapshot_id=([0-9]+)", 1).alias("snapshot")
    ords = [F.col(c).cast("long").alias(c) for c in ("restaurant_ord", "category_ord")]
    return rows.select(snapshot, "restaurant", "hours", "category", "meal", *ords, "item_ord")


@query(TEXT_ROWS)
def read_menu_text_written(t: Tables):
    return _text_rows(read_menu_text(t.spark, f"{_text_files(t)}/*/*.txt"))


@query(f"SELECT * EXCLUDE (item_ord) FROM ({TEXT_ROWS})")
def read_menu_lines_written(t: Tables):
    """Line by line, so that a text need not fit in a row; the ordinal is the line's number."""
    return _text_rows(read_menu_lines(t.spark, f"{_text_files(t)}/*/*.txt")).drop("item_ord")


@query(ICS_EVENTS)
def read_calendar_lines_written(t: Tables):
    """Calendar files read line by line, their blocks read as events."""
    path = f"{t.scratch()}/calendars"
    _ics_texts(t).repartition("calendar_id").write.partitionBy("calendar_id").text(path)
    number = F.regexp_extract("snapshot_id", "calendar_id=([0-9]+)", 1).cast("long").alias("calendar_id")
    blocks = read_calendar_blocks(t.spark, f"{path}/*/*.txt").select(number, "ord", "block")
    keep = ["calendar_id"]
    events = C.valid_events(C.event_projection(C.raw_fields(blocks, keep), keep))
    columns = ["calendar_id", "ord", "id", "title", "description", "location", "rsvp_url"]
    return events.select(*columns, iso("start").alias("start"), iso("end").alias("end"))


@query(TEXT_ROWS)
def stream_menu_snapshots_written(t: Tables):
    files, folder = _text_files(t), t.scratch()
    rows = stream_menu_snapshots(t.spark, f"{files}/*")
    writer = rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows")
    writer.trigger(availableNow=True).start().awaitTermination()
    return _text_rows(t.spark.read.schema(rows.schema).parquet(f"{folder}/rows"))


@query(f"""WITH {MENU}, cats AS (SELECT restaurant, category, min(item_ord) AS c FROM menu GROUP BY ALL), rests AS (SELECT restaurant, min(c) AS r FROM cats GROUP BY 1),
lines AS (SELECT restaurant AS line FROM rests UNION ALL SELECT '  ' || category || ':' FROM cats UNION ALL SELECT '    - ' || meal FROM menu UNION ALL SELECT '' FROM rests)
SELECT line, count(*) AS n FROM lines GROUP BY line""")
def write_menu_text_written(t: Tables):
    path = f"{t.scratch()}/report"
    writers.write_menu_text(M.menu_report_lines(menu(t)), path)
    return t.spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query(f"WITH {LOOKUP} SELECT rest_key, item_key, {INFO_SQL} FROM own UNION ALL SELECT '*', item_key, {INFO_SQL} FROM shared")
def read_nutrition_lookup_written(t: Tables):
    path = f"{t.scratch()}/lookup"
    writers.write_nutrition_lookup(*N.build_nutrition_lookup(nutrition(t), ["item_ord"]), path)
    own, shared = read_nutrition_lookup(t.spark, path)
    both = own.unionByName(shared.withColumn("rest_key", F.lit("*")))
    return both.select("rest_key", "item_key", *_info())


@query(f"WITH {TIMETABLE} SELECT strftime(date, '%Y-%m-%d') AS date, hijri, Fajr, Dhuhr, Asr, Maghrib, Isha, sunrise FROM days")
def read_timetable_json_written(t: Tables):
    path = f"{t.scratch()}/timetable"
    months = timetable(t).groupBy(F.substring("date.gregorian.date", 4, 7).alias("month")).agg(F.collect_list(F.struct("timings", "date")).alias("data"))
    months.select(F.to_json(F.struct("data")).alias("value")).write.text(path)
    days = T.timetable_day(read_timetable_json(t.spark, path, multi_line=False).drop("snapshot_id"))
    return days.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(f"""WITH {TIMETABLE} SELECT lower(slot) || '-' || strftime(date, '%Y-%m-%d') || '@times.example.org' AS id, slot AS title,
       strftime(utc_ts, '%Y-%m-%dT%H:%M:%S') AS start FROM slots WHERE utc_ts IS NOT NULL AND date >= DATE '2024-01-01' AND date < DATE '2024-03-01'""")
def read_ics_feed_written(t: Tables):
    path = f"{t.scratch()}/feed"
    writers.write_ics_feed(T.ics_feed(T.unpivot_slots(T.timetable_day(timetable(t))), as_of(), FEED), path)
    return C.sort_events(read_ics(t.spark, f"{path}/*.txt")).select("id", "title", iso("start").alias("start"))
