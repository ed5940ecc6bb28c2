"""Menu, index, ranking, search and nutrition queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed_values import CROSSWALK, HOURS_MISSING
from ..functions.labels import major_nutrient_flag
from ..functions.text import classify_menu_line
from ..operators import menu as M
from ..operators import nutrition as N
from ..operators import search as S
from ..operators import stats
from ..operators.ordering import carry_forward as carry
from ..operators.ordering import dedup_first_seen as first_seen
from ..operators.ordering import first_wins as keep_first
from ..operators.ordering import last_wins as keep_last
from ..sources.lookups import crosswalk_dim
from ..sources.menus import DOCUMENT, flatten_documents, parse_menu_restaurants, parse_menu_text
from ..streaming.index import KeptIndex, keep_index
from ..streaming.snapshots import latest_snapshot as newest
from ..streaming.snapshots import read_latest, write_latest
from .inputs import (
    HOURS,
    MENU,
    MENU_SNAPSHOTS,
    NUTRITION,
    SNAPSHOT_ITEMS,
    as_of,
    hours_raw,
    menu,
    menu_snapshots,
    nutrition,
    sql_local,
)
from .registry import Tables, query

# --- index and statistics -------------------------------------------------------------------


def _hours(t: Tables):
    return M.hours_by_name(hours_raw(t), crosswalk_dim(t.spark, {}))


def _index(t: Tables):
    return stats.restaurant_index(menu(t), _hours(t))


INDEX = f"""{MENU}, {HOURS},
idx AS (
  SELECT restaurant, count(*) AS total_items, count(*) FILTER (WHERE is_halal) AS halal_items,
         count(DISTINCT category) AS categories_count, min(item_ord) AS ord
  FROM menu GROUP BY restaurant)"""


@query(f"""WITH {INDEX}
SELECT restaurant, replace(lower(restaurant), '#', '') AS safe_name, replace(lower(restaurant), '#', '') || '.json' AS filename,
       coalesce(h.hours, '{HOURS_MISSING}') AS hours, total_items, halal_items, categories_count
FROM idx LEFT JOIN hours_last h ON h.name = idx.restaurant""")
def restaurant_index(t: Tables):
    return _index(t).drop("ord")


@query("""SELECT p_brand AS restaurant, count(*) AS total_items, count(*) FILTER (WHERE p_size % 3 = 0) AS halal_items,
       count(DISTINCT p_type) AS categories_count
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def restaurant_index_sales(t: Tables):
    # Sales are counted per part before the join, so the join moves one row per part.
    sold = t.lineitem.groupBy(F.col("l_partkey").alias("item_ord")).agg(F.count("*").alias("sold"))
    index = stats.restaurant_index(menu(t).join(sold, ["item_ord"]), weight="sold")
    return index.select("restaurant", "total_items", "halal_items", "categories_count")


@query(f"WITH {INDEX} SELECT CAST(sum(total_items) AS BIGINT) AS total_items, CAST(sum(halal_items) AS BIGINT) AS halal_items FROM idx")
def index_totals(t: Tables):
    return stats.index_totals(stats.restaurant_index(menu(t)))


@query(f"""WITH {INDEX}
SELECT count(*) AS total_restaurants, CAST(sum(total_items) AS BIGINT) AS total_items,
       CAST(sum(halal_items) AS BIGINT) AS total_halal_items,
       count(*) FILTER (WHERE halal_items > 0) AS restaurants_with_halal,
       round_even(CAST(sum(total_items) AS DOUBLE) / count(*), 1) AS average_items_per_restaurant
FROM idx""")
def summary_stats(t: Tables):
    return stats.summary_stats(stats.restaurant_index(menu(t)))


def _ranked(value: str) -> str:
    return f"""WITH {INDEX} SELECT restaurant, {value} AS value, CAST(row_number() OVER (ORDER BY {value} DESC, ord) AS INTEGER) AS rank
FROM idx ORDER BY {value} DESC, ord LIMIT 10"""


@query(_ranked("total_items"))
def top10_items(t: Tables):
    return stats.top10_items(stats.restaurant_index(menu(t)))


@query(_ranked("halal_items"))
def top10_halal(t: Tables):
    return stats.top10_halal(stats.restaurant_index(menu(t)))


@query(_ranked("categories_count"))
def top10_categories(t: Tables):
    return stats.top10_categories(stats.restaurant_index(menu(t)))


@query(f"WITH {MENU} SELECT restaurant, count(*) AS item_count, min(item_ord) AS ord FROM menu GROUP BY restaurant")
def menu_counts(t: Tables):
    return stats.menu_counts(menu(t))


@query(f"WITH {MENU} SELECT count(DISTINCT restaurant) AS restaurants, count(*) AS total_items FROM menu")
def menu_totals(t: Tables):
    return stats.menu_totals(stats.menu_counts(menu(t)))


@query(f"""WITH {MENU} SELECT restaurant, count(*) AS item_count, min(item_ord) AS ord,
       CAST(row_number() OVER (ORDER BY count(*) DESC, min(item_ord)) AS INTEGER) AS rank FROM menu
GROUP BY restaurant ORDER BY item_count DESC, ord LIMIT 4""")
def top4_restaurants(t: Tables):
    return stats.top4_restaurants(stats.menu_counts(menu(t)))


# --- index kept up to date while snapshots arrive ---------------------------------------------

NEWEST = f"""{MENU_SNAPSHOTS},
newest AS (SELECT restaurant, max(snapshot_id) AS snapshot_id FROM snapshots GROUP BY restaurant),
sections AS (SELECT snapshots.* FROM snapshots JOIN newest USING (restaurant, snapshot_id)),
idx AS (
  SELECT restaurant, count(*) AS total_items, count(*) FILTER (WHERE is_halal) AS halal_items,
         count(DISTINCT category) AS categories_count, min(item_ord) AS ord
  FROM sections GROUP BY restaurant)"""


def _kept(t: Tables) -> KeptIndex:
    """The menu as snapshots that arrive in up to three batches, each snapshot whole in one file."""
    folder = t.scratch()
    rows = menu_snapshots(t).withColumns({"snapshot_ts": F.col("snapshot_id"), "snapshot_id": F.col("snapshot_id").cast("string")})
    rows.repartitionByRange(3, "snapshot_ts").write.parquet(f"{folder}/in")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    keep_index(stream, f"{folder}/kept", f"{folder}/state", buckets=8).awaitTermination()
    return KeptIndex(t.spark, f"{folder}/kept")


@query(f"""WITH {NEWEST} SELECT restaurant, replace(lower(restaurant), '#', '') AS safe_name, replace(lower(restaurant), '#', '') || '.json' AS filename,
       total_items, halal_items, categories_count, ord FROM idx""")
def restaurant_index_kept(t: Tables):
    return _kept(t).restaurant_index()


@query(f"""WITH {NEWEST}
SELECT count(*) AS total_restaurants, CAST(sum(total_items) AS BIGINT) AS total_items,
       CAST(sum(halal_items) AS BIGINT) AS total_halal_items,
       count(*) FILTER (WHERE halal_items > 0) AS restaurants_with_halal,
       round_even(CAST(sum(total_items) AS DOUBLE) / count(*), 1) AS average_items_per_restaurant
FROM idx""")
def summary_stats_kept(t: Tables):
    return _kept(t).summary_stats()


@query(f"""WITH {NEWEST} SELECT category, count(*) AS total_items, count(*) FILTER (WHERE is_halal) AS halal_items,
       count(DISTINCT restaurant) AS restaurants FROM sections GROUP BY category""")
def category_totals_kept(t: Tables):
    return _kept(t).category_totals()


# --- keyed dedup ----------------------------------------------------------------------------


@query(f"""WITH {MENU} SELECT restaurant, category, meal, min(item_ord) AS item_ord FROM menu
GROUP BY restaurant, category, meal""")
def dedup_first_seen(t: Tables):
    return first_seen(menu(t), ["restaurant", "category", "meal"], "item_ord")


@query(f"WITH {HOURS} SELECT name, raw_hours, pos FROM hours_last")
def last_wins(t: Tables):
    return keep_last(hours_raw(t), ["name"], F.col("pos"), ["raw_hours", "pos"])


@query(f"WITH {HOURS} SELECT name AS restaurant, hours, pos FROM hours_last")
def hours_by_name(t: Tables):
    return _hours(t)


LATEST = """SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE (o_custkey, o_orderdate, o_orderkey) IN (
  SELECT o_custkey, (m).d, (m).k FROM (
    SELECT o_custkey, max({'d': o_orderdate, 'k': o_orderkey}) AS m FROM orders GROUP BY o_custkey))"""


def _latest(orders):
    order = F.struct("o_orderdate", "o_orderkey")
    return newest(orders, ["o_custkey"], ["o_orderkey", "o_orderstatus", "o_totalprice"], order)


@query(LATEST)
def latest_snapshot(t: Tables):
    return _latest(t.orders)


@query(LATEST)
def latest_snapshot_stream(t: Tables):
    folder = t.scratch()
    write_latest(_latest(t.stream("orders")), f"{folder}/rows", f"{folder}/state", ["o_custkey"]).awaitTermination()
    return read_latest(t.spark, f"{folder}/rows")


@query("""SELECT p_name, p_brand, p_partkey FROM part WHERE p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_name)""")
def first_wins(t: Tables):
    return keep_first(t.part, ["p_name"], F.col("p_partkey"), ["p_brand", "p_partkey"])


# --- filters --------------------------------------------------------------------------------


@query(f"WITH {MENU} SELECT * FROM menu WHERE is_halal")
def halal_only(t: Tables):
    return M.halal_only(menu(t))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'OPEN now' WHEN 'P' THEN 'Opens later' ELSE 'Closed' END AS status
FROM orders WHERE o_orderstatus IN ('O', 'P')""")
def open_units_only(t: Tables):
    code = F.col("o_orderstatus")
    status = F.when(code == "O", "OPEN now").when(code == "P", "Opens later").otherwise("Closed")
    return M.open_units_only(t.orders.select("o_orderkey", status.alias("status")))


@query("SELECT doc_id, lang FROM documents WHERE n_chars % 4 <> 0")
def drop_empty_panels(t: Tables):
    notice = F.when(F.col("n_chars") % 4 == 0, "There are no items available").otherwise("")
    panels = t.documents.select("doc_id", "lang", F.concat("text", notice).alias("text"))
    return M.drop_empty_panels(panels).select("doc_id", "lang")


# All rows stay; most have no meal, so that some categories and restaurants are empty.
SPARSE = f"""{MENU}, sparse AS (
  SELECT restaurant, category, item_ord, CASE WHEN item_ord % 97 < 3 THEN meal END AS meal FROM menu)"""


def _sparse(t: Tables):
    meal = F.when(F.col("item_ord") % 97 < 3, F.col("meal"))
    return menu(t).select("restaurant", "category", "item_ord", meal.alias("meal"))


@query(f"WITH {SPARSE} SELECT restaurant, category, bool_or(meal IS NOT NULL) AS has_meals FROM sparse GROUP BY restaurant, category")
def any_meals(t: Tables):
    return M.any_meals(_sparse(t), ["restaurant", "category"])


@query(f"WITH {SPARSE} SELECT restaurant, category, item_ord, meal FROM sparse WHERE meal IS NOT NULL")
def nonempty_categories(t: Tables):
    return M.nonempty_categories(_sparse(t))


@query(f"""WITH {SPARSE} SELECT restaurant, category, item_ord, meal FROM sparse
WHERE (restaurant, category) IN (SELECT restaurant, category FROM sparse WHERE meal IS NOT NULL)""")
def nonempty_restaurants(t: Tables):
    return M.nonempty_restaurants(_sparse(t), ["restaurant", "category"])


@query("""SELECT p_partkey, p_size % 3 = 0 AS is_halal FROM part""")
def flag_from_alts(t: Tables):
    size = F.col("p_size")
    alts = F.when(size % 3 == 0, F.array(F.lit("vegan"), F.lit(None).cast("string"), F.lit(" HALAL icon "))).when(
        size % 3 == 1, F.array(F.lit("vegan"))
    )
    return t.part.select("p_partkey", M.flag_from_alts(alts).alias("is_halal"))


# --- joins ----------------------------------------------------------------------------------

_NAMES = [*CROSSWALK, "Unlisted Corner", "cafe", "bella union"]


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


@query(f"""SELECT s_suppkey, name, coalesce(target, name) AS restaurant
FROM (SELECT s_suppkey, ([{_sql_list(_NAMES)}])[CAST(s_suppkey % {len(_NAMES)} AS INTEGER) + 1] AS name FROM supplier)
LEFT JOIN (SELECT unnest([{_sql_list(CROSSWALK)}]) AS source, unnest([{_sql_list(CROSSWALK.values())}]) AS target) ON source = name""")
def crosswalk_names(t: Tables):
    listed = F.array(*[F.lit(n) for n in _NAMES])
    name = F.get(listed, (F.col("s_suppkey") % len(_NAMES)).cast("int"))
    rows = t.supplier.select("s_suppkey", name.alias("name"))
    return M.crosswalk_names(rows, crosswalk_dim(t.spark), "name", "restaurant")


@query(f"""SELECT s_suppkey, coalesce(source, name) AS restaurant
FROM (SELECT s_suppkey, ([{_sql_list(CROSSWALK.values())}])[CAST(s_suppkey % {len(CROSSWALK)} AS INTEGER) + 1] AS name FROM supplier)
LEFT JOIN (SELECT unnest([{_sql_list(CROSSWALK)}]) AS source, unnest([{_sql_list(CROSSWALK.values())}]) AS target) ON target = name""")
def crosswalk_inverse(t: Tables):
    listed = F.array(*[F.lit(n) for n in CROSSWALK.values()])
    name = F.get(listed, (F.col("s_suppkey") % len(CROSSWALK)).cast("int"))
    rows = t.supplier.select("s_suppkey", name.alias("name"))
    return M.crosswalk_names(rows, crosswalk_dim(t.spark, inverse=True), "name", "restaurant").drop("name")


@query(f"""WITH {MENU}, {HOURS}
SELECT restaurant, item_ord, coalesce(h.hours, '{HOURS_MISSING}') AS hours
FROM menu LEFT JOIN hours_last h ON h.name = menu.restaurant""")
def attach_hours(t: Tables):
    return M.attach_hours(menu(t).select("restaurant", "item_ord"), _hours(t))


@query(f"""WITH {MENU}, {HOURS}
SELECT restaurant, item_ord, coalesce(h.hours, '{HOURS_MISSING}') AS hours
FROM menu LEFT JOIN hours_last h ON h.name = menu.restaurant""")
def attach_hours_normalized(t: Tables):
    shouted = _hours(t).withColumn("restaurant", F.concat(F.upper("restaurant"), F.lit(" !")))
    # Names that share the key: an earlier row with a greater text loses to the last one.
    earlier = shouted.withColumns({"restaurant": F.concat("restaurant", F.lit("!")), "hours": F.lit("~ earlier"), "pos": F.lit(-1).cast("long")})
    shouted = shouted.unionByName(earlier)
    return M.attach_hours(menu(t).select("restaurant", "item_ord"), shouted, normalize=True)


@query(f"""WITH {HOURS}
SELECT event_id, CASE WHEN o.name IS NULL THEN NULL ELSE EXISTS (
    SELECT 1 FROM hour_ranges r WHERE r.pos = o.pos AND r.start_min <= m AND m < r.end_min) END AS is_open
FROM (SELECT event_id, 'Brand#' || (user_id % 40) AS name, hour({sql_local('ts')}) * 60 + minute({sql_local('ts')}) AS m FROM events) e
LEFT JOIN (SELECT * FROM hours_last WHERE shape NOT IN ('none', 'bad')) o USING (name)""")
def open_at(t: Tables):
    visits = t.events.select(
        "event_id",
        F.concat(F.lit("Brand#"), (F.col("user_id") % 40).cast("string")).alias("name"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    return S.open_at_join(visits, _hours(t), "name", "ts").select("event_id", "is_open")


@query(f"""WITH {HOURS}
SELECT event_id, CASE WHEN o.name IS NULL THEN NULL ELSE EXISTS (
    SELECT 1 FROM hour_ranges r WHERE r.pos = o.pos AND r.start_min <= m AND m < r.end_min) END AS is_open,
  CASE WHEN o.name IS NULL THEN NULL ELSE EXISTS (
    SELECT 1 FROM hour_ranges r WHERE r.pos = o.pos AND r.start_min <= m AND m + 45 <= r.end_min) END AS is_open_for
FROM (SELECT event_id, 'Brand#' || (user_id % 40) AS name, hour({sql_local('ts')}) * 60 + minute({sql_local('ts')}) AS m FROM events) e
LEFT JOIN (SELECT * FROM hours_last WHERE shape NOT IN ('none', 'bad')) o USING (name)""")
def open_for(t: Tables):
    visits = t.events.select(
        "event_id", F.concat(F.lit("Brand#"), (F.col("user_id") % 40).cast("string")).alias("name"), F.col("ts").cast("timestamp").alias("ts")
    )
    return S.open_for_join(visits, _hours(t), "name", "ts", 45).select("event_id", "is_open", "is_open_for")


@query(f"""WITH {HOURS}
SELECT name AS restaurant, o.hours FROM hours_last o
WHERE EXISTS (SELECT 1 FROM hour_ranges r WHERE r.pos = o.pos AND r.start_min <= 420 AND 420 < r.end_min)""")
def filter_open_now(t: Tables):
    return S.filter_open_now(S.open_at(_hours(t), as_of())).select("restaurant", "hours")


@query(f"WITH {MENU} SELECT * FROM menu WHERE restaurant = 'Brand#7'")
def filter_restaurant(t: Tables):
    return S.filter_restaurant(menu(t), "Brand#7")


@query(f"""WITH {MENU} SELECT restaurant, category, meal, item_ord FROM menu
WHERE contains(lower(meal), 'ring') OR contains(lower(category), 'ring') OR contains(lower(restaurant), 'ring')""")
def search_menu(t: Tables):
    return S.search_menu(menu(t), "  RiNg ").select("restaurant", "category", "meal", "item_ord")


@query(f"""WITH {MENU}, asked AS (SELECT n_nationkey AS query_id, lower(substr(n_name, 1, CAST(1 + n_nationkey % 5 AS INTEGER))) AS q FROM nation)
SELECT query_id, restaurant, category, meal, item_ord FROM asked JOIN menu
ON contains(lower(meal), q) OR contains(lower(category), q) OR contains(lower(restaurant), q)""")
def search_many(t: Tables):
    """The first one to five letters of each nation, searched at once."""
    asked = t.nation.select(F.col("n_nationkey").alias("query_id"), F.expr("substr(n_name, 1, cast(1 + n_nationkey % 5 AS int))").alias("query"))
    return S.search_many(menu(t), asked).select("query_id", "restaurant", "category", "meal", "item_ord")


@query(f"""WITH {MENU} SELECT restaurant, count(*) AS item_count FROM menu
WHERE contains(lower(meal), 'ld') OR contains(lower(category), 'ld') OR contains(lower(restaurant), 'ld') GROUP BY restaurant""")
def recount_after_filter(t: Tables):
    return S.recount_after_filter(S.search_menu(menu(t), "LD"))


# --- nutrition lookup -----------------------------------------------------------------------

LOOKUP = f"""{NUTRITION},
flagged AS (SELECT * FROM nutrition WHERE is_halal AND has_nutrition),
own AS (SELECT * FROM flagged WHERE item_ord IN (SELECT max(item_ord) FROM flagged GROUP BY rest_key, item_key)),
shared AS (SELECT * FROM flagged WHERE item_ord IN (SELECT min(item_ord) FROM flagged GROUP BY item_key)),
keyed AS (
  SELECT n.item_ord, n.restaurant, n.meal,
         CASE WHEN o.item_key IS NOT NULL THEN n.rest_key || '/' || n.item_key
              WHEN s.item_key IS NOT NULL THEN '*/' || n.item_key END AS nutrition_key
  FROM nutrition n LEFT JOIN own o ON o.rest_key = n.rest_key AND o.item_key = n.item_key
  LEFT JOIN shared s ON s.item_key = n.item_key),
info AS (
  SELECT rest_key || '/' || item_key AS nutrition_key, * FROM own
  UNION ALL SELECT '*/' || item_key AS nutrition_key, * FROM shared)"""

INFO_SQL = "item, restaurant, category, serving_size, calories, total_fat, potassium, ingredients"


def _lookup(t: Tables):
    return N.build_nutrition_lookup(nutrition(t), ["item_ord"])


def _info(column: str = "info"):
    return [
        *[F.col(f"{column}.{n}").alias(n) for n in ("item", "restaurant", "category", "serving_size", "calories")],
        F.try_element_at(f"{column}.facts", F.lit("Total Fat"))["amount"].alias("total_fat"),
        F.try_element_at(f"{column}.secondary", F.lit("Potas."))["amount"].alias("potassium"),
        F.col(f"{column}.ingredients").alias("ingredients"),
    ]


@query(f"WITH {NUTRITION} SELECT restaurant, meal, item_ord FROM nutrition WHERE is_halal AND has_nutrition")
def halal_with_nutrition(t: Tables):
    return N.halal_with_nutrition(nutrition(t)).select("restaurant", "meal", "item_ord")


@query(f"WITH {NUTRITION} SELECT item_ord, rest_key, item_key, {INFO_SQL} FROM nutrition WHERE has_nutrition")
def compact_nutrition(t: Tables):
    rows = N.compact_nutrition(nutrition(t).where("nutrition IS NOT NULL"), ["item_ord"])
    info = F.struct(*N.INFO).alias("info")
    return rows.select("item_ord", "rest_key", "item_key", info).select("item_ord", "rest_key", "item_key", *_info())


@query(f"WITH {LOOKUP} SELECT rest_key, item_key, {INFO_SQL} FROM own")
def nutrition_lookup_by_restaurant(t: Tables):
    return _lookup(t)[0].select("rest_key", "item_key", *_info())


@query(f"WITH {LOOKUP} SELECT item_key, {INFO_SQL} FROM shared")
def nutrition_lookup_by_item(t: Tables):
    return _lookup(t)[1].select("item_key", *_info())


@query(f"WITH {LOOKUP} SELECT count(*) AS n FROM flagged")
def lookup_count(t: Tables):
    return N.lookup_count(nutrition(t))


def _plain(t: Tables):
    return nutrition(t).select("item_ord", "restaurant", "meal")


def _keyed(t: Tables):
    return N.nutrition_key(_plain(t), *_lookup(t))


@query(f"WITH {LOOKUP} SELECT item_ord, restaurant, meal, nutrition_key FROM keyed")
def nutrition_key(t: Tables):
    return _keyed(t)


@query(f"WITH {LOOKUP} SELECT DISTINCT nutrition_key FROM keyed WHERE nutrition_key IS NOT NULL")
def distinct_keys(t: Tables):
    return N.distinct_keys(_keyed(t))


@query(f"""WITH {LOOKUP}, wanted AS (SELECT DISTINCT nutrition_key FROM keyed)
SELECT nutrition_key, {INFO_SQL} FROM info JOIN wanted USING (nutrition_key)""")
def nutrition_by_key(t: Tables):
    lookup = _lookup(t)
    keys = N.distinct_keys(N.nutrition_key(_plain(t), *lookup))
    return N.nutrition_by_key(keys, *lookup).select("nutrition_key", *_info())


@query(f"""WITH {LOOKUP}
SELECT k.item_ord, k.meal, k.nutrition_key, i.calories FROM keyed k LEFT JOIN info i USING (nutrition_key)""")
def item_info(t: Tables):
    shown = F.col("info.calories").alias("calories")
    return N.item_info(_plain(t), *_lookup(t)).select("item_ord", "meal", "nutrition_key", shown)


@query("""SELECT p_partkey, p_brand, p_name FROM part p WHERE p_size % 3 = 0 AND NOT EXISTS (
  SELECT 1 FROM part m WHERE m.p_size % 3 <> 0 AND m.p_brand = p.p_brand AND m.p_name = p.p_name)""")
def secondary_not_in_main(t: Tables):
    rows = t.part.select("p_partkey", "p_brand", "p_name", "p_size")
    flagged, plain = rows.where("p_size % 3 = 0"), rows.where("p_size % 3 <> 0")
    return N.secondary_not_in_main(flagged, plain, ["p_brand", "p_name"]).select("p_partkey", "p_brand", "p_name")


@query(f"""WITH {NUTRITION}
SELECT item_ord, pos, name, amount, unit, name IN ('Total Fat', 'Sodium') AS is_major FROM (
  SELECT item_ord, 0 AS pos, 'Total Fat' AS name, total_fat AS amount, 'g' AS unit FROM nutrition WHERE has_nutrition AND total_fat IS NOT NULL
  UNION ALL SELECT item_ord, 1, 'Sodium', total_fat * 10, 'mg' FROM nutrition WHERE has_nutrition AND total_fat IS NOT NULL
  UNION ALL SELECT item_ord, NULL, NULL, NULL, NULL FROM nutrition WHERE has_nutrition AND total_fat IS NULL)""")
def fact_rows(t: Tables):
    compact = N.compact_nutrition(nutrition(t).where("nutrition IS NOT NULL"), ["item_ord"])
    rows = N.fact_rows(compact, ["item_ord"]).drop("daily_value_percent")
    return rows.withColumn("is_major", major_nutrient_flag("name"))


# --- ordered state --------------------------------------------------------------------------


@query("""SELECT conv_id, turn, md5(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w) AS heading,
       CASE WHEN head_at IS NULL OR reply_at > head_at THEN md5(reply) END AS subheading
FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER w AS head_at,
             last_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER w AS reply_at,
             last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER w AS reply
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def carry_forward(t: Tables):
    role, text = F.col("role"), F.md5("text")
    headers = [("heading", role == "user", text), ("subheading", role == "assistant", text)]
    turns = t.conversations.select("conv_id", "turn", "role", "text")
    # Blocks of two turns: headers are carried across their borders.
    return carry(turns, ["conv_id"], "turn", headers, block=2).select("conv_id", "turn", "heading", "subheading")


# One stream of all events, whose key is null: a long stream in many blocks.
@query("""SELECT event_id, last_value(CASE WHEN event_id % 97 = 0 THEN event_type END IGNORE NULLS) OVER (ORDER BY event_id) AS heading,
       last_value(CASE WHEN event_id % 97 = 0 THEN event_id END IGNORE NULLS) OVER (ORDER BY event_id) AS heading_pos FROM events""")
def carry_forward_null_stream(t: Tables):
    rows = t.events.select("event_id", "event_type", F.lit(None).cast("string").alias("stream"))
    headers = [("heading", F.col("event_id") % 97 == 0, F.col("event_type"))]
    return carry(rows, ["stream"], "event_id", headers, block=50).select("event_id", "heading", "heading_pos")


PAGE = 200

CARRIED = f"""rows AS (
  SELECT p_partkey // {PAGE} AS page_id, p_partkey AS k, p_type, p_name, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS header FROM part),
carried AS (
  SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY k) AS above FROM rows)"""


@query(f"""WITH {CARRIED}
SELECT page_id, k, p_name AS meal, coalesce(above, 'Uncategorized') AS category FROM carried WHERE above IS NOT NULL OR page_id % 2 = 0""")
def carried_category_required(t: Tables):
    # A part with a key divisible by four brings its own header row along.
    key = F.col("p_partkey")
    listed = F.filter(
        F.array(
            F.struct((key * 2).alias("pos"), F.lit(True).alias("is_header"), F.col("p_type").alias("text")),
            F.struct((key * 2 + 1).alias("pos"), F.lit(False).alias("is_header"), F.col("p_name").alias("text")),
        ),
        lambda r: ~r["is_header"] | (key % 4 == 0),
    )
    rows = t.part.select(F.floor(key / PAGE).alias("page_id"), key.alias("k"), F.inline(listed))
    items = M.items_from_menu_rows(rows, auto_loaded=F.col("page_id") % 2 == 0)
    return items.select("page_id", "k", F.col("text").alias("meal"), "category")


@query(f"""WITH {MENU}, ordered AS (SELECT *, item_ord % 3 AS menu_ord, (item_ord % 3) * 4294967296 + item_ord AS seen FROM menu)
SELECT restaurant, category, meal, seen AS item_ord, min(seen) OVER (PARTITION BY restaurant, category) AS category_ord FROM ordered""")
def merge_menus(t: Tables):
    seen = M.page_order(F.col("item_ord") % 3, "item_ord")
    rows = menu(t).select("restaurant", "category", "meal", seen.alias("item_ord"))
    return M.merge_menus(rows)


# --- nesting, reports, round trips ----------------------------------------------------------


# Small blocks, so that most restaurants go on in further parts.
BLOCK = 64


@query(f"""WITH {MENU}
SELECT restaurant, min(item_ord) OVER (PARTITION BY restaurant) AS restaurant_ord, category,
       min(item_ord) OVER (PARTITION BY restaurant, category) AS category_ord, meal, is_halal, item_ord FROM menu""")
def nest_menu(t: Tables):
    nested = M.nest_menu(menu(t), block=BLOCK)
    categories = nested.select("restaurant", F.col("place").alias("restaurant_ord"), F.explode("categories").alias("_c"))
    meals = categories.select("restaurant", "restaurant_ord", "_c.*").select(
        "restaurant", "restaurant_ord", F.col("name").alias("category"), F.col("place").alias("category_ord"), F.explode("meals").alias("_m")
    )
    place = F.col("_m.place").alias("item_ord")
    return meals.select("restaurant", "restaurant_ord", "category", "category_ord", F.col("_m.name").alias("meal"), "_m.is_halal", place)


def _with_hours(t: Tables):
    return M.attach_hours(menu_snapshots(t), _hours(t))


ROUND_TRIP = f"""{MENU_SNAPSHOTS}, {HOURS},
firsts AS (
  SELECT s.*, coalesce(h.hours, '{HOURS_MISSING}') AS hours,
         min(item_ord) OVER (PARTITION BY snapshot_id, restaurant) AS rest_first,
         min(item_ord) OVER (PARTITION BY snapshot_id, restaurant, category) AS cat_first
  FROM snapshots s LEFT JOIN hours_last h ON h.name = s.restaurant),
placed AS (
  SELECT *, dense_rank() OVER (PARTITION BY snapshot_id ORDER BY rest_first) AS r,
         dense_rank() OVER (PARTITION BY snapshot_id, restaurant ORDER BY cat_first) AS c,
         row_number() OVER (PARTITION BY snapshot_id, restaurant, category ORDER BY item_ord) AS i
  FROM firsts)"""


def _snapshot_texts(t: Tables):
    """Report text per snapshot; a snapshot has at most ``SNAPSHOT_ITEMS`` items."""
    lines = M.menu_report_lines(menu_snapshots(t), _hours(t), snapshot=["snapshot_id"])
    rows = F.array_sort(F.collect_list(F.struct(*M.LINE_ORDER, "line")))
    texts = lines.groupBy("snapshot_id").agg(rows.alias("_lines"))
    text = F.array_join(F.transform("_lines", lambda row: row["line"]), "\n")
    return texts.select("snapshot_id", text.alias("value"))


@query(f"""WITH {ROUND_TRIP}
SELECT snapshot_id, restaurant, hours, category, meal, r AS restaurant_ord, c AS category_ord,
       r * {2**42} + c * {2**21} + i AS item_ord FROM placed""")
def menu_text_roundtrip(t: Tables):
    rows = parse_menu_text(_snapshot_texts(t))
    ords = [F.col(c).cast("long").alias(c) for c in ("restaurant_ord", "category_ord", "item_ord")]
    return rows.select("snapshot_id", "restaurant", "hours", "category", "meal", *ords)


@query(f"""WITH {ROUND_TRIP}
SELECT snapshot_id, restaurant, hours, max(r) AS restaurant_ord, count(*) AS item_count, max(c) AS category_count,
       max((SELECT count(*) FROM hour_ranges q JOIN hours_last l ON l.pos = q.pos WHERE l.name = placed.restaurant)) AS range_count
FROM placed GROUP BY snapshot_id, restaurant, hours""")
def menu_text_restaurants(t: Tables):
    rows = parse_menu_restaurants(_snapshot_texts(t))
    return rows.select(
        "snapshot_id",
        "restaurant",
        "hours",
        F.col("restaurant_ord").cast("long").alias("restaurant_ord"),
        F.col("item_count").cast("long").alias("item_count"),
        F.size("categories").cast("long").alias("category_count"),
        F.coalesce(F.size("open_ranges"), F.lit(0)).cast("long").alias("range_count"),
    )


def _documents(t: Tables):
    """One nested document per snapshot, whose size SNAPSHOT_ITEMS bounds; restaurants in parts."""
    nested = M.nest_menu(_with_hours(t), ["snapshot_id", "restaurant", "hours"], block=BLOCK)
    document = F.struct("place", "part", "first_part", F.col("restaurant").alias("name"), "hours", "categories")
    return nested.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(document)).alias("restaurants"))


def _plain_documents(t: Tables):
    """The same in whole restaurants and without places."""
    nested = M.nest_menu(_with_hours(t), ["snapshot_id", "restaurant", "hours"], block=2**40)
    plain = lambda c: F.struct(c["name"], F.transform(c["meals"], lambda m: m.dropFields("place")).alias("meals"))
    document = F.struct("place", F.col("restaurant").alias("name"), "hours", F.transform("categories", plain).alias("categories"))
    listed = nested.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(document)).alias("restaurants"))
    return listed.withColumn("restaurants", F.transform("restaurants", lambda r: r.dropFields("place")))


@query(f"""WITH {ROUND_TRIP}
SELECT snapshot_id, restaurant, hours, category, meal, is_halal, r - 1 AS restaurant_ord, c - 1 AS category_ord,
       (r - 1) * {2**42} + (c - 1) * {2**21} + i - 1 AS item_ord FROM placed""")
def menu_json_roundtrip(t: Tables):
    text = _plain_documents(t).select("snapshot_id", F.to_json(F.struct("restaurants")).alias("value"))
    read = text.select("snapshot_id", F.from_json("value", DOCUMENT).alias("_d")).select("snapshot_id", "_d.restaurants")
    return flatten_documents(read, ["snapshot_id"]).drop("nutrition")


@query(f"""WITH {ROUND_TRIP}
SELECT snapshot_id, restaurant, hours, min(rest_first) AS ord, count(*) AS total_items, count(*) FILTER (WHERE is_halal) AS halal_items,
       max(c) + CASE WHEN length(restaurant) % 2 = 0 THEN 1 ELSE 0 END AS categories_count
FROM placed GROUP BY snapshot_id, restaurant, hours""")
def restaurant_index_documents(t: Tables):
    # Restaurants with a name of even length also list a category without meals.
    def more(r):
        place = F.lit(None).cast("long").alias("place")
        empty = F.struct(F.lit("Empty").alias("name"), place, F.slice(r["categories"][0]["meals"], 1, 0).alias("meals"))
        added = F.when(r["first_part"] & (F.length(r["name"]) % 2 == 0), F.concat(r["categories"], F.array(empty)))
        return r.withField("categories", F.coalesce(added, r["categories"]))

    documents = _documents(t).withColumn("restaurants", F.transform("restaurants", more))
    index = stats.restaurant_index_documents(documents, ["snapshot_id"])
    return index.drop("safe_name", "filename")


@query(f"WITH {MENU_SNAPSHOTS} SELECT snapshot_id, count(DISTINCT restaurant) AS total_restaurants FROM snapshots GROUP BY snapshot_id")
def listed_restaurants(t: Tables):
    return stats.listed_restaurants(_documents(t), ["snapshot_id"])


@query(f"""WITH {MENU}, {HOURS}, cats AS (SELECT restaurant, category, min(item_ord) AS c, max(item_ord) AS last FROM menu GROUP BY ALL),
rests AS (SELECT restaurant, min(c) AS r, max(last) AS last FROM cats GROUP BY restaurant)
SELECT r AS restaurant_ord, CAST(-1 AS BIGINT) AS category_ord, CAST(-1 AS BIGINT) AS line_ord,
       restaurant || ' - ' || coalesce(h.hours, '{HOURS_MISSING}') AS line FROM rests LEFT JOIN hours_last h ON h.name = restaurant
UNION ALL SELECT r, c, -1, '  ' || category || ':' FROM cats JOIN rests USING (restaurant)
UNION ALL SELECT r, c, item_ord, '    - ' || meal FROM menu JOIN cats USING (restaurant, category) JOIN rests USING (restaurant)
UNION ALL SELECT r, {2**62}, 0, '' FROM rests""")
def menu_report_lines(t: Tables):
    return M.menu_report_lines(menu(t), _hours(t))


@query(f"""WITH {MENU}, {HOURS}
SELECT restaurant, coalesce(h.hours, '{HOURS_MISSING}') AS hours, category, meal, item_ord,
       CASE WHEN is_halal THEN 'lightgreen' ELSE 'salmon' END AS colour
FROM menu LEFT JOIN hours_last h ON h.name = menu.restaurant""")
def menu_report_rows(t: Tables):
    rows = M.menu_report_rows(M.attach_hours(menu(t), _hours(t)))
    return rows.select("restaurant", "hours", "category", "meal", "item_ord", "colour")


# Lines of every document, written as menu lines of changing kinds.
LINES = r"""lines AS (
  SELECT doc_id, pos, CASE (doc_id + pos) % 4 WHEN 0 THEN line WHEN 1 THEN '  ' || line || ':' WHEN 2 THEN '    - ' || line ELSE '  ' END AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents))"""


@query(rf"""WITH {LINES}
SELECT doc_id, pos, CASE WHEN trim(line, ' ' || chr(9)) = '' THEN 'blank' WHEN line NOT LIKE ' %' THEN 'restaurant'
  WHEN regexp_full_match(line, '  [^ \t].*:') THEN 'category' WHEN trim(line, ' ' || chr(9)) LIKE '- %' THEN 'item' ELSE 'other' END AS kind
FROM lines""")
def classify_menu_lines(t: Tables):
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    pos = F.col("n").cast("long")
    kind = (F.col("doc_id") + pos) % 4
    line = (
        F.when(kind == 0, F.col("line"))
        .when(kind == 1, F.concat(F.lit("  "), "line", F.lit(":")))
        .when(kind == 2, F.concat(F.lit("    - "), "line"))
        .otherwise("  ")
    )
    return rows.select("doc_id", pos.alias("pos"), classify_menu_line(line).alias("kind"))
