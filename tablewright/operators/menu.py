"""Flat menu rows: filters, merging, nesting and report rows.

A menu row has ``restaurant, category, meal, is_halal`` and ordinals ``restaurant_ord``,
``category_ord``, ``item_ord``; several snapshots are told apart by ``snapshot_id``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import FLAG_COLOURS, FLAG_WORD, HOURS_MISSING, NO_ITEMS, UNCATEGORIZED
from ..functions.hours import fix_hours_separators
from ..functions.text import col, normalize_key, trim_ws
from .joins import join_lookup
from .ordering import carry_forward, dedup_first_seen, last_wins


# --- predicates ---------------------------------------------------------------------------

def flag_from_alts(alts: Column | str, word: str = FLAG_WORD) -> Column:
    """True when any image text contains the word; null texts and arrays count as false."""
    hit = F.exists(col(alts), lambda a: F.coalesce(F.contains(F.lower(trim_ws(a)), F.lit(word)), F.lit(False)))
    return F.coalesce(hit, F.lit(False))


def halal_only(items: DataFrame) -> DataFrame:
    return items.where("is_halal")


def open_units_only(units: DataFrame, status: str = "status", skip_closed: bool = True) -> DataFrame:
    return units.where(F.contains(F.lower(status), F.lit("open"))) if skip_closed else units


def drop_empty_panels(panels: DataFrame, text: str = "text") -> DataFrame:
    return panels.where(~F.contains(F.col(text), F.lit(NO_ITEMS)))


def nonempty_categories(items: DataFrame, meal: str = "meal") -> DataFrame:
    """Rows that hold a meal; a category without one has no row left."""
    return items.where(F.col(meal).isNotNull())


def any_meals(items: DataFrame, keys: Sequence[str] = ("restaurant",), meal: str = "meal") -> DataFrame:
    return items.groupBy(*keys).agg(F.bool_or(F.col(meal).isNotNull()).alias("has_meals"))


def nonempty_restaurants(items: DataFrame, keys: Sequence[str] = ("restaurant",), meal: str = "meal") -> DataFrame:
    """Rows, empty categories included, of restaurants with at least one meal."""
    kept = any_meals(items, keys, meal).where("has_meals").select(*keys)
    return join_lookup(items, kept, keys, "left_semi")


# --- rows of menu pages -------------------------------------------------------------------

def items_from_menu_rows(rows: DataFrame, page: str = "page_id", auto_loaded: Column | None = None) -> DataFrame:
    """Item rows with the category above them.

    Items before any category are "Uncategorized" on pages loaded directly (``auto_loaded``)
    and are left out on the others; so are items under a header without text.
    """
    single = F.lit(False) if auto_loaded is None else auto_loaded
    fallback = F.when(single, F.lit(UNCATEGORIZED))
    header = F.coalesce(F.nullif(F.col("text"), F.lit("")), fallback)
    carried = carry_forward(rows, [page], "pos", [("category", F.col("is_header"), header)])
    items = carried.where("NOT is_header").withColumn("category", F.coalesce("category", fallback))
    return carried_category_required(items)


def carried_category_required(items: DataFrame) -> DataFrame:
    return items.where(F.col("category").isNotNull())


def page_order(menu_ord: Column | str, pos: Column | str) -> Column:
    """One ordinal for (menu, position on its page)."""
    return F.shiftleft(col(menu_ord).cast("long"), 32) + col(pos)


def merge_menus(items: DataFrame, keys: Sequence[str] = ("restaurant", "category"), order: str = "item_ord") -> DataFrame:
    """Merge categories of one name over the menus of a restaurant, in visit order.

    Rows stay as they are; ``category_ord`` becomes the first ordinal of the merged category.
    """
    first = items.groupBy(*keys).agg(F.min(order).alias("category_ord"))
    return join_lookup(items.drop("category_ord"), first, keys)


def distinct_meals(items: DataFrame, keys: Sequence[str] = ("restaurant", "category", "meal"), order: str = "item_ord") -> DataFrame:
    return dedup_first_seen(items, keys, order)


# --- hours --------------------------------------------------------------------------------

def crosswalk_names(rows: DataFrame, crosswalk: DataFrame, name: str, out: str) -> DataFrame:
    """Map a name through the crosswalk; an unmapped name stays as it is."""
    pairs = crosswalk.select(F.col("source_name").alias("_source"), F.col("target_name").alias("_target"))
    joined = rows.join(pairs, F.col(name) == F.col("_source"), "left")
    return joined.withColumn(out, F.coalesce("_target", name)).drop("_source", "_target")


def hours_by_name(raw: DataFrame, crosswalk: DataFrame, order: str = "pos") -> DataFrame:
    """``restaurant, hours, pos`` of hours rows (``name, raw_hours``); the last row of a name wins."""
    named = crosswalk_names(raw, crosswalk, "name", "restaurant")
    fixed = named.withColumn("hours", fix_hours_separators("raw_hours"))
    return last_wins(fixed.withColumn("pos", F.col(order)), ["restaurant"], F.col(order), ["hours", "pos"])


def attach_hours(rows: DataFrame, hours: DataFrame, normalize: bool = False, missing: str = HOURS_MISSING) -> DataFrame:
    """Left join on the exact name, or on its normalized key; hours default to ``missing``.

    ``hours`` has one row per name, so the row count of ``rows`` is kept. Of names that share a
    normalized key the last one by ``pos`` wins (where ``hours`` has no ``pos``, the greatest name).
    """
    key = normalize_key if normalize else F.col
    last = F.col("pos") if "pos" in hours.columns else F.col("restaurant")
    side = hours.select(key("restaurant").alias("_name"), F.col("hours").alias("_hours"), last.alias("_last"))
    if normalize:
        side = last_wins(side, ["_name"], F.col("_last"), ["_hours"])
    named = rows.drop("hours").withColumn("_name", key("restaurant"))
    joined = join_lookup(named, side.drop("_last"), ["_name"])
    return joined.withColumn("hours", F.coalesce("_hours", F.lit(missing))).drop("_name", "_hours")


# --- nesting and reports ------------------------------------------------------------------

def nest_menu(items: DataFrame, keys: Sequence[str] = ("restaurant",), order: str = "item_ord", block: int = 10_000) -> DataFrame:
    """Nest meals in categories in restaurants, in first-seen order.

    ``order`` is unique in a restaurant. A row holds the meals of one block of ordinals, so it
    never has more than ``block`` of them; a larger restaurant goes on in the row of the next
    ``part``. Each row carries the places it has in the whole: ``place`` of the restaurant and of
    each category is its first ordinal over all parts, that of a meal its own; ``first_part``
    marks the part a restaurant begins in. So what is read back does not depend on ``block``.
    """
    part = F.expr(f"`{order}` div {block}").alias("part")
    fields = [F.col("meal").alias("name"), "is_halal", F.col(order).cast("long").alias("place")]
    fields += ["nutrition"] if "nutrition" in items.columns else []
    # Maps cannot be compared, so meals are ordered by their place alone.
    by_place = lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0)
    meals = items.groupBy(*keys, "category", part).agg(F.collect_list(F.struct(*fields)).alias("_meals"))
    first = items.groupBy(*keys, "category").agg(F.min(order).cast("long").alias("_first"))
    placed = join_lookup(meals, first, [*keys, "category"], null_safe=True)
    category = F.struct(F.col("category").alias("name"), F.col("_first").alias("place"), F.array_sort("_meals", by_place).alias("meals"))
    nested = placed.groupBy(*keys, "part").agg(F.collect_list(category).alias("_c"))
    whole = first.groupBy(*keys).agg(F.min("_first").alias("place"))
    nested = join_lookup(nested, whole, keys, null_safe=True)
    begins = (F.expr(f"place div {block}") == F.col("part")).alias("first_part")
    return nested.select(*keys, "part", begins, "place", F.array_sort("_c", by_place).alias("categories"))


def menu_report_lines(
    items: DataFrame, hours: DataFrame | None = None, order: str = "item_ord", snapshot: Sequence[str] = ()
) -> DataFrame:
    """Lines of the text report with the columns that order them.

    ``restaurant_ord, category_ord, line_ord, line``: a restaurant line, category lines,
    item lines and a blank line at the end of each restaurant. Header lines come from the
    grouped names and item lines straight from the rows; nothing is gathered per restaurant.
    """
    scope = list(snapshot)
    per_category = items.groupBy(*scope, "restaurant", "category").agg(F.min(order).alias("category_ord"))
    first = per_category.groupBy(*scope, "restaurant").agg(F.min("category_ord").alias("restaurant_ord"))
    names = join_lookup(per_category, first, [*scope, "restaurant"])
    titled = first if hours is None else attach_hours(first, hours)
    title = F.col("restaurant") if hours is None else F.concat_ws(" - ", "restaurant", "hours")

    def lines(part: DataFrame, line: Column, category_ord: Column, line_ord: Column) -> DataFrame:
        ords = [category_ord.cast("long").alias("category_ord"), line_ord.cast("long").alias("line_ord")]
        return part.select(*scope, "restaurant_ord", *ords, line.alias("line"))

    before = F.lit(-1)
    named = F.col("category_ord")
    plain = items.drop("category_ord", "restaurant_ord")
    meals = join_lookup(plain, names, [*scope, "restaurant", "category"])
    parts = [
        lines(titled, title, before, before),
        lines(names, F.format_string("  %s:", "category"), named, before),
        lines(meals, F.format_string("    - %s", "meal"), named, F.col(order)),
        lines(first, F.lit(""), F.lit(2**62), F.lit(0)),
    ]
    return reduce(DataFrame.unionByName, parts)


LINE_ORDER = ("restaurant_ord", "category_ord", "line_ord")


def menu_report_rows(items: DataFrame, colours: tuple[str, str] = FLAG_COLOURS) -> DataFrame:
    """Row set of the printed menu: a colour by flag, hours filled in."""
    colour = F.when(F.col("is_halal"), colours[0]).otherwise(colours[1])
    return items.withColumns({"colour": colour, "hours": F.coalesce("hours", F.lit(HOURS_MISSING))})
