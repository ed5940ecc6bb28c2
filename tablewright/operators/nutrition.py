"""Nutrition lookup: build it, resolve menu items to keys, and read facts by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lookup_key, normalize_key, split_lookup_key
from .joins import join_lookup

INFO = ("item", "restaurant", "category", "serving_size", "calories", "facts", "secondary", "ingredients")


def halal_with_nutrition(items: DataFrame) -> DataFrame:
    return items.where("is_halal AND nutrition IS NOT NULL")


def attach_labels(items: DataFrame, labels: DataFrame, on: Sequence[str] = ("link_id",)) -> DataFrame:
    """Items with the ``nutrition`` of the label their link opens, null without one.

    ``labels`` has one row per link, so the row count of ``items`` is kept.
    """
    return join_lookup(items, labels.select(*on, "nutrition"), on)


def compact_nutrition(items: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The facts shown for an item, with empty maps for missing ones, and both lookup keys."""
    facts = items.schema["nutrition"].dataType["nutrition_facts"].dataType
    empty = F.create_map().cast(facts)
    return items.select(
        *keep,
        normalize_key("restaurant").alias("rest_key"),
        normalize_key("meal").alias("item_key"),
        F.coalesce(F.nullif("nutrition.item_name", F.lit("")), "meal").alias("item"),
        "restaurant",
        "category",
        F.col("nutrition.serving_info.serving_size").alias("serving_size"),
        F.col("nutrition.calories").alias("calories"),
        F.coalesce("nutrition.nutrition_facts", empty).alias("facts"),
        F.coalesce("nutrition.secondary_nutrients", empty).alias("secondary"),
        F.col("nutrition.ingredients").alias("ingredients"),
    )


def build_nutrition_lookup(items: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(by_restaurant, by_item): the last row of a restaurant's item, the first row of an item."""
    compact = compact_nutrition(halal_with_nutrition(items), order)
    met = F.struct(*order)
    # Only rows that can win reach the shuffle: each map task keeps one row per key.
    by_restaurant = compact.groupBy("rest_key", "item_key").agg(F.max_by(F.struct(*INFO), met).alias("info"))
    by_item = compact.groupBy("item_key").agg(F.min_by(F.struct(*INFO), met).alias("info"))
    return by_restaurant, by_item


def lookup_count(items: DataFrame) -> DataFrame:
    """Rows that passed the filter, counted before keys collapse."""
    return halal_with_nutrition(items).agg(F.count("*").alias("n"))


def nutrition_key(items: DataFrame, by_restaurant: DataFrame, by_item: DataFrame) -> DataFrame:
    """Add ``nutrition_key``: restaurant and item, else item alone, else null."""
    return _looked_up(items, by_restaurant, by_item, info=False)


def _looked_up(items: DataFrame, by_restaurant: DataFrame, by_item: DataFrame, info: bool) -> DataFrame:
    """Both lookups have unique keys, so the row count is kept. Facts come along in the same two
    joins. Lookups that were written with ``write_nutrition_lookup`` have a size Spark knows."""
    value = F.col("info") if info else F.lit(True)
    keyed = items.withColumns({"_rest": normalize_key("restaurant"), "_item": normalize_key("meal")})
    own = by_restaurant.select(F.col("rest_key").alias("_rest"), F.col("item_key").alias("_item"), value.alias("_own"))
    shared = by_item.select(F.col("item_key").alias("_item"), value.alias("_shared"))
    joined = join_lookup(join_lookup(keyed, own, ["_rest", "_item"]), shared, ["_item"])
    has_own, has_shared = F.col("_own").isNotNull(), F.col("_shared").isNotNull()
    key = F.when(has_own, lookup_key("_item", "_rest")).when(has_shared, lookup_key("_item")).alias("nutrition_key")
    return joined.select(*items.columns, key, *([F.coalesce("_own", "_shared").alias("info")] if info else []))


def distinct_keys(items: DataFrame) -> DataFrame:
    return items.where(F.col("nutrition_key").isNotNull()).select("nutrition_key").distinct()


def nutrition_by_key(keys: DataFrame, by_restaurant: DataFrame, by_item: DataFrame) -> DataFrame:
    """Facts of each key; keys without a slash or without facts are dropped."""
    rest, item = split_lookup_key("nutrition_key")
    split = keys.select("nutrition_key", rest.alias("rest_key"), item.alias("item_key"))
    table = by_restaurant.select("rest_key", "item_key", "info").unionByName(
        by_item.select(F.lit("*").alias("rest_key"), "item_key", "info")
    )
    return split.join(table, ["rest_key", "item_key"]).select("nutrition_key", "info")


def item_info(items: DataFrame, by_restaurant: DataFrame, by_item: DataFrame) -> DataFrame:
    """Menu items with the facts of their key (own before shared), null without one."""
    return _looked_up(items, by_restaurant, by_item, info=True)


def secondary_not_in_main(secondary: DataFrame, main: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Secondary rows whose name the main facts of the same label do not have.

    The main side is reduced to distinct keys first, so a hot key costs one row there.
    """
    return join_lookup(secondary, main.select(*keys).distinct(), keys, "left_anti")


def fact_rows(items: DataFrame, keep: Sequence[str], facts: Column | str = "facts") -> DataFrame:
    """Ordered (name, amount, unit, daily value) rows of a facts map; empty maps keep a row."""
    entries = items.select(*keep, F.posexplode_outer(F.map_entries(facts)).alias("pos", "_e"))
    return entries.select(*keep, "pos", F.col("_e.key").alias("name"), "_e.value.*")
