"""Restaurant index, summary statistics and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import HOURS_MISSING, NAME_MISSING
from ..functions.text import slugify
from ..functions.times import round1
from .menu import attach_hours
from .ordering import top_k


def category_counts(items: DataFrame, keys: Sequence[str], order: str, weight: str | None = None) -> DataFrame:
    """Per (restaurant, category): rows, flagged rows, first ordinal. ``weight`` counts a row n times."""
    n = F.lit(1).cast("long") if weight is None else F.col(weight)
    flagged = F.when(F.coalesce("is_halal", F.lit(False)), n).otherwise(0)
    return items.groupBy(*keys, "category").agg(
        F.sum(n).alias("total_items"), F.sum(flagged).alias("halal_items"), F.min(order).alias("ord")
    )


def restaurant_index(
    items: DataFrame,
    hours: DataFrame | None = None,
    keys: Sequence[str] = ("restaurant",),
    order: str = "item_ord",
    weight: str | None = None,
) -> DataFrame:
    """One row per restaurant with totals, category count, hours and file names.

    Counted in two steps, first per category: both shuffles carry pre-aggregated rows only and
    counting distinct categories needs no expansion of the input.
    """
    totals = category_counts(items, keys, order, weight).groupBy(*keys).agg(
        F.sum("total_items").alias("total_items"),
        F.sum("halal_items").alias("halal_items"),
        F.count("*").alias("categories_count"),
        F.min("ord").alias("ord"),
    )
    named = totals.withColumn("safe_name", slugify("restaurant"))
    named = named.withColumn("filename", F.concat("safe_name", F.lit(".json")))
    return named if hours is None else attach_hours(named, hours)


def restaurant_index_documents(documents: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Index straight from nested documents: empty categories and restaurants count as listed.

    Counts are taken inside each restaurant's own value, without unnesting meals. A restaurant
    that goes on in further parts is one listing: its parts are added, and a category counts where
    it begins. A name listed again keeps its first place and its last values.
    """
    listed = documents.select(*keep, F.posexplode("restaurants").alias("_pos", "_r"))
    categories = F.coalesce("_r.categories", F.array())
    meals = lambda c: F.coalesce(c["meals"], F.array())
    flagged = lambda c: F.filter(meals(c), lambda m: F.coalesce(m["is_halal"], F.lit(False)))
    total = lambda size: F.aggregate(categories, F.lit(0).cast("long"), lambda n, c: n + F.size(size(c)))
    begun = lambda c: c["place"].isNull() | F.get(c["meals"], F.lit(0))["place"].eqNullSafe(c["place"])
    begins = F.filter(categories, begun) if _has_places(documents) else categories
    counted = listed.select(
        *keep,
        (F.coalesce("_r.place", "_pos") if _has_places(documents) else F.col("_pos")).cast("long").alias("ord"),
        F.coalesce("_r.name", F.lit(NAME_MISSING)).alias("restaurant"),
        F.coalesce("_r.hours", F.lit(HOURS_MISSING)).alias("hours"),
        total(meals).alias("total_items"),
        total(flagged).alias("halal_items"),
        F.size(begins).cast("long").alias("categories_count"),
    )
    sums = [F.sum(n).alias(n) for n in ("total_items", "halal_items", "categories_count")]
    listings = counted.groupBy(*keep, "restaurant", "ord").agg(F.max("hours").alias("hours"), *sums)
    values = F.struct("hours", "total_items", "halal_items", "categories_count")
    index = listings.groupBy(*keep, "restaurant").agg(F.min("ord").alias("ord"), F.max_by(values, "ord").alias("_v"))
    named = index.select(*keep, "restaurant", "ord", "_v.*").withColumn("safe_name", slugify("restaurant"))
    return named.withColumn("filename", F.concat("safe_name", F.lit(".json")))


def _has_places(documents: DataFrame) -> bool:
    return "place" in documents.schema["restaurants"].dataType.elementType.names


def listed_restaurants(documents: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Restaurants as listed, repeated names included; further parts are not listed again."""
    shown = F.col("restaurants")
    if _has_places(documents):
        shown = F.filter(shown, lambda r: F.coalesce(r["first_part"], F.lit(True)))
    return documents.groupBy(*keep).agg(F.sum(F.size(shown)).alias("total_restaurants"))


def index_totals(index: DataFrame) -> DataFrame:
    return index.agg(F.sum("total_items").alias("total_items"), F.sum("halal_items").alias("halal_items"))


def summary_stats(index: DataFrame) -> DataFrame:
    """One row; the average is null for an empty index."""
    totals = index.agg(
        F.count("*").alias("total_restaurants"),
        F.coalesce(F.sum("total_items"), F.lit(0)).alias("total_items"),
        F.coalesce(F.sum("halal_items"), F.lit(0)).alias("total_halal_items"),
        F.count_if(F.col("halal_items") > 0).alias("restaurants_with_halal"),
    )
    mean = F.try_divide("total_items", "total_restaurants")
    return totals.withColumn("average_items_per_restaurant", round1(mean))


def _ranking(index: DataFrame, value: str, k: int) -> DataFrame:
    return top_k(index, value, "ord", k).select("rank", "restaurant", F.col(value).alias("value"))


def top10_items(index: DataFrame, k: int = 10) -> DataFrame:
    return _ranking(index, "total_items", k)


def top10_halal(index: DataFrame, k: int = 10) -> DataFrame:
    return _ranking(index, "halal_items", k)


def top10_categories(index: DataFrame, k: int = 10) -> DataFrame:
    return _ranking(index, "categories_count", k)


def menu_counts(items: DataFrame, keys: Sequence[str] = ("restaurant",), order: str = "item_ord") -> DataFrame:
    """Items per restaurant with its first ordinal."""
    return items.groupBy(*keys).agg(F.count("*").alias("item_count"), F.min(order).alias("ord"))


def menu_totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count("*").alias("restaurants"), F.coalesce(F.sum("item_count"), F.lit(0)).alias("total_items"))


def top4_restaurants(counts: DataFrame, k: int = 4) -> DataFrame:
    return top_k(counts, "item_count", "ord", k)
