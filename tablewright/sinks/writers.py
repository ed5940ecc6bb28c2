"""Distributed writers. Each writes a folder of part files whose order is the row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import HOURS_MISSING
from ..operators.menu import LINE_ORDER, nest_menu
from ..operators.stats import summary_stats, top10_categories, top10_halal, top10_items


def write_menu_json(
    items: DataFrame,
    path: str,
    timestamp: Column,
    keys: Sequence[str] = ("restaurant", "hours"),
    order: str = "item_ord",
    block: int = 10_000,
) -> None:
    """Nested documents ``timestamp, restaurants`` in first-seen order, one per line.

    A line holds one restaurant, or one block of it with its places in the whole, so no line grows
    with the data. Read them back with ``read_menu_json(..., multi_line=False)``.
    """
    nested = nest_menu(items, keys, order, block)
    hours = F.coalesce("hours", F.lit(HOURS_MISSING)) if "hours" in keys else F.lit(HOURS_MISSING)
    restaurant = F.struct(F.col("restaurant").alias("name"), hours.alias("hours"), "categories", "part", "first_part", "place")
    documents = nested.select("place", "part", timestamp.alias("timestamp"), F.array(restaurant).alias("restaurants"))
    documents.orderBy("place", "part").drop("place", "part").write.mode("overwrite").json(path)


def write_restaurant_parts(items: DataFrame, index: DataFrame, path: str, created_at: Column, block: int = 10_000) -> None:
    """Documents per restaurant under ``safe_name=...`` folders, with totals from the index.

    Of several names with one slug the last in index order is kept.
    """
    last = index.groupBy("safe_name").agg(F.max("ord").alias("ord"))
    kept = index.join(last, ["safe_name", "ord"], "left_semi")
    totals = kept.select("restaurant", "safe_name", "hours", "total_items", "halal_items")
    documents = nest_menu(items, block=block).join(totals, ["restaurant"])
    documents = documents.withColumnRenamed("restaurant", "name").withColumn("created_at", created_at)
    # Spread by folder and part: a folder with many parts is written by many tasks.
    spread = documents.repartition("safe_name", "part")
    spread.write.mode("overwrite").partitionBy("safe_name").json(path)


def write_index(index: DataFrame, path: str, created_at: Column) -> None:
    index.withColumn("created_at", created_at).orderBy("ord").write.mode("overwrite").json(path)


def write_summary(index: DataFrame, path: str) -> None:
    """The summary row and the three rankings, in four folders."""
    tables = {
        "summary": summary_stats(index),
        "top_restaurants_by_items": top10_items(index),
        "top_restaurants_by_halal": top10_halal(index),
        "restaurants_by_category_count": top10_categories(index),
    }
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")


def write_menu_text(lines: DataFrame, path: str, snapshot: Sequence[str] = ()) -> None:
    """Report lines in order: a range sort, so any number of tasks write consecutive parts."""
    ordered = lines.orderBy(*snapshot, *LINE_ORDER)
    if snapshot:
        ordered.select(*snapshot, F.col("line").alias("value")).write.mode("overwrite").partitionBy(*snapshot).text(path)
    else:
        ordered.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def write_nutrition_lookup(by_restaurant: DataFrame, by_item: DataFrame, path: str) -> None:
    by_restaurant.write.mode("overwrite").parquet(f"{path}/by_restaurant")
    by_item.write.mode("overwrite").parquet(f"{path}/by_item")


def write_ics_feed(calendars: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """One text record per calendar; the text already ends with its own line end."""
    writer = calendars.select(*keys, "value").write.mode("overwrite").option("lineSep", "\n")
    (writer.partitionBy(*keys) if keys else writer).text(path)
