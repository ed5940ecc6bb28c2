"""Menu search and filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hours import is_open, is_open_bits, is_open_for, minute_bits, now_minutes_local, parse_hours
from ..functions.text import contains_ci, trim_ws
from ..fixed_values import ZONE
from .joins import join_lookup


def filter_restaurant(items: DataFrame, restaurant: str | None) -> DataFrame:
    return items if restaurant is None else items.where(F.col("restaurant") == restaurant)


def open_at(restaurants: DataFrame, instant: Column | str, zone: str = ZONE) -> DataFrame:
    """Add ``is_open`` at an instant from the ``hours`` text; null where hours cannot be read."""
    ranges = parse_hours("hours")
    return restaurants.withColumn("is_open", is_open(ranges, now_minutes_local(instant, zone)))


def open_at_join(visits: DataFrame, hours: DataFrame, key: str, instant: str, zone: str = ZONE) -> DataFrame:
    """Add ``is_open`` for each visit by its restaurant's ranges.

    An equality join with one ranges array per restaurant and a test inside the row: no
    range pairs are produced and no visit is multiplied.
    """
    ranges = hours.select(F.col("restaurant").alias(key), parse_hours("hours").alias("_ranges"))
    joined = join_lookup(visits, ranges, [key])
    opened = is_open("_ranges", now_minutes_local(instant, zone))
    return joined.withColumn("is_open", opened).drop("_ranges")


def open_for_join(visits: DataFrame, hours: DataFrame, key: str, instant: str, minutes: int, zone: str = ZONE) -> DataFrame:
    """Add ``is_open`` and ``is_open_for`` (open for all of the next ``minutes``) for each visit.

    A restaurant's day is 23 longs of minute bits, made once for each name, so a test is a shift and a mask
    (or 23 of them) however many ranges the day has.
    """
    bits = hours.select(F.col("restaurant").alias(key), minute_bits(parse_hours("hours")).alias("_bits"))
    joined = join_lookup(visits, bits, [key])
    now = now_minutes_local(instant, zone)
    return joined.withColumns({"is_open": is_open_bits("_bits", now), "is_open_for": is_open_for("_bits", now, minutes)}).drop("_bits")


def filter_open_now(rows: DataFrame) -> DataFrame:
    """Rows known to be open; unknown ones are left out."""
    return rows.where(F.col("is_open").eqNullSafe(True))


def search_menu(items: DataFrame, query: str = "", columns: tuple[str, ...] = ("meal", "category", "restaurant")) -> DataFrame:
    """Rows where any column contains the query, ignoring case; a blank query keeps all."""
    if not query.strip():
        return items
    return items.where(reduce(lambda a, b: a | b, [contains_ci(c, query) for c in columns]))


def _grams(text: Column, length: int) -> Column:
    """Distinct runs of ``length`` characters of a text."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - length + 1))
    return F.when(F.length(text) >= length, F.array_distinct(F.transform(starts, lambda n: F.substr(text, n, F.lit(length))))).otherwise(F.array().cast("array<string>"))


GRAM = 3


def search_many(
    items: DataFrame, queries: DataFrame, columns: Sequence[str] = ("meal", "category", "restaurant"), query: str = "query", id: str = "query_id"
) -> DataFrame:
    """``query_id`` and the items that each query finds as ``search_menu`` would, for a table of queries.

    Every distinct text of the columns posts its runs of three characters (for shorter queries of one or
    two), but only those that some query needs: a query is looked up by its rarest run. Texts that hold
    it are checked in full, and the texts found are joined back to the items. So a query costs what its
    rarest run brings, items and queries meet by equal keys only, and a repeated text is searched once.
    A query that is blank or null asks for nothing here: all items are no search result.
    """
    asked = queries.select(F.col(id).alias("_q"), F.lower(trim_ws(query)).alias("_text")).where("_text <> ''")
    texts = reduce(DataFrame.unionByName, [items.select(F.lower(c).alias("_value")) for c in columns]).where("_value IS NOT NULL").distinct()
    wanted = asked.withColumn("_size", F.least(F.lit(GRAM), F.length("_text")))
    own = [F.when(F.col("_size") == n, _grams(F.col("_text"), n)) for n in range(1, GRAM + 1)]
    needed = wanted.select("_q", "_text", F.explode(F.coalesce(*own)).alias("_gram"))
    posted = texts.select("_value", F.explode(F.concat(*[_grams(F.col("_value"), n) for n in range(1, GRAM + 1)])).alias("_gram"))
    posted = posted.join(needed.select("_gram").distinct(), "_gram", "left_semi")
    often = posted.groupBy("_gram").agg(F.count("*").alias("_n"))
    # A run that no text holds is the rarest of all: the query finds nothing.
    rarity = F.struct(F.coalesce("_n", F.lit(0)), "_gram")
    rarest = needed.join(often, "_gram", "left").groupBy("_q", "_text").agg(F.min_by("_gram", rarity).alias("_gram"))
    found = rarest.join(posted, "_gram").where(F.contains("_value", F.col("_text"))).select("_q", "_value")
    by_text = found.groupBy("_value").agg(F.collect_set("_q").alias("_found"))
    hit = items
    for n, column in enumerate(columns):
        side = by_text.select(F.col("_value").alias(f"_value{n}"), F.col("_found").alias(f"_found{n}"))
        hit = hit.withColumn(f"_value{n}", F.lower(column)).join(side, f"_value{n}", "left")
    none = F.array().cast(by_text.schema["_found"].dataType)
    united = reduce(F.array_union, [F.coalesce(f"_found{n}", none) for n in range(len(columns))])
    return hit.select(F.explode(united).alias(id), *items.columns)


def recount_after_filter(items: DataFrame) -> DataFrame:
    """Item counts of what a search left; restaurants without items have no row."""
    return items.groupBy("restaurant").agg(F.count("*").alias("item_count"))
