"""Index and statistics kept up to date while snapshots arrive.

The newest section of a restaurant counts, wherever it came from. When a newer one arrives, its counts
come in with a plus and those of the section it replaces go out with a minus, so a batch costs in
proportion to the sections in it (and those they replace), not to what is already counted. All tables
are current tables in buckets (``current``); a batch reads and writes only the buckets of its keys, and a
batch that is run again starts from the versions before it.

A restaurant's section in a snapshot is whole in one batch, as it is when snapshots are files. A
section that is older than the one counted changes nothing; one of the same snapshot replaces it.
Restaurants that a snapshot leaves out keep their section.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import slugify
from ..functions.times import round1
from ..operators.stats import category_counts
from ..session import checkpoint_ready
from .current import BUCKETS, CurrentTable

COUNTS = ("total_items", "halal_items")
SUMMARY = ("total_restaurants", *COUNTS, "restaurants_with_halal")


class KeptIndex:
    """Sections, index, category totals and summary under ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark = spark
        self.sections = CurrentTable(spark, f"{path}/sections", ["restaurant", "category"], ["restaurant"], "total_items > 0", buckets)
        self.index = CurrentTable(spark, f"{path}/index", ["restaurant"], buckets=buckets)
        self.categories = CurrentTable(spark, f"{path}/categories", ["category"], live="total_items > 0", buckets=buckets)
        self.summary = CurrentTable(spark, f"{path}/summary", ["name"], buckets=1)

    def add(self, items: DataFrame, number: int) -> None:
        """Count the item rows of batch ``number``: ``restaurant, category, is_halal, item_ord, snapshot_ts, snapshot_id``."""
        checkpoint_ready(self.spark)
        stamped = items.withColumn("stamp", F.struct("snapshot_ts", "snapshot_id"))
        counted = category_counts(stamped, ["restaurant", "stamp"], "item_ord").checkpoint()
        newest = counted.groupBy("restaurant").agg(F.max("stamp").alias("stamp"))
        old = self.sections.read(number, self.sections.touched(newest))
        if old is None:
            old = counted.limit(0).select("restaurant", "category", *COUNTS, "ord", "stamp")
        # Sections of the batch that are not older than what is counted.
        held = old.groupBy("restaurant").agg(F.max("stamp").alias("_held"))
        newer = _joined(newest, held, ["restaurant"], "left").where("_held IS NULL OR stamp >= _held").select("restaurant", "stamp")
        new = _joined(counted, newer, ["restaurant", "stamp"], "inner")
        gone = _joined(old, newer.select("restaurant"), ["restaurant"], "inner")
        signed = new.withColumn("sign", F.lit(1)).unionByName(gone.withColumn("sign", F.lit(-1))).checkpoint()

        plus = F.col("sign") > 0
        sums = [F.sum(F.col("sign") * F.col(c)).alias(c) for c in COUNTS]
        ones = [F.coalesce(F.sum(F.when(plus, F.col(c))), F.lit(0)).alias(c) for c in COUNTS]
        first = F.min(F.when(plus, F.col("ord"))).alias("ord")
        # A category that the new section no longer has gets a row of zero items, which is not live.
        rows = signed.groupBy("restaurant", "category").agg(*ones, first, F.max(F.when(plus, F.col("stamp"))).alias("stamp"))
        self.sections.merge(number, rows)

        by_restaurant = signed.groupBy("restaurant").agg(
            *sums, F.sum("sign").alias("categories_count"), first,
            F.sum(F.when(~plus, F.col("halal_items")).otherwise(0)).alias("_old_halal"), F.count_if(~plus).alias("_old"), F.count_if(plus).alias("_new"),
        ).checkpoint()
        changed = by_restaurant.select("restaurant", *COUNTS, "categories_count", "ord")
        self.index.merge(number, self._added(self.index, number, changed, ["restaurant"], [*COUNTS, "categories_count"], ["ord"]))

        by_category = signed.groupBy("category").agg(*sums, F.sum("sign").alias("restaurants")).checkpoint()
        self.categories.merge(number, self._added(self.categories, number, by_category, ["category"], [*COUNTS, "restaurants"]))

        shown = lambda test: test.cast("long")
        change = by_restaurant.agg(
            F.coalesce(F.sum(shown(F.col("_new") > 0) - shown(F.col("_old") > 0)), F.lit(0)).alias("total_restaurants"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS],
            F.coalesce(F.sum(shown(F.col("_old_halal") + F.col("halal_items") > 0) - shown(F.col("_old_halal") > 0)), F.lit(0)).alias("restaurants_with_halal"),
        )
        change = change.withColumn("name", F.lit("all")).checkpoint()
        self.summary.merge(number, self._added(self.summary, number, change, ["name"], list(SUMMARY)))

    def _added(self, table: CurrentTable, number: int, change: DataFrame, keys: list[str], sums: list[str], replaced: list[str] = []) -> DataFrame:
        """The changed rows of a table: its sums plus those of ``change``."""
        before = table.read(number, table.touched(change))
        if before is None:
            return change.select(*keys, *sums, *replaced)
        old = before.select(*keys, *[F.col(c).alias(f"_{c}") for c in sums])
        both = _joined(change, old, keys, "left")
        return both.select(*keys, *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums], *replaced)

    # --- results ----------------------------------------------------------------------------

    def restaurant_index(self) -> DataFrame:
        """As ``stats.restaurant_index`` of the newest sections."""
        named = self.index.read().withColumn("safe_name", slugify("restaurant"))
        return named.withColumn("filename", F.concat("safe_name", F.lit(".json")))

    def summary_stats(self) -> DataFrame:
        """As ``stats.summary_stats`` of the index, from sums that were kept."""
        row = self.summary.read().withColumnRenamed("halal_items", "total_halal_items").drop("name")
        mean = F.try_divide("total_items", "total_restaurants")
        return row.withColumn("average_items_per_restaurant", round1(mean))

    def category_totals(self) -> DataFrame:
        """Items, flagged items and restaurants of each category over the newest sections."""
        return self.categories.read()


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join in which null keys meet."""
    side = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    return left.join(side, [left[k].eqNullSafe(side[f"_right_{k}"]) for k in keys], how).drop(*[f"_right_{k}" for k in keys])


def keep_index(items: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the tables under ``path`` up to date with a stream of item rows (see ``KeptIndex.add``)."""

    def save(batch: DataFrame, number: int) -> None:
        KeptIndex(batch.sparkSession, path, buckets).add(batch, number)

    writer = items.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
