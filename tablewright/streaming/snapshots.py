"""Streams over folders where new snapshot files arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..fixed_values import NAME_MISSING
from ..operators.calendar import parse_events
from ..operators.ordering import last_wins
from ..sources.menus import DOCUMENT, flatten_documents, parse_menu_restaurants, parse_menu_text, read_snapshot_texts
from .current import BUCKETS, CurrentTable


def stream_menu_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Menu rows of arriving text files: the batch parser, which needs no state."""
    return parse_menu_text(read_snapshot_texts(spark, path, stream=True))


def stream_menu_restaurants(spark: SparkSession, path: str) -> DataFrame:
    """Restaurant rows, categories nested, of arriving text files."""
    return parse_menu_restaurants(read_snapshot_texts(spark, path, stream=True))


def stream_menu_documents(spark: SparkSession, path: str) -> DataFrame:
    """Menu rows of arriving JSON documents."""
    raw = spark.readStream.schema(DOCUMENT).option("multiLine", True).json(path)
    return flatten_documents(raw.withColumn("snapshot_id", F.col("_metadata.file_path")), ["snapshot_id"])


def stream_calendars(spark: SparkSession, path: str, dialect: str = "strict") -> DataFrame:
    """Events of arriving calendar files."""
    texts = read_snapshot_texts(spark, path, stream=True)
    return parse_events(texts, ["snapshot_id", "snapshot_ts"], dialect=dialect)


def latest_snapshot(
    rows: DataFrame, keys: Sequence[str], payload: Sequence[str], order: Column | None = None
) -> DataFrame:
    """Newest row per key; works on a batch and, as keyed state, on a stream.

    Keys that a failed or empty fetch leaves out keep their last good row. On a stream use the
    update or complete output mode; the state holds one row per key.
    """
    newest = F.struct("snapshot_ts", "snapshot_id") if order is None else order
    return last_wins(rows, keys, newest, payload)


def stream_latest_menus(spark: SparkSession, path: str) -> DataFrame:
    """Newest section of each restaurant over all files seen so far."""
    rows = stream_menu_restaurants(spark, path)
    payload = ["snapshot_id", "snapshot_ts", "hours", "open_ranges", "categories", "item_count"]
    return latest_snapshot(rows, ["restaurant"], payload)


def stream_latest_documents(spark: SparkSession, path: str) -> DataFrame:
    """Newest document of each restaurant, its categories nested, over all JSON files seen so far.

    A restaurant that is listed without a meal keeps its last good document."""
    raw = spark.readStream.schema(DOCUMENT).option("multiLine", True).json(path)
    listed = raw.select(
        F.col("_metadata.file_path").alias("snapshot_id"),
        F.col("_metadata.file_modification_time").alias("snapshot_ts"),
        F.posexplode("restaurants").alias("restaurant_ord", "_r"),
    )
    rows = listed.select(
        "snapshot_id", "snapshot_ts", "restaurant_ord", F.coalesce("_r.name", F.lit(NAME_MISSING)).alias("restaurant"), "_r.hours", "_r.categories"
    )
    good = rows.where(F.exists("categories", lambda c: F.size(c["meals"]) > 0))
    order = F.struct("snapshot_ts", "snapshot_id", "restaurant_ord")
    return latest_snapshot(good, ["restaurant"], ["snapshot_id", "snapshot_ts", "hours", "categories"], order)


def stream_latest_events(spark: SparkSession, path: str) -> DataFrame:
    """Newest state of each event (by its id) over all calendar files seen so far."""
    events = stream_calendars(spark, path)
    payload = [c for c in events.columns if c != "id"]
    return latest_snapshot(events, ["id"], payload, F.struct("snapshot_ts", "snapshot_id", "ord"))


def write_latest(
    latest: DataFrame, path: str, checkpoint: str, keys: Sequence[str], trigger: dict | None = None, buckets: int = BUCKETS
) -> StreamingQuery:
    """Keep the newest row of every key in a current table under ``path``.

    A micro-batch adds its changed rows to the buckets of their keys and nothing else (see
    ``CurrentTable``); readers see it once it is complete, and a batch that is run again after a
    failure replaces its own rows.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        CurrentTable(batch.sparkSession, path, keys, buckets=buckets).merge(batch_id, batch)

    writer = latest.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The current table: the last complete version, and nothing older."""
    return CurrentTable(spark, path).read()
