"""Menu snapshots: text reports and nested JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import HOURS_MISSING, NAME_MISSING
from ..functions.hours import parse_hours
from ..functions.text import BLANK_CLASS, EOL_CLASS, category_name, classify_menu_line, col, item_name, split_name_hours

_JS = BLANK_CLASS["js"]
# A section starts at a line that is neither indented nor blank; inside a section a category
# starts at its header line.
_SECTION = rf"\n(?=[^ \n][^\n]*)(?=[^\n]*[^{_JS}])"
_CATEGORY = rf"\n(?=  [^{_JS}][^{EOL_CLASS}]*:(?:\n|\z))"

FACT = T.StructType(
    [
        T.StructField("amount", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("daily_value_percent", T.DoubleType()),
    ]
)
NUTRITION = T.StructType(
    [
        T.StructField("item_name", T.StringType()),
        T.StructField(
            "serving_info",
            T.StructType(
                [
                    T.StructField("servings_per_container", T.IntegerType()),
                    T.StructField("serving_size", T.StringType()),
                ]
            ),
        ),
        T.StructField("calories", T.StringType()),
        T.StructField("nutrition_facts", T.MapType(T.StringType(), FACT)),
        T.StructField("secondary_nutrients", T.MapType(T.StringType(), FACT)),
        T.StructField("ingredients", T.StringType()),
        T.StructField("allergens", T.StringType()),
    ]
)
MEAL = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("is_halal", T.BooleanType()),
        T.StructField("nutrition", NUTRITION),
        T.StructField("place", T.LongType()),
    ]
)
CATEGORY = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("meals", T.ArrayType(MEAL)),
        T.StructField("place", T.LongType()),
    ]
)
RESTAURANT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("hours", T.StringType()),
        T.StructField("categories", T.ArrayType(CATEGORY)),
        # Of a restaurant that was written in several parts; null in other documents.
        T.StructField("part", T.IntegerType()),
        T.StructField("first_part", T.BooleanType()),
        T.StructField("place", T.LongType()),
    ]
)
DOCUMENT = T.StructType(
    [T.StructField("timestamp", T.StringType()), T.StructField("restaurants", T.ArrayType(RESTAURANT))]
)
INDEX_ENTRY = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("safe_name", T.StringType()),
        T.StructField("hours", T.StringType()),
        T.StructField("total_items", T.LongType()),
        T.StructField("halal_items", T.LongType()),
        T.StructField("categories_count", T.LongType()),
    ]
)
INDEX = T.StructType(
    [
        T.StructField("created_at", T.StringType()),
        T.StructField("total_restaurants", T.LongType()),
        T.StructField("restaurants", T.MapType(T.StringType(), INDEX_ENTRY)),
    ]
)


def snapshot_order(restaurant: Column | str, category: Column | str, item: Column | str) -> Column:
    """One ordinal that grows over a whole snapshot, of positions below 2**21 each."""
    outer = F.shiftleft(col(restaurant).cast("long"), 42) + F.shiftleft(col(category).cast("long"), 21)
    return outer + col(item)


def read_snapshot_texts(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """One row per file: ``snapshot_id``, ``snapshot_ts``, ``value``."""
    reader = spark.readStream if stream else spark.read
    files = reader.format("text").option("wholetext", True).load(path)
    return files.select(
        F.col("_metadata.file_path").alias("snapshot_id"),
        F.col("_metadata.file_modification_time").alias("snapshot_ts"),
        "value",
    )


def menu_sections(snapshots: DataFrame, text: Column | str = "value") -> DataFrame:
    """One row per restaurant section of each snapshot text, before its lines are read.

    Each snapshot is one row and is cut inside that row, so no shuffle, window or state is
    involved and the same plan runs on a stream.
    """
    lines = F.concat(F.lit("\n"), F.regexp_replace(col(text), r"\r(?=\n|\z)", ""))
    kept = [c for c in snapshots.columns if c != text]
    cut = snapshots.select(*kept, F.posexplode(F.split(lines, _SECTION)).alias("restaurant_ord", "_section"))
    name, hours = split_name_hours(F.substring_index("_section", "\n", 1))
    return cut.where("restaurant_ord > 0").select(
        *kept, "restaurant_ord", name.alias("restaurant"), hours.alias("hours"), "_section"
    )


def section_categories() -> Column:
    """Categories of a section as ``array<struct<name, meals array<string>>>``, empty ones too."""
    blocks = F.split(F.col("_section"), _CATEGORY)

    def read(block: Column) -> Column:
        lines = F.split(block, "\n")
        items = F.filter(lines, lambda line: classify_menu_line(line) == "item")
        return F.struct(
            category_name(F.get(lines, 0)).alias("name"), F.transform(items, item_name).alias("meals")
        )

    # The block before the first category header holds the restaurant line and orphan items.
    return F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), read)


def parse_menu_text(snapshots: DataFrame, text: Column | str = "value") -> DataFrame:
    """Flat menu rows of text snapshots: each item with the restaurant and category above it.

    ``restaurant_ord`` and ``category_ord`` are positions; ``item_ord`` grows over the snapshot.
    """
    kept = [c for c in snapshots.columns if c != text]
    sections = menu_sections(snapshots, text)
    head = [*kept, "restaurant_ord", "restaurant", "hours"]
    blocks = sections.select(*head, F.posexplode(F.split("_section", _CATEGORY)).alias("category_ord", "_block"))
    lines = blocks.where("category_ord > 0").select(
        *head,
        "category_ord",
        category_name(F.substring_index("_block", "\n", 1)).alias("category"),
        F.posexplode(F.split("_block", "\n")).alias("_pos", "_line"),
    )
    order = snapshot_order("restaurant_ord", "category_ord", "_pos").alias("item_ord")
    return lines.where(classify_menu_line("_line") == "item").select(
        *head, "category_ord", "category", order, item_name("_line").alias("meal")
    )


def parse_menu_restaurants(snapshots: DataFrame, text: Column | str = "value") -> DataFrame:
    """Restaurant rows of text snapshots with open ranges, nested categories and item counts."""
    sections = menu_sections(snapshots, text)
    kept = [c for c in sections.columns if c != "_section"]
    filled = sections.select(*kept, section_categories().alias("categories"))
    count = F.aggregate("categories", F.lit(0), lambda total, c: total + F.size(c["meals"]))
    return filled.select(
        *kept, parse_hours("hours").alias("open_ranges"), "categories", count.alias("item_count")
    ).where("item_count > 0")


def read_menu_text(spark: SparkSession, path: str) -> DataFrame:
    return parse_menu_text(read_snapshot_texts(spark, path))


def flatten_restaurants(restaurants: DataFrame, keep: list[str], position: str = "restaurant_ord") -> DataFrame:
    """Flat rows of ``name, hours, categories, place``; missing arrays are empty, missing names filled.

    ``item_ord`` grows over the whole snapshot. Documents that carry places give these as ordinals,
    so the parts of a restaurant come together again; in others ordinals follow from positions.
    """
    categories = restaurants.select(
        *keep,
        F.col(position).alias("_r"),
        F.coalesce("place", position).cast("long").alias("restaurant_ord"),
        F.coalesce("name", F.lit(NAME_MISSING)).alias("restaurant"),
        F.coalesce("hours", F.lit(HOURS_MISSING)).alias("hours"),
        F.posexplode("categories").alias("_p", "_c"),
    )
    head = [*keep, "restaurant_ord", "restaurant", "hours"]
    meals = categories.select(
        *head,
        "_r",
        "_p",
        F.coalesce("_c.place", "_p").cast("long").alias("category_ord"),
        F.col("_c.name").alias("category"),
        F.posexplode("_c.meals").alias("_i", "_m"),
    )
    return meals.select(
        *head,
        "category_ord",
        "category",
        F.coalesce("_m.place", snapshot_order("_r", "_p", "_i")).alias("item_ord"),
        F.col("_m.name").alias("meal"),
        F.coalesce("_m.is_halal", F.lit(False)).alias("is_halal"),
        F.col("_m.nutrition").alias("nutrition"),
    )


def flatten_documents(documents: DataFrame, keep: list[str]) -> DataFrame:
    listed = documents.select(*keep, F.posexplode("restaurants").alias("_at", "_r"))
    return flatten_restaurants(listed.select(*keep, "_at", "_r.*"), keep, "_at")


def read_menu_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested documents, one row per file (or per line), with the restaurants array never null."""
    raw = spark.read.schema(DOCUMENT).option("multiLine", multi_line).json(path)
    return raw.select(
        F.col("_metadata.file_path").alias("snapshot_id"),
        "timestamp",
        F.coalesce("restaurants", F.array().cast(T.ArrayType(RESTAURANT))).alias("restaurants"),
    )


def read_menu_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return flatten_documents(read_menu_documents(spark, path, multi_line), ["snapshot_id"])


def read_restaurant_jsons(spark: SparkSession, directory: str, multi_line: bool = True) -> DataFrame:
    """Flat rows of a folder of per-restaurant files in order of file name; the index and the
    statistics are skipped. What ``write_restaurant_parts`` wrote has a document per line."""
    raw = spark.read.schema(RESTAURANT).option("multiLine", multi_line).option("pathGlobFilter", "*.json").json(directory)
    named = raw.select("*", F.col("_metadata.file_name").alias("file_name"))
    wanted = named.where(~F.col("file_name").isin("index.json", "summary_stats.json"))
    # One row per file, from the listing alone.
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True)
    names = listing.load(directory).select(F.element_at(F.split("path", "/"), -1).alias("file_name")).distinct()
    places = names.select("file_name", (F.row_number().over(Window.orderBy("file_name")) - 1).alias("_at"))
    return flatten_restaurants(wanted.join(places, "file_name"), ["file_name"], "_at")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of an ``index.json``; the file order is kept in ``ord``."""
    raw = spark.read.schema(INDEX).option("multiLine", True).json(path)
    rows = raw.select(F.posexplode(F.map_entries("restaurants")).alias("ord", "_e"))
    return rows.select("ord", F.col("_e.key").alias("restaurant"), "_e.value.*")
