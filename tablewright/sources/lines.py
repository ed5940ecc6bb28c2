"""Text snapshots read line by line, so that a file may be larger than a row, a task or an executor.

Spark cuts large files into splits, each read by a task of its own. A line's place is the start of its
split and its number there; both only have to grow, so nothing is counted over a whole file. What lies
above a line in its file (the restaurant and category in force, an open event) is found inside each
split first, and one row per split carries it on to the splits behind. The result does not
depend on where files are cut. A single line, a single event and, in calendars, a chunk of 128 lines have to fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ics import ics_unfold
from ..functions.text import category_name, classify_menu_line, item_name, split_name_hours
from ..operators.ordering import carry_forward, running_counts
from ..session import checkpoint_ready

FILE, SPLIT, PLACE = ["snapshot_id", "snapshot_ts"], "split", "place"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``snapshot_id, snapshot_ts, split, place, line`` of text files; lines end at a line feed only.

    ``split`` is the first byte of the line's split, ``place`` grows inside it.
    """
    files = spark.read.option("lineSep", "\n").text(path)
    return files.select(
        F.col("_metadata.file_path").alias("snapshot_id"),
        F.col("_metadata.file_modification_time").alias("snapshot_ts"),
        F.col("_metadata.file_block_start").alias(SPLIT),
        F.monotonically_increasing_id().alias(PLACE),
        F.col("value").alias("line"),
    )


# --- menus ----------------------------------------------------------------------------------


def menu_lines(lines: DataFrame) -> DataFrame:
    """Flat menu rows of the lines of text snapshots, as ``menus.parse_menu_text`` gives for whole texts.

    ``restaurant_ord`` and ``category_ord`` are the same; ``item_ord`` is the line's number in its file.
    """
    clean = lines.withColumn("line", F.regexp_replace("line", r"\r\z", ""))
    kind = classify_menu_line("line")
    numbered = running_counts(
        clean.withColumn("kind", kind), FILE, SPLIT, PLACE,
        n_line=F.lit(True), n_restaurant=F.col("kind") == "restaurant", n_category=F.col("kind") == "category",
    )
    # Blank lines and others say nothing.
    told = numbered.where(F.col("kind").isin("restaurant", "category", "item"))
    name, hours = split_name_hours("line")
    section = F.struct(name.alias("name"), hours.alias("hours"), F.col("n_category").alias("before"))
    headers = [("_section", F.col("kind") == "restaurant", section), ("_category", F.col("kind") == "category", category_name("line"))]
    placed = carry_forward(told, FILE, PLACE, headers, SPLIT)
    items = placed.where((F.col("kind") == "item") & F.col("_section").isNotNull() & F.col("_category").isNotNull())
    return items.select(
        *FILE,
        F.col("n_restaurant").cast("int").alias("restaurant_ord"),
        F.col("_section.name").alias("restaurant"),
        F.col("_section.hours").alias("hours"),
        (F.col("n_category") - F.col("_section.before")).cast("int").alias("category_ord"),
        F.col("_category").alias("category"),
        F.col("n_line").alias("item_ord"),
        item_name("line").alias("meal"),
    )


def read_menu_lines(spark: SparkSession, path: str) -> DataFrame:
    """Menu rows of text files of any size."""
    return menu_lines(read_lines(spark, path))


# --- calendars ------------------------------------------------------------------------------

_BEGIN, _END = "BEGIN:VEVENT", "END:VEVENT"
_MARK = rf"(?<={_BEGIN}|{_END})|(?={_BEGIN}|{_END})"
_CHUNK_BITS = 7  # a chunk has 128 lines at most


def _chunks(lines: DataFrame, folds: bool) -> DataFrame:
    """``lines`` with up to 128 neighbours of a split as one text, its own folds joined.

    Where folds are looked for, those that a chunk starts with are a text of their own: they go on from the chunk before.
    """
    chunk = F.shiftright(PLACE, _CHUNK_BITS).alias("_chunk")
    listed = F.array_sort(F.collect_list(F.struct(PLACE, "line"))).alias("_l")
    held = lines.groupBy(*FILE, SPLIT, chunk).agg(listed)
    text = lambda part: F.array_join(F.transform(part, lambda l: l["line"]), "\n")
    if not folds:
        return held.select(*FILE, SPLIT, F.col("_l")[0][PLACE].alias(PLACE), text("_l").alias("line"))
    head = F.array_position(F.transform("_l", lambda l: ~l["line"].rlike(r"^[ \t]")), F.lit(True))
    cut = held.withColumn("_k", F.when(head > 0, head - 1).otherwise(F.size("_l")).cast("int"))
    parts = F.array(F.slice("_l", F.lit(1), F.col("_k")), F.slice("_l", F.col("_k") + 1, F.size("_l")))
    told = cut.select(*FILE, SPLIT, F.explode(parts).alias("_l")).where(F.size("_l") > 0)
    return told.select(*FILE, SPLIT, F.col("_l")[0][PLACE].alias(PLACE), ics_unfold(text("_l")).alias("line"))


def _unfolded(lines: DataFrame) -> DataFrame:
    """Lines with their continuation lines joined on; the first line of a file continues nothing."""
    numbered = running_counts(lines, FILE, SPLIT, PLACE, n_line=F.lit(True))
    goes_on = F.col("line").rlike(r"^[ \t]") & (F.col("n_line") > 1)
    headed = running_counts(numbered, FILE, SPLIT, PLACE, head=~goes_on)
    # A folded line lies in one split but for the few that a border cuts.
    parts = headed.groupBy(*FILE, "head").agg(
        F.min(F.struct(SPLIT, PLACE)).alias("_at"), F.array_sort(F.collect_list(F.struct(SPLIT, PLACE, "line"))).alias("_parts")
    )
    texts = F.transform("_parts", lambda part, n: F.when(n == 0, part["line"]).otherwise(F.substr(part["line"], F.lit(2))))
    last = F.size("_parts") - 1
    # A fold takes the carriage return before it along.
    whole = F.array_join(F.transform(texts, lambda text, n: F.when(n < last, F.regexp_replace(text, r"\r\z", "")).otherwise(text)), "")
    return parts.select(*FILE, F.col(f"_at.{SPLIT}").alias(SPLIT), F.col(f"_at.{PLACE}").alias(PLACE), whole.alias("line"))


def calendar_blocks(lines: DataFrame, dialect: str = "strict") -> DataFrame:
    """``snapshot_id, snapshot_ts, ord, block`` of calendar lines, as ``calendar.event_blocks`` gives for whole texts.

    Begin and end marks count wherever they stand in a line. After a begin mark a piece of text is inside
    an event, after an end mark it is not, whatever came before; so the last mark before a
    piece settles where it is, and a mark that changes nothing is text. An event without an end is none.
    Lines are worked in chunks; events that lie in one chunk are cut out there, the others are put together.
    """
    checkpoint_ready(lines.sparkSession)
    # Stored, as every later step reads its input twice.
    chunks = _chunks(lines, dialect == "strict").checkpoint()
    joined = (_unfolded(chunks) if dialect == "strict" else chunks).withColumn("_parts", F.split("line", _END)).checkpoint()
    is_mark = lambda text: text.isin(_BEGIN, _END)
    none, empty, zero = F.lit(None).cast("string"), F.lit(""), F.lit(0)
    piece = lambda text, state, n=zero: F.struct(text.alias("text"), state.alias("state"), n.alias("events"))

    def cut(text: Column) -> Column:
        # A mark is followed by an empty piece that says so: pieces see what is at or before them.
        pieces = F.transform(F.split(text, _MARK), lambda p: F.when(is_mark(p), F.array(piece(p, none), piece(empty, p))).otherwise(F.array(piece(p, none))))
        return F.flatten(pieces)

    # Between two end marks of one text lies at most one event, whatever came before: only what is outside of them
    # goes on as pieces, with one piece that tells the number of these events.
    inner = F.filter(F.slice("_parts", F.lit(2), F.greatest(F.size("_parts") - 2, zero)), lambda p: F.contains(p, F.lit(_BEGIN)))
    outer = F.concat(cut(F.concat(F.col("_parts")[0], F.lit(_END))), F.array(piece(empty, F.lit(_END), F.size(inner))), cut(F.element_at("_parts", -1)))
    pieces = joined.select(*FILE, SPLIT, PLACE, F.when(F.size("_parts") > 2, outer).otherwise(cut(F.col("line"))).alias("_cut"))
    pieces = pieces.select("*", F.posexplode("_cut").alias("_n", "_p"))
    pieces = pieces.select(*FILE, SPLIT, F.struct(PLACE, "_n").alias("at"), "_p.*", (F.col("_n") == F.size("_cut") - 1).alias("ends"))
    held = carry_forward(pieces, FILE, "at", [("_last", F.col("state").isNotNull(), F.col("state"))], SPLIT).checkpoint()
    within = F.coalesce(F.col("_last") == _BEGIN, F.lit(False))
    told = held.withColumns({"_opens": (F.col("text") == _BEGIN) & ~within, "_closes": (F.col("text") == _END) & within})
    opened, closed = (F.col(c).cast("long") + F.col("events") for c in ("_opens", "_closes"))
    numbered = running_counts(told, FILE, SPLIT, "at", n_open=opened, n_closed=closed).checkpoint()
    inside = (F.col("n_open") > F.col("n_closed")) | F.col("_closes")
    shown = F.col("text") if dialect == "strict" else F.when(F.col("_opens") | F.col("_closes"), "").otherwise(F.col("text"))
    text = F.concat(shown, F.when(F.col("ends"), "\n").otherwise(""))
    listed = numbered.where(inside).select(*FILE, (F.col("n_open") - 1).cast("int").alias("ord"), F.struct(SPLIT, "at", text.alias("text")).alias("_p"), "_closes")
    events = listed.groupBy(*FILE, "ord").agg(F.array_sort(F.collect_list("_p")).alias("_parts"), F.bool_or("_closes").alias("_closed"))
    across = events.where("_closed").select(*FILE, "ord", F.array_join(F.transform("_parts", lambda p: p["text"]), "").alias("block"))

    first = numbered.where("events > 0").select(F.col(f"at.{PLACE}").alias(PLACE), (F.col("n_open") - F.col("events")).alias("_first"))
    begin = F.lit(_BEGIN)
    own = (lambda p: F.concat(F.substr(p, F.instr(p, begin)), F.lit(_END))) if dialect == "strict" else (lambda p: F.substr(p, F.instr(p, begin) + len(_BEGIN)))
    whole = joined.join(first, PLACE).select(*FILE, "_first", F.posexplode(F.transform(inner, own)).alias("_n", "block"))
    return across.unionByName(whole.select(*FILE, (F.col("_first") + F.col("_n")).cast("int").alias("ord"), "block"))


def read_calendar_blocks(spark: SparkSession, path: str, dialect: str = "strict") -> DataFrame:
    """Event blocks of calendar files of any size; each event fits in a row."""
    return calendar_blocks(read_lines(spark, path), dialect)
