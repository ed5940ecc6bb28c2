"""Order-dependent steps that keep working when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_ready
from .joins import join_lookup


def first_wins(rows: DataFrame, keys: Sequence[str], order: Column, payload: Sequence[str]) -> DataFrame:
    """One row per key: the one met first. Each map task reduces its own rows before the shuffle."""
    return _pick(F.min_by, rows, keys, order, payload)


def last_wins(rows: DataFrame, keys: Sequence[str], order: Column, payload: Sequence[str]) -> DataFrame:
    """One row per key: the one met last."""
    return _pick(F.max_by, rows, keys, order, payload)


def _pick(pick, rows, keys, order, payload):
    picked = rows.groupBy(*keys).agg(pick(F.struct(*payload), order).alias("_p"))
    return picked.select(*keys, "_p.*")


def dedup_first_seen(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Distinct keys with the smallest ordinal each was seen at."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def top_k(rows: DataFrame, value: str, order: str, k: int) -> DataFrame:
    """The k largest with their ``rank``; equal values stay in input order."""
    best = rows.orderBy(F.desc(value), F.asc(order)).limit(k)
    # A window over k rows.
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), F.asc(order))))


def first_k_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, name: str) -> DataFrame:
    """First k rows of each key with their rank; Spark cuts each map task to k rows per key."""
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= k)


def carry_forward(
    rows: DataFrame,
    stream: Sequence[str],
    pos: str,
    headers: Sequence[tuple[str, Column, Column]],
    block: int | str = 100_000,
) -> DataFrame:
    """Give every row the latest header values at or before it in its stream.

    ``headers`` lists (output name, is-header test, value) from outer to inner; an inner value
    ends where a new outer header starts. ``pos`` is unique in a stream. A stream is worked in
    blocks of positions: inside a block by a window, between blocks through one summary row
    per block, so a very long stream is spread over many tasks. ``block`` is the length of a block, or
    the name of a column that says where in the stream a row's block starts; ``pos`` then only has
    to grow inside a block.
    """
    keys = [*stream, "_block"]
    marks = [f"_mark_{name}" for name, _, _ in headers]
    base = rows.withColumn("_block", F.col(block) if isinstance(block, str) else F.expr(f"`{pos}` div {block}"))
    spot = F.struct("_block", pos) if isinstance(block, str) else F.col(pos)
    for mark, (_, test, value) in zip(marks, headers):
        base = base.withColumn(mark, F.when(test, F.struct(spot.alias("at"), value.alias("value"))))

    so_far = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumns({m: F.last(m, ignorenulls=True).over(so_far) for m in marks})

    before = Window.partitionBy(*stream).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = base.groupBy(*keys).agg(*[F.max(m).alias(m) for m in marks])
    carried = ends.select(*keys, *[F.last(m, ignorenulls=True).over(before).alias(f"{m}_in") for m in marks])

    # Streams without a key are streams too.
    joined = join_lookup(local, carried, keys, null_safe=True)
    out = joined.withColumns({m: F.coalesce(m, f"{m}_in") for m in marks})
    values, outer = {}, []
    for mark, (name, _, _) in zip(marks, headers):
        at = F.col(f"{mark}.at")
        started = F.greatest(*outer) if len(outer) > 1 else outer[0] if outer else F.lit(None)
        live = F.coalesce(started < at, F.lit(True))
        values[name] = F.when(live, F.col(f"{mark}.value"))
        values[f"{name}_pos"] = F.when(live, at)
        outer.append(at)
    return out.select(*rows.columns, *[v.alias(n) for n, v in values.items()])


def running_counts(rows: DataFrame, stream: Sequence[str], block: str, pos: str, **tests: Column) -> DataFrame:
    """``rows`` with, for each test, how many rows of the stream hold it up to and including this one; a number in place
    of a test counts as so many.

    Blocks as in ``carry_forward``: counted inside a block by a window, and one row per block says what
    came before it.
    """
    counted = rows.withColumns({f"_is_{name}": F.coalesce(test.cast("long"), F.lit(0)) for name, test in tests.items()})
    inside = Window.partitionBy(*stream, block).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = counted.withColumns({name: F.sum(f"_is_{name}").over(inside) for name in tests})
    earlier = Window.partitionBy(*stream).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = counted.groupBy(*stream, block).agg(*[F.sum(f"_is_{name}").alias(f"_sum_{name}") for name in tests])
    before = sums.select(*stream, block, *[F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name in tests])
    joined = join_lookup(local, before, [*stream, block], "inner", null_safe=True)
    return joined.select(*rows.columns, *[(F.col(name) + F.col(f"_before_{name}")).alias(name) for name in tests])


def with_position(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, bucket: Column, finer: Sequence[Column] = ()
) -> DataFrame:
    """Exact 1-based position of each row in its key, without gathering a key in one task.

    ``bucket`` cuts the order into ranges: it never falls as the order rises (nulls first). Rows
    are numbered inside their bucket, and what the earlier buckets hold of a key is one small row
    per key and bucket. ``finer`` cuts each bucket further, level by level: inside what is equal in
    the levels before it, a level never falls as the order rises; its rows are counted there only.
    Nothing is stored, and building the plan runs nothing.
    """
    levels = ["_bucket", *[f"_bucket{n}" for n in range(1, len(finer) + 1)]]
    cut = rows.withColumns(dict(zip(levels, (bucket, *finer))))
    inside = Window.partitionBy(*keys, *levels).orderBy(*order)
    counts, starts = cut.groupBy(*keys, *levels).agg(F.count("*").alias("_n")), None
    for depth in range(len(levels), 0, -1):
        within = [*keys, *levels[: depth - 1]]
        earlier = Window.partitionBy(*within).orderBy(levels[depth - 1]).rowsBetween(Window.unboundedPreceding, -1)
        own = [*within, levels[depth - 1]]
        before = counts.select(*own, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before" if starts is None else "_more"))
        if starts is not None:
            starts = join_lookup(starts, before, own, "inner", null_safe=True)
            starts = starts.withColumn("_before", F.col("_before") + F.col("_more")).drop("_more")
        else:
            starts = before
        counts = counts.groupBy(*within).agg(F.sum("_n").alias("_n"))
    placed = join_lookup(cut.withColumn("_in", F.row_number().over(inside)), starts, [*keys, *levels], "inner", null_safe=True)
    return placed.select(*rows.columns, (F.col("_before") + F.col("_in")).alias(name))


def range_positions(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """Exact 1-based position of each row in its key, in ranges that the data give.

    Rows are dealt into ranges of ``keys`` and ``order`` of about equal size, as many as there are shuffle
    partitions, sorted there, and stored, so that every later step meets the same ranges. A row's place
    in its range comes with the sort. What a range holds of a key is one small row (a key has at most one
    for each range), and sums over these say how many rows of the key come earlier. A value that
    half of all rows share is cut by the parts of the order behind it, so no task holds more than its
    range; only rows equal in all of ``keys`` and ``order`` stay together, in any order.

    Columns of ``rows`` called ``_tw_range`` or ``_tw_place`` would clash and may not be there.
    """
    checkpoint_ready(rows.sparkSession)
    spread = [*keys, *order]
    dealt = rows.repartitionByRange(*spread).sortWithinPartitions(*spread)
    # A running id is the partition in its upper bits and the row's place there in the lower 33.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    stored = dealt.withColumns({"_tw_range": F.spark_partition_id(), "_tw_place": place}).checkpoint()
    held = stored.groupBy(*keys, "_tw_range").agg(F.count("*").alias("_n"), F.min("_tw_place").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_tw_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(*keys, "_tw_range", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = join_lookup(stored, starts, [*keys, "_tw_range"], "inner", null_safe=True)
    return placed.select(*rows.columns, (F.col("_before") + F.col("_tw_place") - F.col("_first") + 1).alias(name))


def first_after(rows: DataFrame, entries: DataFrame, keys: Sequence[str], at: str, entry_at: str, value: Column, name: str) -> DataFrame:
    """``rows`` with the smallest ``value`` of the entries of their key that are later than ``at``, else null.

    An as-of join for any number of entries in a key. Rows and entries are dealt into ranges of key and
    time that the data give (see ``range_positions``); inside a range a window runs back from its end, and
    one small row for each key and range says what the ranges behind it hold. So neither a key nor a time is
    gathered in one task, and no pairs are made. A row without a time or a key has no later entry.
    """
    checkpoint_ready(rows.sparkSession)
    own, clock = [f"_k{n}" for n in range(len(keys))], F.col("_at")
    named = [F.col(k).alias(o) for k, o in zip(keys, own)]
    blank = F.lit(None)
    packed = rows.select(*named, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*rows.columns).alias("_row"))
    listed = entries.select(*named, F.col(entry_at).alias("_at"), F.lit(0).alias("_kind"), value.alias("_value"))
    listed = listed.where(clock.isNotNull())
    both = packed.withColumn("_value", blank.cast(listed.schema["_value"].dataType)).unionByName(
        listed.withColumn("_row", blank.cast(packed.schema["_row"].dataType)), allowMissingColumns=False
    )
    # At one time entries come before rows, so what is behind a row is later.
    dealt = both.repartitionByRange(*own, "_at", "_kind").withColumn("_range", F.spark_partition_id()).checkpoint()
    behind = Window.partitionBy(*own, "_range").orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumn("_local", F.min("_value").over(behind)).where("_kind = 1")
    least = dealt.where("_kind = 0").groupBy(*own, "_range").agg(F.min("_value").alias("_least"))
    spans = dealt.select(*own, "_range").distinct().join(least, [*own, "_range"], "left")
    later = Window.partitionBy(*own).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*own, "_range", F.min("_least").over(later).alias("_carried"))
    joined = join_lookup(local, carried, [*own, "_range"])
    known = [F.col(k).isNotNull() for k in (*own, "_at")]
    found = F.when(F.array_position(F.array(*known), F.lit(False)) == 0, F.least("_local", "_carried"))
    return joined.select("_row.*", found.alias(name))


def largest_range(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> int:
    """Rows of the largest range that ``range_positions`` makes: what its largest task holds."""
    sizes = rows.repartitionByRange(*keys, *order).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
