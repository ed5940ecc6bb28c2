"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

Each input partition orders its rows at random. How many rows a partition sends to each shard is
drawn beforehand, once, with the law that a uniformly random arrangement of all rows would give:
a matrix whose rows add up to the partitions' sizes and whose columns add up to the shards'. It
is drawn by halving: the partitions are split in two halves and the number of rows of each shard
that come from the left half is hypergeometric, then each half is split again, so all draws of a
level are made side by side. A draw inverts the distribution by walking from its mode with ratios
of neighbouring probabilities; its uniform number is a hash of seed, level, node and shard.

Rows then go to shards by their place in the partition, and are ordered at random once more in
their shard. Both steps together give every arrangement the same chance. Slots are counted in
ranges of the second random order, so that no shard passes through one task.

All steps are DataFrame operations. The law is ``rows``: shards differ by at most one row. Groups
of equal texts are not kept together, as their sizes could not be met otherwise.

Results: a null text has no bytes and the checksum of the empty text; repeated rows get slots of
their own; with fewer rows than shards some shards are empty; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, quoted, without

SHARDS = 24
SEED = 20
BUCKET_ROWS = 20_000  # rows of a shard that are ordered in one task
REACH = 12.0  # standard deviations around the mode that a draw can reach


# --- one hypergeometric draw ---------------------------------------------------------------

def draw(rows: str, good: str, taken: str, uniform: str) -> str:
    """SQL for the number of ``good`` rows among ``taken`` ones out of ``rows``.

    Weights of neighbouring values follow from the mode's, taken as one; a first walk sums them
    up and down, a second one stops where the sum passes the uniform number's part of the total.
    What lies beyond ``REACH`` standard deviations has a chance below the precision of doubles.
    """
    low, high = f"greatest(0L, {taken} - ({rows} - {good}))", f"least({taken}, {good})"
    mode = f"least({high}, greatest({low}, cast(floor(({taken} + 1D) * ({good} + 1D) / ({rows} + 2D)) AS bigint)))"
    part = f"(cast({good} AS double) / greatest({rows}, 1L))"
    spread = f"sqrt({taken} * {part} * (1D - {part}) * (({rows} - {taken}) / greatest({rows} - 1D, 1D)))"
    steps = f"cast({REACH} * {spread} AS bigint) + 20L"

    # As structs travel: value k, its weight w, the sum of weights so far.
    def up(k: str) -> str:
        return f"cast({good} - {k} AS double) * ({taken} - {k}) / (({k} + 1D) * ({rows} - {good} - {taken} + {k} + 1D))"

    def down(k: str) -> str:
        return f"cast({k} AS double) * ({rows} - {good} - {taken} + {k}) / (({good} - {k} + 1D) * ({taken} - {k} + 1D))"

    def total(ratio, sign: str) -> str:
        start = f"named_struct('k', {mode}, 'w', 1D, 's', 0D)"
        move = f"walk.w * {ratio('walk.k')}"
        return f"aggregate(sequence(1L, {steps}), {start}, (walk, n_) -> named_struct('k', walk.k {sign} 1L, 'w', {move}, 's', walk.s + {move}), walk -> walk.s)"

    def find(ratio, sign: str, first: str, target: str) -> str:
        start = f"named_struct('k', {mode}, 'w', 1D, 's', {first})"
        move = f"walk.w * {ratio('walk.k')}"
        return (
            f"aggregate(sequence(1L, {steps}), {start}, (walk, n_) -> if(walk.s > {target} OR walk.w = 0D, walk, "
            f"named_struct('k', walk.k {sign} 1L, 'w', {move}, 's', walk.s + {move})), "
            f"walk -> greatest({low}, least({high}, walk.k)))"
        )

    above, below = total(up, "+"), total(down, "-")
    return (
        f"element_at(transform(array(named_struct('above', {above}, 'below', {below})), sides -> "
        f"element_at(transform(array({uniform} * (1D + sides.above + sides.below)), goal -> "
        f"if(goal < 1D + sides.above, {find(up, '+', '1D', 'goal')}, {find(down, '-', '1D + sides.above', 'goal')})), 1)), 1)"
    )


def split_draws(seed: int = SEED) -> str:
    """SQL that draws, shard after shard, how many rows of each shard come from the left half:
    from ``caps`` (rows of each shard in the node), ``n`` and ``left`` (rows in node and half)."""
    uniform = f"(shiftrightunsigned(xxhash64({seed}, level, node, i), 11) / 9007199254740992D)"
    one = draw("x.rows", "x.cap", "x.left", "x.u")
    step = (
        "named_struct('out', concat(s.out, array(d)), 'rows', s.rows - element_at(caps, i), 'left', s.left - d)"
    )
    drawn = (
        f"element_at(transform(array(named_struct('rows', s.rows, 'cap', element_at(caps, i), 'left', s.left, 'u', {uniform})), "
        f"x -> {one}), 1)"
    )
    body = f"element_at(transform(array({drawn}), d -> {step}), 1)"
    start = "named_struct('out', cast(array() AS array<bigint>), 'rows', n, 'left', left)"
    return f"aggregate(sequence(1, size(caps)), {start}, (s, i) -> {body}, s -> s.out)"


def communication_matrix(counts: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``block, sends`` of a table ``block, n`` (row per partition): rows to send to each shard.

    The list of partition sizes, a number for each input split, is the only thing kept in a row.
    """
    levels = max(1, counts.count() - 1).bit_length()
    ordered = F.array_sort(F.collect_list(F.struct("block", "n")))
    root = counts.agg(ordered.alias("blocks")).withColumn("n", F.expr("aggregate(blocks, 0L, (a, b) -> a + b.n)"))
    caps = f"transform(sequence(0, {shards - 1}), s -> cast(n div {shards} + if(s < n % {shards}, 1, 0) AS bigint))"
    node = root.selectExpr("blocks", "n", f"{caps} AS caps", "0L AS node")
    for level in range(levels):
        half = "cast(ceil(size(blocks) / 2D) AS int)"
        halved = node.selectExpr(
            "node", "n", "caps", f"slice(blocks, 1, {half}) AS low",
            f"slice(blocks, {half} + 1, size(blocks)) AS high", f"{level} AS level",
        )
        halved = halved.withColumn("left", F.expr("aggregate(low, 0L, (a, b) -> a + b.n)"))
        drawn = halved.withColumn("out", F.expr(split_draws(seed)))
        sides = F.explode(F.expr(
            "array(named_struct('blocks', low, 'n', left, 'caps', out, 'node', 2 * node),"
            " named_struct('blocks', high, 'n', n - left, 'caps', zip_with(caps, out, (c, o) -> c - o), 'node', 2 * node + 1))"
        ))
        node = drawn.select(sides.alias("side")).select("side.*").where("size(blocks) > 0")
    return node.selectExpr("blocks[0].block AS block", "caps AS sends")


# --- shuffle -------------------------------------------------------------------------------

def uniform_shards(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (place in the shard, from 0 without gaps).

    The locally permuted rows are checkpointed once: what is drawn and what is sent must agree
    even if an executor is lost. Give it the columns that are to travel.
    """
    prepare(rows.sparkSession)
    kept = without(rows, ["shard", "slot", "_tw_key", "_tw_block", "_tw_at"])
    mixed = kept.withColumn("_tw_key", F.rand(seed)).sortWithinPartitions("_tw_key").drop("_tw_key")
    # The id is the partition number above 33 bits of row number.
    local = mixed.withColumn("_tw_at", F.monotonically_increasing_id()).checkpoint()
    local = local.withColumn("_tw_block", F.shiftright("_tw_at", 33))
    counts = local.groupBy("_tw_block").agg(F.count("*").alias("n"))
    matrix = communication_matrix(counts.withColumnRenamed("_tw_block", "block"), shards, seed).checkpoint()
    sums = F.expr("transform(sequence(1, size(sends)), i -> aggregate(slice(sends, 1, i), 0L, (a, b) -> a + b)) AS _tw_ends")
    ends = matrix.select(F.col("block").alias("_tw_block"), sums)
    place = F.col("_tw_at").bitwiseAND(F.lit(2**33 - 1))
    sent = local.join(ends, "_tw_block").withColumn("shard", F.size(F.filter("_tw_ends", lambda end: end <= place)))
    # Second permutation: a random key of the row, its leading part a range inside the shard.
    total = counts.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-total // (shards * BUCKET_ROWS)))
    sent = sent.withColumn("_tw_key", F.xxhash64("_tw_at", F.lit(seed + 1)))
    sent = sent.withColumn("_tw_range", F.expr(f"cast(shiftrightunsigned(_tw_key, 32) * {ranges} / 4294967296D AS int)"))
    counted = sent.groupBy("shard", "_tw_range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("_tw_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("shard", "_tw_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_tw_start"))
    inside = Window.partitionBy("shard", "_tw_range").orderBy("_tw_key", "_tw_at")
    placed = sent.withColumn("_tw_in", F.row_number().over(inside)).join(starts, ["shard", "_tw_range"])
    slot = (F.col("_tw_start") + F.col("_tw_in") - 1).cast("long")
    return placed.select(*map(quoted, kept.columns), "shard", slot.alias("slot"))


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus eight."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
