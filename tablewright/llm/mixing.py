"""Mixing sources to target weights along a time-varying curriculum.

A source has a total (its share of the mix) and a schedule: how its rate changes from the start
of training (time 0) to the end (time 1). The schedule's integral up to a time, scaled to the
total, is the source's cumulative token demand. The documents of a source stand in a fixed random
order, so each begins at some cumulative number of words; where the total exceeds the source's
own words, the order repeats as a second epoch. Inverting the demand at the middle of a document
gives its training position, a time between 0 and 1, and the mix is range-sorted by position.

Totals: sources in code-point order (null last) weigh ``WEIGHTS`` in turn and share ``BUDGET``
times all words; a total stops at ``EPOCHS`` times the words of its source, and the excess is
shared again by weight until none is above. As the limits are met in the order of limit by
weight, one sorted pass over the sources gives the end of that repetition.

A source that holds most of the corpus is no bottleneck: its documents are range-partitioned by
their random order, so that a source spans many partitions, and cumulative words are the words
of earlier partitions (one small row per source and partition) plus those inside the own one.

Results: a document is taken whole once, twice or not at all: in each epoch it is taken if its
middle lies within the total, so a source misses its total by less than a document. Null text
has no words. The order depends on the rows' values only; rows equal in all of id, source and
text are interchangeable, and reruns give the same rows on any partitioning. An empty table
gives an empty one. Input columns called like an output give way to it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, prepare, quoted, without

WEIGHTS, BUDGET, EPOCHS = (3.0, 1.0, 2.0), 1.5, 2
# Rates at times 0 and 1 of sources by their place in the order: falling, even, rising.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def word_count(text: Column) -> Column:
    """Number of words: places where a word begins."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS
) -> DataFrame:
    """``source, source_size, place, target`` of a table of ``source, source_size`` (row each)."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sizes.withColumn("place", (F.row_number().over(ordered) - 1).cast("long"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = placed.withColumn("weight", turn).withColumn("limit", (F.col("source_size") * epochs).cast("double"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumns({
        "all": F.sum("source_size").over(everything) * F.lit(float(budget)),
        "used": F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
        "weights": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # While sources meet their limits, what is left is shared among the rest. The first source
    # below its limit fixes the level for all after it.
    rows = rows.withColumn("level", (F.col("all") - F.col("used")) / F.col("weights"))
    rows = rows.withColumn("limit_rank", F.row_number().over(by_limit))
    level = F.min(F.when(F.col("level") * F.col("weight") < F.col("limit"), F.struct("limit_rank", "level"))).over(everything)
    rows = rows.withColumn("open", level)
    free = F.col("limit_rank") >= F.col("open.limit_rank")
    target = F.when(free, F.col("open.level") * F.col("weight")).otherwise(F.col("limit"))
    return rows.select("source", "source_size", "place", target.alias("target"))


def demand_time(share: Column, rates: Column) -> Column:
    """Time at which a source of the given rates (at times 0 and 1) has met a share of its total.

    The demand is the integral of a linear rate, ``a t + (b - a) t^2 / 2`` with mean rate 1."""
    a, b = rates[0], rates[1]
    mean = (a + b) / 2
    root = F.sqrt(F.greatest(a * a + 2 * (b - a) * mean * share, F.lit(0.0)))
    # The stable form of the quadratic's root; for even rates it is the share itself.
    return F.least(F.greatest(2 * mean * share / (a + root), F.lit(0.0)), F.lit(1.0))


def _keys(id: Column, text: Column) -> list[Column]:
    """128 bits that stand for a row's id and text. The first part is the random order."""
    body = F.xxhash64(text)
    return [F.xxhash64(id, body, F.lit(11)).alias("_order"), F.xxhash64(F.lit(12), text, id).alias("_other")]


def _laid_out(docs: DataFrame, id: str, text: str, source: str) -> DataFrame:
    """``_id, source, size, _order, _other, before`` per row: ``before`` are the words of the
    documents that stand earlier in the source's order."""
    prepare(docs.sparkSession)
    words = docs.select(
        quoted(id).alias("_id"), quoted(source).alias("source"), word_count(quoted(text)).alias("size"),
        *_keys(quoted(id), quoted(text)), F.monotonically_increasing_id().alias("_nth"),
    ).checkpoint()
    ordered = words.repartitionByRange("source", "_order", "_other", "_nth")
    ordered = ordered.sortWithinPartitions("source", "_order", "_other", "_nth").drop("_nth")
    # Frozen: all uses must see the same ranges.
    rows = ordered.withColumn("_slice", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    parts = rows.groupBy("source", "_slice").agg(F.sum("size").alias("part"))
    earlier = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("part").over(earlier), F.lit(0)))
    inside = Window.partitionBy("_slice", "source").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    parts = parts.select(F.col("source").alias("_source"), F.col("_slice").alias("_at"), "start")
    same = [local["_slice"] == parts["_at"], local["source"].eqNullSafe(parts["_source"])]
    return local.join(parts, same).withColumn("before", F.col("start") + F.col("_inside")).select(
        "_id", "source", "size", "_order", "_other", "before"
    )


class Plan:
    """Settings of a mix: weights, budget and epochs of the totals, schedules of sources by name
    (``named``) and of the others in turn. Rates are positive."""

    def __init__(
        self,
        weights: Sequence[float] = WEIGHTS,
        budget: float = BUDGET,
        epochs: int = EPOCHS,
        schedules: Sequence[tuple[float, float]] = SCHEDULES,
        named: Mapping[str, tuple[float, float]] | None = None,
    ) -> None:
        self.weights, self.budget, self.epochs, self.schedules, self.named = weights, budget, epochs, schedules, named or {}

    def with_goals(self, rows: DataFrame, sources: DataFrame) -> DataFrame:
        """``rows`` with ``source_size``, ``target`` and ``rates`` of their source, of the goals of
        ``sources`` (laid-out rows)."""
        sizes = sources.groupBy("source").agg(F.sum("size").alias("source_size"))
        goals = source_targets(sizes, self.weights, self.budget, self.epochs)
        turned = F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in self.schedules])
        rates = F.element_at(turned, (F.col("place") % len(self.schedules) + 1).cast("int"))
        for name, (a, b) in self.named.items():
            rates = F.when(F.col("source") == name, F.array(F.lit(float(a)), F.lit(float(b)))).otherwise(rates)
        goals = goals.withColumn("rates", rates).withColumnRenamed("source", "_source")
        return rows.join(goals, rows["source"].eqNullSafe(goals["_source"])).drop("_source")

    def positions(self, before: Column) -> Column:
        """Times at which a document is taken, by the epochs whose middle lies in the total."""
        middles = F.transform(
            F.sequence(F.lit(0), F.lit(self.epochs - 1)),
            lambda n: n * F.col("source_size") + before + F.col("size") / F.lit(2.0),
        )
        taken = F.filter(middles, lambda m: (F.col("size") > 0) & (m < F.col("target")))
        return F.transform(taken, lambda m: demand_time(m / F.col("target"), F.col("rates")))


def training_mix(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", plan: Plan | None = None
) -> DataFrame:
    """One row per document, range-sorted by first position (untaken ones last): ``id, source,
    size, source_size, target, taken, positions``; ``positions`` has the time of each epoch in
    which the document is taken."""
    plan = plan or Plan()
    placed = _laid_out(docs, id, text, source)
    made = plan.with_goals(placed, placed).withColumn("positions", plan.positions(F.col("before")))
    out = made.select(
        F.col("_id").alias(id), *(["source"] if id != "source" else []), "size", "source_size", "target",
        (F.size("positions") * F.col("size")).cast("long").alias("taken"), "positions",
    )
    return out.orderBy(F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0)), quoted(id))


def mixed_documents(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", plan: Plan | None = None
) -> DataFrame:
    """The training stream: ``docs`` as often as the mix takes them, range-sorted by position.

    Decisions are made on narrow rows; the documents meet theirs by id and text, and rows equal
    in both take the places of their group one after the other. Documents without words are in
    no mix.
    """
    plan = plan or Plan()
    placed = _laid_out(docs, id, text, source)
    groups = placed.groupBy("source", "_order", "_other").agg(F.first("size").alias("size"), F.min("before").alias("before"), F.count("*").alias("n"))
    groups = plan.with_goals(groups, placed)
    some = F.size(plan.positions(F.col("before"))) > 0
    chosen = groups.where(some | (F.col("n") > 1)).select(
        F.xxhash64("source").alias("_tw_source"), F.col("_order").alias("_tw_order"), F.col("_other").alias("_tw_other"),
        "size", "before", "source_size", "target", "rates",
    )
    names = docs.columns
    held = docs.select(*[quoted(name).alias(f"_c{n}") for n, name in enumerate(names)])
    at = {name: F.col(f"_c{n}") for n, name in enumerate(names)}
    order, other = _keys(at[id], at[text])
    keys = ["_tw_order", "_tw_other", "_tw_source"]
    wide = held.select("*", order.alias(keys[0]), other.alias(keys[1]), F.xxhash64(at[source]).alias(keys[2]))
    met = wide.join(chosen, keys)
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)) - 1
    met = met.withColumn("_tw_turn", turn)
    stream = met.withColumn("_tw_at", F.explode(plan.positions(F.col("before") + F.col("_tw_turn") * F.col("size"))))
    return stream.orderBy("_tw_at", *keys).select(*[at[name].alias(name) for name in names])
