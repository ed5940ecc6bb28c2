"""Connected components of a graph kept as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored

EDGES = 100_000  # edges of a partition


def _turned(rows: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """``a, b``: these pairs of columns of each row. No union, which would lose that ``rows`` are one partition."""
    pairs = F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in ends])
    return rows.select(F.explode(pairs).alias("pair")).select("pair.*")


def _with_least(rows: DataFrame, one: bool) -> DataFrame:
    """``rows`` with ``m``, the least ``b`` of their ``a``; ``one``: they are one partition."""
    if one:
        return rows.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return rows.join(rows.groupBy("a").agg(F.min("b").alias("m")), "a")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` of every node of ``edges`` (``a``, ``b``): the root is the smallest node
    that can be reached.

    Each round points all neighbours of a node to the smallest one, first the larger neighbours
    (so long chains halve), then the smaller ones (so the graph thins to stars). A round is two
    grouped minima and two joins on the node; a hub's edges are split by Spark's skew join. The
    edges are stored each round, in partitions that follow their number. Those of a small graph are one
    partition, where windows give the minima and nothing is dealt out: a round would else take as many
    tasks and files as one of a large graph. Nothing but one sum comes to the driver.
    """
    prepare(edges.sparkSession)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stored(now.distinct())
    seen = None
    for _ in range(rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if state == seen:
            break
        seen = state
        parts = 1 + state["n"] // EDGES
        both = _turned(now.coalesce(parts), ("a", "b"), ("b", "a"))
        # Larger neighbours of each node move to the least of its neighbourhood.
        large = _with_least(both, parts == 1).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        small = _with_least(large.where("a <> b").distinct(), parts == 1)
        now = stored(_turned(small, ("a", "m"), ("b", "m")).where("a <> b").distinct())
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    # Settled: every edge goes from a node to the root of its star.
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
