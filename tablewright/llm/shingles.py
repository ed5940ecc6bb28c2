"""Near duplicates by word shingles: Jaccard similarity of the sets of five-word shingles, 0.8 or more.

Candidates are the links that the SimHash operator finds by pigeonring (``simhash``, two bits or fewer), and, for
copies with more edits than two bits take, those of MinHash: ``ROWS`` least values make the key of a band, texts that share one of
``BANDS`` keys meet. A pair of similarity s meets with probability 1 - (1 - s**5)**32: all but 3 of a
million pairs at 0.8, all but 1 of 10**12 at 0.9. Every link is then checked on the whole shingle
sets, so nothing below the bound is linked.

Texts of one set are one node. In a bucket (the nodes under one key) all are checked against the
smallest node first, its head, which links a large group in linear size. What is left are pairs in different
components under one head h, and for these the *differences from the head* decide: with D(a) = a xor h,
two sets a and b differ in D(a) xor D(b), so similar ones share at least
(|D(a)| + |D(b)| - (|a| + |b|) / 9) / 2 entries of their differences, which is more than none unless both are
similar to h. Entries are ordered by how many nodes of the head have them, rarest first; two nodes meet only under
an entry that is early enough in both orders to be the first that a similar pair must share. Edits of
one's own are the rarest and meet nobody, so a group of copies that are too far apart gives a small part of its
pairs, while no similar pair is left out. Shingle sets are built only for nodes that share a bucket, a pair of sets is put together
once for each head and node, and the pairs of one node are dealt over ``SALTS`` parts.

Results: words and lower case as in ``simhash``; fewer than five words make one shingle, texts
without a word (or null) are copies of each other. Repeated rows and copies are one node, of which one row
stays; null ids come last. An empty table gives an empty one; columns called like the operator's own helpers
(``_tw_``) give way, others stay. A text's set is held in one row, of eight bytes for each of its distinct
shingles, however long the text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .common import prepare, quoted, stored, without
from .components import components
from .simhash import fingerprint, keep_one, print_groups, shingle_hashes

WIDTH = 5
SIMILAR = (4, 5)  # least similarity, as a fraction
BANDS, ROWS = 32, 5
SALTS = 1024
PART = 512  # shingles permuted at once

_DICE = np.random.default_rng(20)
_FACTORS = _DICE.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_MASKS = _DICE.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    parts = [np.unique(np.array(p, dtype=np.uint64)) for p in shingle_hashes(text, width)]
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate([np.empty(0, np.uint64), *parts]))


def node_of(shingles: np.ndarray) -> int:
    """Name of a set, as a signed long."""
    return int(np.array([xxhash.xxh64_intdigest(shingles.tobytes(), 7)], np.uint64).view(np.int64)[0])


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys of the bands of a set, as signed longs."""
    if not len(shingles):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), PART):
        np.minimum(least, ((shingles[None, start : start + PART] ^ _MASKS) * _FACTORS).min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), n) for n, band in enumerate(bands)]
    return np.array(keys, np.uint64).view(np.int64)


SKETCH = T.StructType().add("node", "long").add("size", "long").add("bands", T.ArrayType(T.LongType())).add("print", "long")


@F.arrow_udf(SKETCH)
def sketches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """What a text is found by. The fingerprint is made beside the bands: a function of its own would have every task
    send its texts to a second Python process."""
    for batch in batches:
        sets = [shingle_set(t.as_py()) for t in batch]
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch), np.uint64, len(batch))
        columns = [
            pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())), pa.array(prints.view(np.int64)),
        ]
        yield pa.StructArray.from_arrays(columns, names=SKETCH.names)


@F.arrow_udf(T.StructType().add("node", "long").add("shingles", "binary"))
def named_sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        sets = [shingle_set(t.as_py()) for t in batch]
        columns = [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
        yield pa.StructArray.from_arrays(columns, names=["node", "shingles"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have the least similarity."""
    low, of = SIMILAR
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * of >= low * (len(a) + len(b) - common)


@F.arrow_udf(T.BooleanType())
def _similar(left: pa.Array, right: pa.Array) -> pa.Array:
    pairs = zip(left, right)
    return pa.array([similar(*(np.frombuffer(x.as_py(), np.uint64) for x in pair)) for pair in pairs], pa.bool_())


@F.arrow_udf(T.ArrayType(T.LongType()))
def _difference(left: pa.Array, right: pa.Array) -> pa.Array:
    """Entries that one of two sets has and the other has not."""
    sets = ((np.frombuffer(x.as_py(), np.uint64) for x in pair) for pair in zip(left, right))
    found = [np.setxor1d(a, b, assume_unique=True).view(np.int64) for a, b in sets]
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *found])))


def _paired(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (with ``a, b``) with the sets of both as ``left, right``."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    right = salted.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
    left = salted.select("a", "salt").distinct().join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
    return right.join(left, ["a", "salt"]).drop("salt")


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``a, b`` whose sets are similar."""
    return _paired(pairs, sets).where(_similar("left", "right")).select("a", "b")


def _open_pairs(met: DataFrame, links: DataFrame, linked: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``a, b`` in different components under one head that its differences do not rule out.

    ``links`` holds the links of heads (``a``) to their nodes (``b``), ``linked`` their components.
    """
    members = met.where("node <> head.node").select(F.col("head.node").alias("a"), F.col("node").alias("b"), "size").distinct()
    members = stored(members.join(linked.withColumnRenamed("node", "b"), "b", "left").withColumn("root", F.coalesce("root", "b")))
    mixed = members.groupBy("a").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("a")
    open_ = members.join(mixed, "a").join(links.withColumn("near", F.lit(True)), ["a", "b"], "left")
    open_ = stored(open_.withColumn("near", F.coalesce("near", F.lit(False))))
    made = _paired(open_, sets).select("a", "b", "size", "root", "near", _difference("left", "right").alias("d"))
    # Sets are similar if they differ in at most (of - low) / (of + low) of the sum of their sizes.
    low, of = SIMILAR
    far, all_ = of - low, of + low
    made = stored(made.withColumn("n", F.size("d").cast("long")).withColumn("w", F.col("n") * all_ - F.col("size") * far))
    least = made.groupBy("a").agg(F.min("w").alias("of_all"), F.min(F.when(~F.col("near"), F.col("w"))).alias("of_far"))
    # The least number of common entries that any similar partner of a node can have.
    other = F.when(F.col("near"), F.col("of_far")).otherwise(F.col("of_all"))
    must = made.join(least, "a").withColumn("least", F.greatest(F.lit(1), F.ceil((F.col("w") + other) / (2 * all_))))
    nodes = must.where("of_far IS NOT NULL").withColumn("most", F.col("n") - F.col("least") + 1).where("most > 0")
    entries = nodes.select("a", "b", "size", "root", "near", "n", "w", "most", F.explode("d").alias("entry"))
    often = made.select("a", F.explode("d").alias("entry")).groupBy("a", "entry").agg(F.count("*").alias("often")).where("often > 1")
    # Entries of one's own come first in the order and meet nobody, so only the others are ranked.
    own = Window.partitionBy("a", "b")
    shared = entries.join(often, ["a", "entry"])
    place = F.row_number().over(own.orderBy("often", "entry")) + F.col("n") - F.count("*").over(own)
    posted = stored(shared.withColumn("place", place).where("place <= most").drop("most", "often"))
    x, y = posted.alias("x"), posted.alias("y")
    common = f"cast(ceil((x.w + y.w) / {2 * all_}D) AS bigint)"
    on = F.expr(
        f"x.a = y.a AND x.entry = y.entry AND x.b < y.b AND x.root <> y.root AND NOT (x.near AND y.near) AND {_near('x.size', 'y.size')} "
        f"AND x.place <= x.n - {common} + 1 AND y.place <= y.n - {common} + 1"
    )
    return x.join(y, on).selectExpr("x.b AS a", "y.b AS b").distinct()


def _near(size: str, other: str) -> str:
    """SQL: sets of these sizes can be similar."""
    low, of = SIMILAR
    return f"least({size}, {other}) * {of} >= greatest({size}, {other}) * {low}"


def _print_links(made: DataFrame) -> DataFrame:
    """``a, b``: pairs of a head (the least node) and each other node of the groups that ``simhash`` makes of the
    fingerprints of ``made`` (column ``print``)."""
    own = made.select("node", "size", "print").distinct()
    placed = own.join(print_groups(own), "print", "left").withColumn("group", F.coalesce("group", "print"))
    heads = placed.groupBy("group").agg(F.min(F.struct("node", "size")).alias("head"), F.max("node").alias("top")).where("head.node < top")
    met = placed.join(heads, "group").where("node <> head.node").where(_near("size", "head.size"))
    return met.selectExpr("head.node AS a", "node AS b").distinct()


def _grouped(rows: DataFrame, id: str, text: str) -> DataFrame:
    """``_tw_id, _tw_hash, group`` of every row of ``rows``, which holds ``_tw_hash``."""
    made = rows.select(quoted(id).alias("_tw_id"), "_tw_hash", sketches(quoted(text)).alias("s"))
    made = stored(made.select("_tw_id", "_tw_hash", "s.*"))
    prints = stored(_print_links(made))
    nodes = made.groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))
    keyed = nodes.select("node", "size", F.explode("bands").alias("key"))
    heads = keyed.groupBy("key").agg(F.min(F.struct("node", "size")).alias("head"), F.count("*").alias("n")).where("n > 1")
    met = stored(keyed.join(heads, "key").select("key", "node", "size", "head"))

    # Shingle sets of the nodes that share a bucket or a group of fingerprints.
    asked = met.select("node").union(prints.select("a")).union(prints.select("b")).distinct()
    suspects = made.join(asked, "node", "left_semi").select("_tw_hash").distinct()
    held = bloom.filled(suspects, F.col("_tw_hash"))
    texts = bloom.tested(rows.select("_tw_hash", quoted(text).alias("_tw_text")), F.col("_tw_hash"), held, "_tw_listed")
    sets = texts.where("_tw_listed").select(named_sets("_tw_text").alias("s")).select("s.*")
    sets = stored(sets.groupBy("node").agg(F.first("shingles").alias("shingles")))

    star = met.where("node <> head.node").where(_near("size", "head.size")).selectExpr("head.node AS a", "node AS b")
    links = stored(_checked(stored(star.unionByName(prints).distinct()), sets))
    linked = components(links)

    # Open pairs link components, of which each is one node by now.
    root = linked.select(F.col("node").alias("b"), "root")
    found = _checked(stored(_open_pairs(met, links, linked, sets)), sets)
    for end in ("a", "b"):
        found = found.join(root.withColumnRenamed("b", end), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    joined = components(found).select(F.col("node").alias("root"), F.col("root").alias("least"))
    every = made.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")).join(joined, "root", "left")
    return every.select("_tw_id", "_tw_hash", F.coalesce("least", "root").alias("group"))


def drop_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component of similar texts, chosen as in
    ``simhash.drop_near_copies``."""
    prepare(docs.sparkSession)
    rows = without(docs, ["_tw_id", "_tw_hash", "_tw_listed", "_tw_stays"]).withColumn("_tw_hash", F.xxhash64(quoted(text)))
    return keep_one(rows, _grouped(rows, id, text), id)
