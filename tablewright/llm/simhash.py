"""Near duplicates by SimHash fingerprints, with pigeonring filtering of candidates.

A fingerprint has 64 bits in a ring of three segments (22, 21 and 21 bits). Two fingerprints
that differ in at most two bits have a rotation of the ring whose chains of one, two and three
segments stay within proportional budgets: at most 0, 1 and 2 differing bits (two thirds of a
bit for each segment, rounded down). That is the pigeonring condition, stronger than asking for
one equal segment, and it makes keys of two segments possible: the first is equal and the second
equal or off by one bit. Every distinct fingerprint gives, for each rotation, the key of its two
leading segments, and one "raised" key for each unset bit of the second segment. Fingerprints
meet only under a common key; there the last segment settles the full Hamming distance.

A key fixes 42 or more bits, so a bucket cannot hold more than 2**22 plain and 21 * 2**22 raised
fingerprints, whatever the corpus, and random fingerprints hardly ever meet. In a bucket members
are not compared pair by pair: two last segments differ by at most two bits exactly if turning
at most one bit in each makes them equal, so sorting these neighbours gives a chain of links in
linear size. Copies are collapsed first, and only a spanning set of links leaves a bucket.

Results: words are `[^\\x20\\x09-\\x0D]+` of the text in lower-case A-Z; fewer than three words make
one shingle, no word (or a null text) the fingerprint zero, linked like any other. Texts of any
length are worked in slices of bounded memory. Repeated rows stay repeated, with one component.
Null ids do not become the smallest id; a component of null ids only has a null one. An empty
table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .common import columns, prepare, quoted, stored, without
from .components import components

DISTANCE = 2
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, bits) along the ring
SLICE = 1 << 15  # shingles counted at once
CHARS = 1 << 20  # bytes of text split into words at once


# --- fingerprints --------------------------------------------------------------------------

def _words(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a bounded number at a time."""
    if len(text) <= CHARS:
        yield text.split()
        return
    words, size = [], 0
    for found in re.finditer(rb"[^\x20\x09-\x0D]+", text):
        words.append(found.group())
        size += len(words[-1]) + 1
        if size > CHARS:
            yield words
            words, size = [], 0
    if words:
        yield words


def _add(hashes: list[int], bits: np.ndarray) -> None:
    for start in range(0, len(hashes), SLICE):
        part = np.array(hashes[start : start + SLICE], dtype="<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> Iterator[list[int]]:
    """Hashes of the word shingles of a text, repeats included, a bounded number at a time."""
    digest, held, some = xxhash.xxh64_intdigest, [], False
    for words in _words((text or "").encode().lower()):
        words = held + words
        if len(words) >= width:
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
            starts = np.concatenate(([0], ends[:-width]))
            line = b" ".join(words)
            some = True
            yield [digest(line[a:b], seed) for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist())]
        held = words[len(words) - width + 1 :] if len(words) >= width else words
    if held and not some:
        yield [digest(b" ".join(held), seed)]


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a text, repeats counted."""
    bits, total = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text, width, seed):
        _add(hashes, bits)
        total += len(hashes)
    return int(np.packbits(2 * bits > total, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Fingerprints of texts as signed longs."""
    for batch in batches:
        made = np.fromiter(map(fingerprint, batch.to_pylist()), dtype=np.uint64, count=len(batch))
        yield pa.array(made.view(np.int64))


# --- links ---------------------------------------------------------------------------------

def ring_keys(prints: DataFrame) -> DataFrame:
    """``key, rest, raised`` of each rotation of every fingerprint in ``prints`` (column ``print``).

    The key holds the rotation, an equal segment and the next one; ``rest`` the last segment.
    ``raised`` rows have one unset bit of the second segment set: of two fingerprints one bit
    apart there, the raised one meets the other.
    """
    rows = []
    for turn in range(3):
        (s0, b0), (s1, b1), (s2, b2) = (SEGMENTS[(turn + n) % 3] for n in range(3))
        part = lambda shift, bits: F.shiftrightunsigned("print", shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        lead = F.shiftleft(F.lit(turn).cast("long"), 43).bitwiseOR(F.shiftleft(part(s0, b0), b1))
        rows.append(
            F.struct(
                lead.alias("lead"), part(s1, b1).alias("second"), part(s2, b2).alias("rest"), F.lit(b1).alias("bits")
            )
        )
    turned = prints.select("print", F.explode(F.array(*rows)).alias("r")).select("print", "r.*")
    flip = F.explode(F.expr("sequence(-1, bits - 1)")).alias("flip")
    raised = turned.select("*", flip).where("flip < 0 OR (shiftrightunsigned(second, flip) & 1) = 0")
    key = "lead | second | (CASE WHEN flip < 0 THEN 0L ELSE shiftleft(1L, flip) END)"
    return raised.selectExpr(f"{key} AS key", "rest", "print", "flip >= 0 AS raised")


def bucket_links(key: np.ndarray, rest: np.ndarray, raised: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets, given rows sorted by key: pairs of labels that span all
    fingerprints within the distance in each bucket."""
    edge = np.flatnonzero(np.diff(key)) + 1
    starts = np.concatenate(([0], edge))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    plain = np.add.reduceat((~raised).astype(np.int64), starts)
    useful = np.repeat((sizes > 1) & (plain > 0), sizes)
    bucket = np.repeat(np.arange(len(starts)), sizes)[useful]
    rest, raised, label = rest[useful], raised[useful], label[useful]
    if not len(bucket):
        return label, label
    # Plain rows stand for their segment with at most one bit turned, raised rows for themselves.
    turns = np.concatenate(([0], 1 << np.arange(22, dtype=np.int64)))
    low = np.flatnonzero(~raised)
    codes = np.concatenate(((rest[low, None] ^ turns[None, :]).ravel(), rest[raised]))
    owner = np.concatenate((np.repeat(low, len(turns)), np.flatnonzero(raised)))
    spot = (bucket[owner] << 22) | codes
    # At a common spot the plain rows come first; raised rows need a plain one to link to.
    order = np.lexsort((raised[owner], spot))
    spot, owner = spot[order], owner[order]
    first = np.concatenate(([True], spot[1:] != spot[:-1]))
    head = owner[np.maximum.accumulate(np.where(first, np.arange(len(spot)), 0))]
    linked = ~first & ~raised[head]
    a, b = label[owner[linked]], label[head[linked]]
    return _spanning(a, b)


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    off = root != np.arange(len(nodes))
    return nodes[off], nodes[root[off]]


LINKS_AT_ONCE = 400_000


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut sorted rows at bucket borders and link each bucket."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def out(parts):
        a, b = bucket_links(*parts)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        key, rest, label = (batch.column(n).to_numpy() for n in range(3))
        held.append((key, rest, np.asarray(batch.column(3).to_numpy(zero_copy_only=False), dtype=bool), label))
        count += len(key)
        if count < LINKS_AT_ONCE:
            continue
        parts = [np.concatenate(x) for x in zip(*held)]
        cut = int(np.searchsorted(parts[0], parts[0][-1]))
        if cut:
            yield out([x[:cut] for x in parts])
        held, count = [tuple(x[cut:].copy() for x in parts)], len(parts[0]) - cut
    if count:
        yield out([np.concatenate(x) for x in zip(*held)])


def near_links(prints: DataFrame) -> DataFrame:
    """``a, b``: links that connect all distinct fingerprints at two or fewer differing bits."""
    keyed = ring_keys(prints).select("key", "rest", "print", "raised")
    sorted_rows = keyed.repartition("key").sortWithinPartitions("key")
    return sorted_rows.mapInArrow(_link_batches, "a long, b long")


def print_groups(prints: DataFrame) -> DataFrame:
    """``print, group`` of the fingerprints in ``prints`` that are linked to others: the group is the smallest one."""
    near = components(near_links(prints.select("print").distinct()))
    return near.select(F.col("node").alias("print"), F.col("root").alias("group"))


# --- documents -----------------------------------------------------------------------------

def _grouped(docs: DataFrame, id: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``_tw_id``, columns of ``keep``, ``print``, ``group`` (smallest fingerprint of the component)
    and ``component_id`` of every row. Rows leave their text at the first step."""
    prepare(docs.sparkSession)
    rows = docs.select(quoted(id).alias("_tw_id"), *map(quoted, keep), fingerprints(quoted(text)).alias("print"))
    rows = rows.checkpoint()
    prints = rows.groupBy("print").agg(F.min("_tw_id").alias("low"))
    near = components(near_links(prints.select("print")))
    placed = prints.join(near, prints["print"] == near["node"], "left").select("print", "low", "root")
    alone = placed.where("root IS NULL").select("print", F.col("print").alias("group"), F.col("low").alias("component_id"))
    linked = placed.where("root IS NOT NULL")
    roots = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    joined = linked.join(roots, "root").select("print", F.col("root").alias("group"), "component_id")
    return rows.join(alone.unionByName(joined), "print")


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits) and ``component_id``, the
    smallest id of its component."""
    made = _grouped(docs, id, text)
    return made.select(
        F.col("_tw_id").alias(id), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id (null ids last),
    of several texts under that id the one with the smallest hash. Of rows equal in id and text
    one stays.

    What has to go (or to become one row) is listed by id and hash of the text. A Bloom filter of
    that list, of bounded size, lets most documents pass as they are; only the others are shuffled
    to meet the list.
    """
    rows = without(docs, ["_tw_id", "_tw_hash", "_tw_listed", "_tw_stays"]).withColumn("_tw_hash", F.xxhash64(quoted(text)))
    return keep_one(rows, _grouped(rows, id, text, ("_tw_hash",)), id)


def keep_one(rows: DataFrame, grouped: DataFrame, id: str) -> DataFrame:
    """``rows`` without ``_tw_hash``, one of each ``group``; see ``drop_near_copies``."""
    order = F.struct(F.col("_tw_id").isNull().alias("a"), "_tw_id", "_tw_hash")
    best = grouped.groupBy("group").agg(F.min(order).alias("best"))
    single = grouped.groupBy("group", "_tw_id", "_tw_hash").agg(F.count("*").alias("n")).join(best, "group")
    stays = F.col("best._tw_id").eqNullSafe(F.col("_tw_id")) & (F.col("best._tw_hash") == F.col("_tw_hash"))
    listed = single.select("_tw_id", F.col("_tw_hash").alias("_tw_same"), stays.alias("_tw_stays"), "n")
    listed = stored(listed.where("NOT _tw_stays OR n > 1").drop("n"))
    held = bloom.filled(listed, F.xxhash64("_tw_id", "_tw_same"))
    marked = bloom.tested(rows, F.xxhash64(quoted(id), F.col("_tw_hash")), held, "_tw_listed")
    same = [quoted(id).eqNullSafe(F.col("_tw_id")), F.col("_tw_hash") == F.col("_tw_same")]
    met = marked.where("_tw_listed").join(listed, same, "left").where("coalesce(_tw_stays, true)")
    names = [c for c in rows.columns if c != "_tw_hash"]
    passed = columns(marked.where("NOT _tw_listed"), names)
    return passed.unionByName(columns(met.dropDuplicates([id, "_tw_hash"]), names))
