"""Ranked lexical search over bit-sliced Bloom signatures.

*Index.* Documents are stored in blocks (``blocks``); in a block, those whose signatures have one width
(a power of two, at least ``BITS`` bits for each entry) form a row of the index. A signature holds
``HASHES`` bits for each entry, and an entry is a term at one of the levels of its frequency: 1, 2, 3, 5,
9, ... The row stores the signatures by bit: for each bit position a bitmap over its documents. Next
to it come length and largest term frequency of every document, and, as rows of their own, the
number of documents of each term in the block.

*Bounds.* A term's bitmaps, joined by AND, give all documents that may hold it (some that do not as
well, never fewer), level by level. A query's weights are added up over these bitmaps; each level adds what
its frequencies can add at most to the score of a document of that length. No score is above this bound.

*Search.* The 20 documents with the highest bounds of each item are scored on their texts. The 20th
of these scores is a floor: every document whose bound reaches it (at the same score: with an id that
is not larger) is scored on its text, all others are provably not among the best.

Items are worked in chunks of about ``ENTRIES`` terms (an item is never cut), so what tasks are sent does
not grow with the item table; documents of a chunk's items are joined back to their blocks. The index
has no state on the driver but the number of documents and of their terms.

Results: terms are ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` in lower-case A-Z. Null and empty texts hold none
and are never found; an item without a known term finds nothing. Items equal in id and text are one
item; two texts under one id are ranked apart. Repeated documents are all ranked. Equal scores go by
id, null ids last. Empty tables give an empty one; other columns are ignored. A text is worked whole.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from . import blocks
from .common import prepare, quoted

BEST = 20
BITS, HASHES = 12, 4
ENTRIES = 1 << 14  # terms of the items in a chunk, with repeats in different items
DOCS, CELLS = 1024, 1 << 24  # documents of an index row, and bits of one
BLOCK = 4 * 1024 * 1024  # bytes of text in a block
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEVELS = np.array([1, 2, *[(1 << n) + 1 for n in range(1, 40)]], np.int64)  # least frequency of each level

_OTHER = [c for c in range(128) if not chr(c).isalnum()]
_FOLD = bytes(32 if c in _OTHER else c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPREAD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def positions(hashes: np.ndarray, level: np.ndarray | int, width: int) -> np.ndarray:
    """Bit positions of entries (hash of the term, level) in signatures of ``width`` bits."""
    with np.errstate(over="ignore"):
        x = (hashes ^ (np.asarray(level, np.uint64) * _SPREAD[0])) * _SPREAD[1]
        x ^= x >> np.uint64(29)
        step = ((x * _SPREAD[2]) >> np.uint64(20)) | np.uint64(1)
        at = (x[:, None] >> np.uint64(7)) + np.arange(HASHES, dtype=np.uint64) * step[:, None]
    return (at & np.uint64(width - 1)).astype(np.int64)


INDEX = "block long, width int, docs array<int>, ids array<long>, lengths array<long>, tops array<long>, slices binary, term string, df long"


def _index_rows(block: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
    # Terms of all texts in a row, numbered; the byte FF, in no UTF-8 text, ends a text.
    line = b" \xff ".join([(t.as_py() or b"").translate(_FOLD) for t in rows.column("text")])
    found = pa.array([b"\xff", *line.split()], pa.binary()).dictionary_encode()
    del line
    known, number = found.dictionary.to_pylist()[1:], found.indices.to_numpy()[1:].astype(np.int64) - 1
    del found
    if not known:
        return
    doc = np.cumsum(number < 0)
    lengths = np.bincount(doc[number >= 0], minlength=rows.num_rows).astype(np.int64)
    code = (doc << 32 | number)[number >= 0]
    del doc, number
    code, tf = np.unique(code, return_counts=True)
    doc, term = code >> 32, code & 0xFFFFFFFF
    hashes = np.array([xxhash.xxh64_intdigest(t) for t in known], np.uint64)[term]
    top = np.zeros(len(lengths), np.int64)
    np.maximum.at(top, doc, tf)
    high = np.searchsorted(LEVELS, tf, "right")  # levels that the term reaches
    sizes = np.bincount(doc, high, len(lengths))
    width = 1 << np.ceil(np.log2(np.maximum(64, BITS * sizes))).astype(np.int64)
    ids = rows.column("id").to_numpy(zero_copy_only=False) if not rows.column("id").null_count else np.array(rows.column("id").to_pylist(), object)
    made: list[tuple] = []
    for w in np.unique(width[lengths > 0]).tolist():
        members = np.flatnonzero((width == w) & (lengths > 0))
        for start in range(0, len(members), max(1, min(DOCS, CELLS // w))):
            part = members[start : start + max(1, min(DOCS, CELLS // w))]
            place = np.full(len(lengths), -1)
            place[part] = np.arange(len(part))
            mine = np.flatnonzero(place[doc] >= 0)
            bits = np.zeros((w, len(part)), bool)
            for level in range(int(high[mine].max())):
                there = mine[high[mine] > level]
                bits[positions(hashes[there], level, w), place[doc[there]][:, None]] = True
            slices = np.packbits(bits, axis=1, bitorder="little").tobytes()
            made.append((block, w, part.tolist(), [None if i is None else int(i) for i in ids[part]], lengths[part].tolist(), top[part].tolist(), slices))
    for row in made:
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*row, None, None), kinds)], names=_names(INDEX))
    df = np.bincount(term, minlength=len(known))
    for start in range(0, len(known), 50_000):
        some = known[start : start + 50_000]
        empty = [pa.nulls(len(some), k) for k in (pa.int32(), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3, pa.binary())]
        text = pa.array(some, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), *empty, text, pa.array(df[start : start + 50_000])], names=_names(INDEX))


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


class Index:
    """Blocks of documents, their bit slices, and document counts of all terms."""

    def __init__(self, docs: DataFrame, id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK) -> None:
        spark = prepare(docs.sparkSession)
        self.blocks = blocks.stored(docs, quoted(text), block_bytes, id=quoted(id).cast("long")).select("block", "data")

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                    yield from _index_rows(block, blocks.unpacked(data.as_py()))

        path = f"{shared_folder(spark)}/signatures-{uuid.uuid4()}"
        self.blocks.mapInArrow(build, INDEX).write.parquet(path)
        stored = spark.read.schema(INDEX).parquet(path)
        self.rows = stored.where("term IS NULL").drop("term", "df")
        self.df = stored.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
        sums = self.rows.selectExpr("size(docs) AS docs", "aggregate(lengths, 0L, (a, b) -> a + b) AS terms")
        self.docs, self.terms = sums.selectExpr("coalesce(sum(docs), 0)", "coalesce(sum(terms), 0)").first()


def weights(items: DataFrame, index: Index, item: str, text: str) -> DataFrame:
    """``item, item_id, term, weight`` of items: weight is the term's, times its number in the item."""
    rows = items.select(quoted(item).alias("item_id"), quoted(text).alias("_t")).distinct()
    rows = rows.withColumn("item", F.monotonically_increasing_id()).checkpoint()
    folded = F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = rows.select("item", "item_id", F.explode(F.regexp_extract_all(folded, F.lit(f"({TERM})"))).alias("term"))
    each = each.groupBy("item", "item_id", "term").agg(F.count("*").alias("_n")).join(index.df, "term")
    weight = F.floor(F.lit(1000) * F.log((F.lit(2) * F.lit(index.docs) + 2).cast("double") / (F.lit(2) * F.col("df") + 1).cast("double")))
    return each.select("item", "item_id", "term", (weight * F.col("_n")).cast("long").alias("weight")).where("weight > 0")


class Chunk:
    """Terms and weights of some items, as tasks need them."""

    def __init__(self, rows: list, docs: int, terms: int) -> None:
        self.docs, self.total = docs, terms
        names: dict[str, int] = {}
        own: dict[int, tuple[list, list]] = {}
        for row in rows:
            at, weight = own.setdefault(row["item"], ([], []))
            at.append(names.setdefault(row["term"], len(names)))
            weight.append(row["weight"])
        self.names = [n.encode() for n in names]
        self.items = {item: (np.array(a, np.int64), np.array(w, np.int64)) for item, (a, w) in own.items()}

    def slope(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What a weight is multiplied by, for a term of this frequency in a document of this length."""
        m = 75 + 25 * length * self.docs // self.total
        return 1_000_000_000 * tf // (1000 * tf + 12 * m)

    def bounds(self, row: dict) -> Iterator[tuple[int, np.ndarray]]:
        """Each item with upper bounds of its scores for the documents of an index row."""
        width, n = row["width"], len(row["docs"])
        lengths, tops = np.array(row["lengths"], np.int64), np.array(row["tops"], np.int64)
        slices = np.frombuffer(row["slices"], np.uint8).reshape(width, -1)
        hashes = np.array([xxhash.xxh64_intdigest(t) for t in self.names], np.uint64)
        live, levels, before = np.arange(len(hashes)), [], np.zeros(n, np.int64)
        for level in range(int(np.searchsorted(LEVELS, tops.max(), "right"))):
            held = np.bitwise_and.reduce(slices[positions(hashes[live], level, width)], axis=1)
            some = held.any(axis=1)
            live, held = live[some], held[some]
            if not len(live):
                break
            slope = self.slope(np.minimum(LEVELS[level + 1] - 1, tops), lengths)
            place = np.full(len(hashes), len(live))
            place[live] = np.arange(len(live))
            bits = np.vstack((np.unpackbits(held, axis=1, count=n, bitorder="little"), np.zeros((1, n), np.uint8)))
            levels.append((place, bits, slope - before))
            before = slope
        for item, (at, weight) in self.items.items():
            bound = np.zeros(n, np.int64)
            for place, bits, more in levels:
                here = place[at]
                there = here < len(bits) - 1
                if not there.any():
                    break
                # Sums of weights stay far below 2**53.
                bound += (weight[there].astype(float) @ bits[here[there]]).astype(np.int64) * more
            yield item, bound

    def score(self, item: int, counts: Counter, length: int) -> int:
        at, weight = self.items[item]
        tf = np.array([counts.get(self.names[t], 0) for t in at], np.int64)
        return int((weight * self.slope(tf, np.full(len(tf), length, np.int64))).sum())


CANDIDATE = "item long, block long, doc int, id long, bound long"


def _candidates(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=_names(CANDIDATE))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch one by one, as their slices may be large."""
    for n in range(batch.num_rows):
        yield {name: column[n].as_py() for name, column in zip(batch.schema.names, batch.columns)}


def _highest(chunk: Chunk, best: int):
    """The documents of a task with the highest bounds, for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in _rows(batch):
                for item, bound in chunk.bounds(row):
                    held = kept.setdefault(item, [])
                    floor = held[-1][4] if len(held) == best else 0
                    at = np.flatnonzero(bound > floor)
                    if len(at) > best:
                        at = at[np.argpartition(-bound[at], best - 1)[:best]]
                    held += [(item, row["block"], row["docs"][n], row["ids"][n], int(bound[n])) for n in at.tolist()]
                    held.sort(key=lambda c: -c[4])
                    del held[best:]
        found = [c for held in kept.values() for c in held]
        if found:
            yield _candidates(found)

    return run


def _reaching(chunk: Chunk, floors: dict[int, tuple[int, int | None]]):
    """All documents that the floors do not exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                ids = np.array([np.iinfo(np.int64).max if i is None else i for i in row["ids"]], np.int64)
                for item, bound in chunk.bounds(row):
                    floor, last = floors.get(item, (0, None))
                    reach = bound > floor
                    if floor:
                        reach |= (bound == floor) & (ids <= (np.iinfo(np.int64).max if last is None else last))
                    at = np.flatnonzero(reach)
                    if len(at):
                        yield _candidates([(item, row["block"], row["docs"][n], row["ids"][n], int(bound[n])) for n in at.tolist()])

    return run


SCORED = "item long, id long, score long"


def _scored(chunk: Chunk, index: Index, candidates: DataFrame) -> DataFrame:
    """Exact scores of candidates, from the texts of their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, wanted in zip(batch.column("data"), batch.column("wanted")):
                rows = blocks.unpacked(data.as_py())
                ids, texts, by_doc = rows.column("id"), rows.column("text"), {}
                for pair in wanted.as_py():
                    by_doc.setdefault(pair["doc"], []).append(pair["item"])
                out = []
                for doc, items in by_doc.items():
                    found = terms(texts[doc].as_py())
                    counts = Counter(found)
                    out += [(item, ids[doc].as_py(), chunk.score(item, counts, len(found))) for item in items]
                columns = [pa.array(c, pa.int64()) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, names=_names(SCORED)).filter(pa.array([s > 0 for _, _, s in out]))

    wanted = candidates.groupBy("block").agg(F.collect_list(F.struct("item", "doc")).alias("wanted"))
    return index.blocks.join(wanted, "block").select("data", "wanted").mapInArrow(run, SCORED)


def _first(rows: DataFrame, best: int, key: str) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc(key), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def search(
    index: Index, items: DataFrame, item: str = "item_id", text: str = "text", best: int = BEST, entries: int = ENTRIES
) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's best documents."""
    known = weights(items, index, item, text)
    spark, kind = known.sparkSession, known.schema["item_id"].dataType.simpleString()
    result = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    if not index.docs:
        return result
    known = known.checkpoint()
    chunks = max(1, -(-known.count() // entries))
    names = known.select("item", "item_id").distinct()
    for number in range(chunks):
        # About `entries` terms, of whole items.
        rows = known.where(F.pmod(F.xxhash64("item"), F.lit(chunks)) == number).select("item", "term", "weight").collect()
        if not rows:
            continue
        chunk = Chunk(rows, index.docs, index.terms)
        high = _first(index.rows.mapInArrow(_highest(chunk, best), CANDIDATE), best, "bound")
        last = _first(_scored(chunk, index, high), best, "score").where(F.col("rank") == best)
        floors = {row["item"]: (row["score"], row["id"]) for row in last.select("item", "id", "score").collect()}
        reaching = index.rows.mapInArrow(_reaching(chunk, floors), CANDIDATE)
        ranked = _first(_scored(chunk, index, reaching), best, "score").checkpoint()
        named = ranked.join(names, "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
        result = result.unionByName(named)
    return result
