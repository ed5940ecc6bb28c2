"""Phrase collocations by Rabin-Karp fingerprints.

1. Documents are stored in blocks (``blocks``). In a block, the fingerprint of every n-gram comes from
   numpy prefix polynomials over the hashes of its words. One 32-bit value for each distinct n-gram
   goes to the part that the upper bits of its fingerprint name; the number of parts grows with the
   text, so that values are as sparse in a part whatever the size of the corpus.
2. A part adds up what all blocks sent. The sender's number is the occurrence pointer: each block gets
   back which of its values occur often enough.
3. The block looks these n-grams up in its text, so only frequent phrases are ever written out, and
   Spark adds up their exact counts by the phrase itself. Fingerprints that two phrases share (or that
   only add up to enough together) come apart here: a collision costs a row, never a result.
4. Scores, cuts and the drop of phrases inside longer ones are joins over frequent phrases.

A phrase counts at most once a block in every shuffle, however common it is; the parts of a candidate
are at least as frequent as the candidate, so nothing below the least frequency is ever needed.

Results: A-Z are lower-cased; ``[.,;:!?\\x0A-\\x0D]`` end a piece, space and tab part words; a phrase
stays inside a piece. A null text has no word; a null language is ``und``. Repeated rows count as
often as they come; ids play no part. An empty table gives an empty one. Of a language the first
``top`` phrases come out, by score, frequency and phrase, so ties are settled. A text is worked whole,
in memory in proportion to its length. Columns beyond text and language are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .common import prepare, quoted

LEAST, INSIDE, TOP, LONGEST = 10, 50, 2000, 3
PART_BYTES = 8 * 1024 * 1024  # bytes of text for each part of the fingerprints
BLOCK = 4 * 1024 * 1024  # bytes of text in a block
NO_LANG = "und"

# Ends of pieces become the byte FF, which no UTF-8 text holds.
_END = b"\xff"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + _END * 10)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def words(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Word numbers of the texts in a row, -1 where a piece ends, and the distinct words."""
    line = _END.join(texts).translate(_FOLD).replace(_END, b" " + _END + b" ")
    found = pa.array([_END, *line.split()], pa.binary()).dictionary_encode()
    # The end of a piece is number 0.
    return found.indices.to_numpy()[1:].astype(np.int64) - 1, found.dictionary.to_pylist()[1:]


class Grams:
    """Distinct n-grams of some texts: ``first`` places, exact ``counts`` and ``prints``, by length."""

    def __init__(self, texts: list[bytes], lang: str, longest: int = LONGEST) -> None:
        ids, self.words = words(texts)
        self.ids, self.total = ids, int((ids >= 0).sum())
        seed = xxhash.xxh32_intdigest(lang.encode())
        hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words] + [0], np.uint64)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(len(ids) - 1, 0), _BASE))))[: len(ids)]
            backs = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(len(ids) - 1, 0), _BACK))))[: len(ids)]
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes[ids] * powers, dtype=np.uint64)))
        self.first, self.counts, self.prints = {}, {}, {}
        code = ids
        for n in range(1, longest + 1):
            # The code of an n-gram: number of its first n - 1 words, then the last word.
            if n > 1:
                whole = (code[:-1] >= 0) & (ids[n - 1 :] >= 0)
                code = np.where(whole, (code[:-1] << 32) | (ids[n - 1 :] & 0xFFFFFFFF), -1)
            distinct, first, number, count = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
            real = distinct >= 0
            self.first[n], self.counts[n] = first[real], count[real]
            with np.errstate(over="ignore"):
                self.prints[n] = (sums[first[real] + n] - sums[first[real]]) * backs[first[real]] + np.uint64(n)
            code = np.where(code >= 0, number - int((~real).sum()), -1)

    def phrases(self, n: int, places: np.ndarray) -> pa.Array:
        """The n-grams at some places, written out."""
        words = pa.array(self.words, pa.binary())
        return pc.binary_join_element_wise(*[words.take(pa.array(self.ids[places + k])) for k in range(n)], b" ")


def spots(prints: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Part of a fingerprint (upper bits) and its value there (lower ``bits``), as one number."""
    part = ((prints >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return (part << np.uint64(32)) | (prints & np.uint64((1 << bits) - 1))


def _by_lang(data: bytes) -> Iterator[tuple[str, list[bytes]]]:
    rows, texts = blocks.unpacked(data), {}
    for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist()):
        if text:
            texts.setdefault(NO_LANG if lang is None else lang, []).append(text)
    yield from sorted(texts.items())


def _sender(parts: int, least: int, bits: int, longest: int):
    number = np.uint8 if least < 256 else np.uint32

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                spot, count = [], []
                for lang, texts in _by_lang(data.as_py()):
                    grams = Grams(texts, lang, longest)
                    spot += [spots(p, parts, bits) for p in grams.prints.values()]
                    count += grams.counts.values()
                    del grams
                if not spot:
                    continue
                spot, count = np.concatenate(spot), np.concatenate(count)
                spot, at = np.unique(spot, return_inverse=True)
                # More than the least frequency need not be known.
                count = np.minimum(np.bincount(at, count, len(spot)), least).astype(number)
                part = (spot >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(part)) + 1
                starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(spot)]))
                value = spot.astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[starts], pa.int32()), pa.array([block] * len(starts), pa.int64()),
                        pa.array([value[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                        pa.array([count[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    ],
                    names=["part", "block", "values", "counts"],
                )

    return send


def _part_totals(least: int):
    number = np.uint8 if least < 256 else np.uint32

    def frequent(rows: pa.Table) -> pa.Table:
        values = [np.frombuffer(v.as_py(), np.uint32) for v in rows.column("values")]
        counts = [np.frombuffer(c.as_py(), number) for c in rows.column("counts")]
        distinct, at = np.unique(np.concatenate(values), return_inverse=True)
        often = (np.bincount(at, np.concatenate(counts), len(distinct)) >= least)[at]
        ends = np.cumsum([len(v) for v in values])
        kept = [v[often[e - len(v) : e]].tobytes() for v, e in zip(values, ends)]
        columns = [rows.column("block"), rows.column("part"), pa.array(kept, pa.binary())]
        return pa.table(columns, names=["block", "part", "values"]).filter(pa.array([bool(k) for k in kept]))

    return frequent


def _held(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each of ``wanted`` is among the sorted ``values``."""
    if not len(values):
        return np.zeros(len(wanted), bool)
    return values[np.minimum(np.searchsorted(values, wanted), len(values) - 1)] == wanted


PHRASE = "lang string, n int, phrase string, count long"


def _materialiser(parts: int, bits: int, longest: int):
    def written(block: pa.Table, found: pa.Table) -> pa.Table:
        wanted = [np.frombuffer(v.as_py(), np.uint32).astype(np.uint64) | np.uint64(p.as_py() << 32) for p, v in zip(found.column("part"), found.column("values"))]
        wanted = np.sort(np.concatenate([np.empty(0, np.uint64), *wanted]))
        made = [(NO_LANG, 0, pa.array([b""][:0], pa.binary()), np.empty(0, np.int64))]
        for data in block.column("data"):
            for lang, texts in _by_lang(data.as_py()):
                grams = Grams(texts, lang, longest)
                made.append((lang, 0, pa.array([b""], pa.binary()), np.array([grams.total])))
                for n, prints in grams.prints.items():
                    hit = np.flatnonzero(_held(wanted, spots(prints, parts, bits)))
                    if len(hit):
                        made.append((lang, n, grams.phrases(n, grams.first[n][hit]), grams.counts[n][hit]))
        tables = []
        for lang, n, texts, counts in made:
            same = [pa.repeat(pa.scalar(v, k), len(texts)) for v, k in ((lang, pa.string()), (n, pa.int32()))]
            tables.append(pa.table([*same, texts.cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "n", "phrase", "count"]))
        return pa.concat_tables(tables)

    return written


def frequent_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, bits: int = 32,
    part_bytes: int = PART_BYTES, block_bytes: int = BLOCK,
) -> DataFrame:
    """``lang, n, phrase, count`` of all phrases of up to ``longest`` words that occur ``least`` times in
    their language. Rows with ``n`` 0 and an empty phrase hold a language's words in all."""
    prepare(docs.sparkSession)
    held = blocks.stored(docs, quoted(text), block_bytes, lang=quoted(lang))
    parts = max(1, -(-blocks.total_bytes(held) // part_bytes))
    sent = held.select("block", "data").mapInArrow(_sender(parts, least, bits, longest), "part int, block long, values binary, counts binary")
    found = sent.groupBy("part").applyInArrow(_part_totals(least), "block long, part int, values binary")
    pair = held.select("block", "data").groupBy("block").cogroup(found.groupBy("block"))
    each = pair.applyInArrow(_materialiser(parts, bits, longest), PHRASE)
    totals = each.groupBy("lang", "n", "phrase").agg(F.sum("count").alias("count"))
    return totals.where((F.col("n") == 0) | (F.col("count") >= least)).checkpoint()


def _part(phrase: str, start: int, n: int):
    """Words ``start`` to ``start + n`` of a phrase."""
    return F.array_join(F.slice(F.split(phrase, " "), start + 1, n), " ")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, inside: int = INSIDE, top: int = TOP,
    longest: int = LONGEST, **sizes: int,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases of two or more words.

    ``a`` is the phrase's frequency, ``l`` and ``r`` those of the two sides of its lowest-scoring cut.
    Phrases inside a longer candidate with at least ``inside`` percent of their frequency are left out.
    """
    known = frequent_phrases(docs, text, lang, least, longest, **sizes)
    counts = known.where("n > 0")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    scored = []
    for n in range(2, longest + 1):
        own = counts.where(F.col("n") == n).select("lang", "phrase", F.col("count").alias("a"))
        cuts = []
        for k in range(1, n):
            left = counts.where(F.col("n") == k).select("lang", F.col("phrase").alias("_left"), F.col("count").alias("l"))
            right = counts.where(F.col("n") == n - k).select("lang", F.col("phrase").alias("_right"), F.col("count").alias("r"))
            cut = own.withColumns({"_left": _part("phrase", 0, k), "_right": _part("phrase", k, n - k)})
            # Both sides are as frequent as the phrase, so both are there.
            cut = cut.join(left, ["lang", "_left"]).join(right, ["lang", "_right"]).withColumns({"_a2": wide("a") * wide("a"), "_lr": wide("l") * wide("r")})
            cuts.append(cut.selectExpr("lang", "phrase", "a", "l", "r", f"{k} AS k", "cast(((_a2 * 1000000BD) div _lr) AS bigint) AS score"))
        every = reduce(DataFrame.unionByName, cuts)
        lowest = every.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k")).alias("c"))
        scored.append(lowest.select("lang", "phrase", F.lit(n).alias("words"), "c.*"))
    candidates = reduce(DataFrame.unionByName, scored)
    # The most frequent longer candidate around each part of a candidate.
    around = [
        counts.where(F.col("n") == n).select("lang", F.explode(F.array(*[_part("phrase", s, k) for s in range(n - k + 1)])).alias("phrase"), F.col("count").alias("_f"))
        for n in range(3, longest + 1)
        for k in range(2, n)
    ]
    if around:
        longer = reduce(DataFrame.unionByName, around).groupBy("lang", "phrase").agg(F.max("_f").alias("_f"))
        candidates = candidates.join(longer, ["lang", "phrase"], "left").where(F.expr(f"_f IS NULL OR _f * 100 < a * {inside}"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # Spark cuts each task to `top` rows of a language before they meet.
    best = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    sums = known.where("n = 0").select("lang", F.col("count").alias("n"))
    return best.join(sums, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
